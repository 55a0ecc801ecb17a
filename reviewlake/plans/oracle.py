"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The oracle only sees the driver's tables, so the ``reviews`` test view is put
in front of each statement as a WITH clause.  Column names and types follow the
Spark side: counts BIGINT, ratios DOUBLE, floats rounded to 6 places.
"""

from __future__ import annotations

from reviewlake import dictionaries as D
from reviewlake.functions import masking as _M
from reviewlake.functions import prompts as _PR
from reviewlake.operators import context as _CX
from reviewlake.operators import summaries as SM
from reviewlake.plans.catalog import SUMMARY_BLOCKS as _SUMMARY_BLOCKS

REVIEWS_CTE = """reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.source AS company,
    split_part(d.text, chr(10), 1) AS title,
    substring(d.text, CAST(length(split_part(d.text, chr(10), 1)) + 2 AS INT)) AS body,
    CAST(DATE '2024-01-01' + CAST(d.doc_id % 366 AS INT) AS DATE) AS published_date,
    CASE WHEN d.doc_id % 11 = 0 THEN 'unknown' ELSE CAST(1 + d.n_chars % 5 AS VARCHAR) END AS rating,
    CASE WHEN d.doc_id % 13 = 0 THEN 'unknown'
         ELSE CAST(CAST(1000 + (d.n_chars * 37 + d.doc_id) % 4001 AS DOUBLE) / 1000 AS VARCHAR) END AS text_rating,
    CASE d.doc_id % 7 WHEN 0 THEN 'in-person shopping' WHEN 1 THEN 'delivery experience'
         WHEN 2 THEN 'customer service' WHEN 3 THEN 'price'
         WHEN 4 THEN 'product defects and quality' WHEN 5 THEN 'unknown' END AS topic,
    COALESCE(l.quality = 1, FALSE) AS verified, d.lang AS lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""

NUM_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def num(expr: str) -> str:
    """Guarded numeric cast, same rule as functions.text.guarded_double."""
    return f"(CASE WHEN regexp_matches({expr}, '{NUM_RE}') THEN TRY_CAST(trim({expr}) AS DOUBLE) END)"


ENRICHED_CTE = REVIEWS_CTE + f""",
enriched AS (
  SELECT id, company, title, body, topic, verified, lang,
    CAST(published_date AS TIMESTAMP) AS published_at,
    rating AS rating_raw, {num('rating')} AS rating,
    text_rating AS text_rating_raw, round({num('text_rating')}, 3) AS text_rating,
    abs(round({num('text_rating')}, 3) - {num('rating')}) AS discrepancy
  FROM reviews
)"""


def with_reviews(body: str) -> str:
    return f"WITH {REVIEWS_CTE}\n{body}"


def with_enriched(body: str, extra_ctes: str = "") -> str:
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"WITH {ENRICHED_CTE}{extra}\n{body}"


SQL: dict[str, str] = {}

SQL["rating_topic_freq"] = with_reviews("""
SELECT rating, topic, COUNT(*) AS frequency
FROM reviews WHERE rating IS NOT NULL AND topic IS NOT NULL
GROUP BY rating, topic""")


# --- helpers shared by the SQL below -------------------------------------------------
TOKEN_RE = r"[\p{L}\p{N}_][\p{L}\p{N}_'']+"  # quote doubled for SQL


def toks(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{TOKEN_RE}', 0)"


def values(d, alias: str) -> str:
    """A Dictionary as a VALUES table with the same column names."""
    cols = [c.strip().split(" ")[0] for c in d.schema.split(",")]

    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return str(v)
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in d.rows)
    return f"(VALUES {rows}) AS {alias}({', '.join(cols)})"


# --- sources / projections -------------------------------------------------------------

SQL["page_number"] = """
SELECT page_id, TRY_CAST(NULLIF(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INT) AS page
FROM pages"""

SQL["html_title_extract"] = """
SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages"""

SQL["url_last_segment"] = """
WITH s AS (SELECT page_id, NULLIF(string_split(NULLIF(url, ''), '/')[-1], '') AS segment FROM pages)
SELECT page_id, segment,
  COALESCE(segment, sha256(concat_ws(chr(1), COALESCE(CAST(page_id AS VARCHAR), '')))) AS review_id
FROM s"""

SQL["json_field_extract"] = """
SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INT) AS k FROM events"""

SQL["age_band"] = """
WITH a AS (SELECT event_id, TRY_CAST(json_extract(props, '$.k') AS INT) AS age FROM events)
SELECT event_id, age,
  CASE WHEN age >= 18 AND age < 35 THEN '18-35' WHEN age >= 35 AND age < 60 THEN '35-60'
       WHEN age >= 60 THEN '60+' END AS age_band
FROM a"""

SQL["company_slug"] = with_reviews("""
SELECT id, company, lower(replace(company, ' ', '_')) AS slug FROM reviews""")


SQL["default_fill"] = with_reviews("""
SELECT id, COALESCE(title, 'No Title') AS title, COALESCE(body, 'No Review Body') AS body,
  COALESCE(rating, 'unknown') AS rating, COALESCE(topic, 'unknown') AS topic,
  COALESCE(verified, FALSE) AS verified
FROM reviews""")

SQL["reject_split"] = with_reviews(f"""
SELECT id, reason FROM (
  SELECT id, CASE WHEN topic IS NULL THEN 'missing topic'
                  WHEN {num('rating')} IS NULL THEN 'non-numeric rating' END AS reason
  FROM reviews) WHERE reason IS NOT NULL""")

SQL["text_concat"] = with_reviews("""
SELECT id, concat(title, '. ', body) AS scoring_text, concat_ws(' ', title, body) AS corpus_text
FROM reviews""")

SQL["rating_discrepancy"] = with_enriched("""
SELECT id, rating, text_rating, discrepancy FROM enriched""")

_LABEL = ("CASE WHEN lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) IS NULL "
          "OR lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) IN ('unknown', '', 'error') "
          "THEN 'unknown' ELSE lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')) END")
_TOPICS5 = ", ".join("'" + t + "'" for t in D.TOPICS_FIVE)

SQL["label_normalise"] = with_reviews(f"""
SELECT id, rating_label, topic_label,
  NOT (topic_label IN ({_TOPICS5}) OR topic_label = 'unknown') AS topic_off_list
FROM (SELECT id, {_LABEL.format(x='rating')} AS rating_label,
             {_LABEL.format(x='topic')} AS topic_label FROM reviews)""")

SQL["satisfaction_stars"] = with_enriched("""
SELECT id, COALESCE(rating, text_rating) AS stars,
  CASE WHEN rating IS NOT NULL THEN 'given' WHEN text_rating IS NOT NULL THEN 'inferred' END AS stars_source
FROM enriched""")

SQL["metrics_by_verified"] = with_enriched("""
SELECT verified, COUNT(*) AS n_reviews, round(avg(rating), 6) AS avg_rating,
  round(avg(text_rating), 6) AS avg_text_rating, round(avg(discrepancy), 6) AS avg_discrepancy
FROM enriched GROUP BY verified""")

SQL["rating_over_time"] = with_enriched("""
SELECT CAST(published_at AS DATE) AS day, COUNT(*) AS n_reviews, round(avg(rating), 6) AS avg_rating
FROM enriched GROUP BY 1""")

SQL["source_type_mask"] = with_reviews(f"""
SELECT r.id, r.company, s.type,
  CASE WHEN s.type = 'professional' THEN NULL ELSE r.verified END AS verified,
  CASE WHEN s.type = 'professional' THEN NULL ELSE r.published_date END AS published_date
FROM reviews r LEFT JOIN (
  SELECT DISTINCT company, CASE TRY_CAST(regexp_extract(company, '[0-9]+$') AS BIGINT) % 2
                             WHEN 0 THEN 'user' WHEN 1 THEN 'professional' END AS type FROM reviews) s ON r.company = s.company""")

# --- aggregates -------------------------------------------------------------------------
SQL["avg_text_rating"] = with_enriched("""
SELECT round(avg(text_rating), 6) AS avg_text_rating, COUNT(text_rating) AS scored, COUNT(*) AS total
FROM enriched""")

_COUNTED = ["company", "title", "body", "published_date", "rating", "text_rating", "topic", "verified", "lang"]
SQL["value_counts_all"] = with_reviews(f"""
SELECT column_name, value, COUNT(*) AS frequency FROM (
  UNPIVOT (SELECT {", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _COUNTED)} FROM reviews)
  ON {", ".join(_COUNTED)} INTO NAME column_name VALUE value)
WHERE value IS NOT NULL GROUP BY column_name, value""")

_RATINGS = ["1", "2", "3", "4", "5", "unknown"]
SQL["topic_rating_pivot"] = with_reviews(
    "SELECT topic, " + ", ".join(
        f"COUNT(*) FILTER (WHERE rating = '{v}') AS r_{v}" for v in _RATINGS)
    + " FROM reviews WHERE topic IS NOT NULL GROUP BY topic")

# --- lexicon / text labels --------------------------------------------------------------
CORPUS = "concat_ws(' ', title, body)"
SCORING = "concat(title, '. ', body)"


def polarity_cte(text: str, keys: str = "r.id", lex=D.LEXICON_FIXTURE) -> str:
    return f"""pol AS (
  SELECT {keys}, CAST(COALESCE(SUM(l.weight), 0) AS BIGINT) AS polarity,
    CAST(COALESCE(SUM(abs(l.weight)), 0) AS BIGINT) AS magnitude, COUNT(l.weight) AS hits
  FROM reviews r
  LEFT JOIN (SELECT id, unnest({toks(text)}) AS term FROM reviews) t ON r.id = t.id
  LEFT JOIN {values(lex, 'l')} ON t.term = l.term
  GROUP BY {keys})"""


_PCT = """CAST(100 AS DOUBLE) * count_if(polarity > 0) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE) AS pct_positive,
  CAST(100 AS DOUBLE) * count_if(polarity < 0) / CAST(NULLIF(COUNT(*), 0) AS DOUBLE) AS pct_negative,
  COUNT(*) AS total"""

SQL["sentiment_pct"] = f"WITH {REVIEWS_CTE},\n{polarity_cte(CORPUS)}\nSELECT {_PCT} FROM pol"
SQL["sentiment_pct_by_company"] = (
    f"WITH {REVIEWS_CTE},\n{polarity_cte(CORPUS, 'r.company, r.id')}\n"
    f"SELECT company, {_PCT} FROM pol GROUP BY company")
SQL["sentiment_label"] = (
    f"WITH {REVIEWS_CTE},\n{polarity_cte(SCORING)}\n"
    "SELECT id, CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' "
    "ELSE 'neutral' END AS sentiment FROM pol")
SQL["text_rating_lexicon"] = (
    f"WITH {REVIEWS_CTE},\n{polarity_cte(SCORING)}\n"
    "SELECT id, round(least(5.0::DOUBLE, greatest(1.0::DOUBLE, 3.0::DOUBLE + 2.0::DOUBLE * "
    "CASE WHEN magnitude > 0 THEN CAST(polarity AS DOUBLE) / CAST(magnitude AS DOUBLE) ELSE 0.0::DOUBLE END)), 3)"
    " AS text_rating FROM pol")
SQL["sentiment_disagreement"] = (
    f"WITH {REVIEWS_CTE},\n{polarity_cte(CORPUS, 'r.id, r.rating')}\n"
    f"""SELECT polarity_label, star_label, COUNT(*) AS n_reviews FROM (
  SELECT CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' ELSE 'neutral' END AS polarity_label,
         CASE WHEN {num('rating')} >= 4 THEN 'positive' WHEN {num('rating')} <= 2 THEN 'negative'
              WHEN {num('rating')} IS NOT NULL THEN 'neutral' END AS star_label
  FROM pol) WHERE star_label IS NOT NULL GROUP BY polarity_label, star_label""")


def topics_sql(tax) -> str:
    return f"""WITH {REVIEWS_CTE},
t AS (SELECT id, unnest({toks(SCORING)}) AS term FROM reviews),
s AS (SELECT t.id, x.topic, x.topic_order, CAST(SUM(x.weight) AS BIGINT) AS score
      FROM t JOIN {values(tax, 'x')} ON t.term = x.keyword GROUP BY t.id, x.topic, x.topic_order),
b AS (SELECT id, topic, score FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_order) AS rn FROM s)
      WHERE rn = 1 AND score > 0)
SELECT r.id, COALESCE(b.topic, 'unknown') AS topic, CAST(COALESCE(b.score, 0) AS BIGINT) AS topic_score
FROM reviews r LEFT JOIN b ON r.id = b.id"""


SQL["topic_five_class"] = topics_sql(D.TAXONOMY_FIVE_FIXTURE)
SQL["topic_two_class"] = topics_sql(D.TAXONOMY_TWO_FIXTURE)

_SERVICES = D.Dictionary("services", D.TAXONOMY_FIVE_FIXTURE.schema, tuple(
    row for row in D.TAXONOMY_FIVE_FIXTURE.rows if row[0] in D.SERVICES))
SQL["services_mentioned"] = f"""WITH {REVIEWS_CTE},
t AS (SELECT id, unnest({toks(SCORING)}) AS term FROM reviews)
SELECT id, array_to_string(list_sort(list(DISTINCT x.topic)), ',') AS services
FROM t JOIN {values(_SERVICES, 'x')} ON t.term = x.keyword GROUP BY id"""


def hits_cte(name: str, d, label: str, text: str = CORPUS) -> str:
    return f"""{name} AS (SELECT t.id, x.{label}, COUNT(*) AS hits
  FROM (SELECT id, unnest({toks(text)}) AS term FROM reviews) t
  JOIN {values(d, 'x')} ON t.term = x.keyword GROUP BY t.id, x.{label})"""


SQL["aspect_levels"] = f"""WITH {REVIEWS_CTE},
{polarity_cte(CORPUS)},
{hits_cte('h', D.ASPECTS_FIXTURE, 'aspect')}
SELECT aspect, level, COUNT(*) AS n_reviews FROM (
  SELECT h.aspect, CASE
    WHEN h.aspect = 'price' THEN CASE WHEN p.polarity < 0 THEN 'too high' WHEN p.polarity > 0 THEN 'good' ELSE 'neutral' END
    WHEN h.aspect = 'quality' THEN CASE WHEN p.polarity > 0 THEN 'good' WHEN p.polarity < 0 THEN 'poor' ELSE 'mediocre' END
    ELSE 'reported' END AS level
  FROM h JOIN pol p ON h.id = p.id) GROUP BY aspect, level"""


def _ngrams(max_n: int) -> str:
    parts = []
    for n in range(1, max_n + 1):
        gram = " || ' ' || ".join(f"tk[i + {k}]" for k in range(n))
        parts.append(f"SELECT id, {gram} AS phrase FROM (SELECT id, tk, unnest(range(1, len(tk) - {n - 1} + 1)) AS i FROM tt)")
    return " UNION ALL ".join(parts)


_MAXN = max(len(p.split(" ")) for _, p in D.PHRASES_FIXTURE.rows)
SQL["mention_counts"] = f"""WITH {REVIEWS_CTE},
tt AS (SELECT id, {toks(CORPUS)} AS tk FROM reviews),
g AS ({_ngrams(_MAXN)}),
pr AS (SELECT x.category, g.id, COUNT(*) AS hits FROM g JOIN {values(D.PHRASES_FIXTURE, 'x')}
       ON g.phrase = x.phrase GROUP BY x.category, g.id)
SELECT category, CAST(SUM(hits) AS BIGINT) AS mentions, COUNT(*) AS reviews_mentioning
FROM pr GROUP BY category"""

SQL["emotion_counts"] = f"""WITH {REVIEWS_CTE},
{hits_cte('h', D.EMOTIONS_FIXTURE, 'emotion')}
SELECT emotion, CAST(SUM(hits) AS BIGINT) AS mentions, COUNT(*) AS n_reviews FROM h GROUP BY emotion"""

SQL["product_feedback"] = f"""WITH {REVIEWS_CTE},
{polarity_cte(CORPUS)},
{hits_cte('h', D.PRODUCTS_FIXTURE, 'product')}
SELECT h.product, count_if(p.polarity > 0) AS n_positive, count_if(p.polarity < 0) AS n_negative,
  COUNT(*) AS n_reviews
FROM h JOIN pol p ON h.id = p.id GROUP BY h.product"""


# --- terms, masking, entities ------------------------------------------------------------


def _stop_list() -> str:
    return ", ".join("'" + r[0].replace("'", "''") + "'" for r in D.STOPWORDS_EN.rows)


SQL["top_terms"] = with_reviews(f"""
SELECT term, COUNT(*) AS frequency
FROM (SELECT unnest({toks('body')}) AS term FROM reviews)
WHERE term NOT IN ({_stop_list()})
GROUP BY term ORDER BY frequency DESC, term LIMIT 500""")

def _fit(k: str, n: str, p: str) -> str:
    return f"(ln(greatest({p}, 1e-10)) * ({k}) + ln(greatest(1 - {p}, 1e-10)) * (({n}) - ({k})))"


SQL["term_cloud"] = with_reviews(f""",
tk AS (SELECT {toks('body')} AS tk FROM reviews),
uni AS (SELECT term, COUNT(*) AS n FROM (SELECT unnest(tk) AS term FROM tk) WHERE term NOT IN ({_stop_list()}) GROUP BY term),
form AS (SELECT a.term, COALESCE(b.term, a.term) AS form FROM uni a
         LEFT JOIN uni b ON a.term LIKE '%s' AND a.term NOT LIKE '%ss' AND b.term = substring(a.term, 1, length(a.term) - 1)),
cnt AS (SELECT form AS term, SUM(n)::BIGINT AS n FROM uni JOIN form USING (term) GROUP BY form),
duo AS (SELECT f1.form AS w1, f2.form AS w2, COUNT(*) AS n
        FROM (SELECT tk[i] AS a, tk[i + 1] AS b FROM (SELECT tk, unnest(range(1, len(tk))) AS i FROM tk)) p
        JOIN form f1 ON f1.term = p.a JOIN form f2 ON f2.term = p.b GROUP BY 1, 2),
x AS (SELECT w1, w2, duo.n, duo.n::DOUBLE AS k, a.n::DOUBLE AS n1, b.n::DOUBLE AS n2, (SELECT SUM(n) FROM cnt)::DOUBLE AS t
      FROM duo JOIN cnt a ON a.term = w1 JOIN cnt b ON b.term = w2),
col AS (SELECT w1, w2, n FROM x WHERE t > n1 AND t > n2 AND -2 * (
  {_fit('k', 'n1', '(n2 / t)')} + {_fit('n2 - k', 't - n1', '(n2 / t)')}
  - {_fit('k', 'n1', '(k / n1)')} - {_fit('n2 - k', 't - n1', '((n2 - k) / (t - n1))')}) > 30),
left_ AS (SELECT term, SUM(n)::BIGINT AS frequency FROM (SELECT term, n FROM cnt UNION ALL SELECT w1, -n FROM col UNION ALL SELECT w2, -n FROM col)
          GROUP BY term HAVING SUM(n) > 0)
SELECT * FROM (SELECT term, frequency FROM left_ UNION ALL SELECT w1 || ' ' || w2, n FROM col) ORDER BY frequency DESC, term LIMIT 500""")

SQL["top_bigrams"] = with_reviews(f"""
SELECT w1 || ' ' || w2 AS bigram, COUNT(*) AS frequency FROM (
  SELECT tk[i] AS w1, tk[i + 1] AS w2
  FROM (SELECT tk, unnest(range(1, len(tk))) AS i FROM (SELECT {toks('body')} AS tk FROM reviews)))
WHERE w1 NOT IN ({_stop_list()}) AND w2 NOT IN ({_stop_list()})
GROUP BY w1, w2 ORDER BY frequency DESC, bigram LIMIT 500""")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _mask_chain(expr: str) -> str:
    out = expr
    for label, pattern in _M.DETECTORS:
        out = f"regexp_replace({out}, {_sql_str(pattern)}, {_sql_str(_M.placeholder_for(label))}, 'g')"
    return out


def _gazetteer_mask(expr: str, gaz=D.GAZETTEER_FIXTURE) -> str:
    """Whole words of the gazetteer by their label's placeholder; twice, as neighbours share a border."""
    out = expr
    for label in dict.fromkeys(r[0] for r in gaz.rows):
        if label in _M.KEEP_LABELS:
            continue
        words = "|".join(r[1] for r in gaz.rows if r[0] == label)
        pattern = rf"(?i)(^|[^\p{{L}}\p{{N}}_])(?:{words})([^\p{{L}}\p{{N}}_]|$)"
        for _ in range(2):
            out = f"regexp_replace({out}, {_sql_str(pattern)}, {_sql_str(chr(92) + '1' + _M.placeholder_for(label) + chr(92) + '2')}, 'g')"
    return out


SQL["mask_pii_regex"] = f"SELECT doc_id, {_mask_chain('text')} AS masked FROM documents"


def _entity_counts_sql() -> str:
    cols, cur = [], "text"
    for label, pattern in _M.DETECTORS:
        cols.append(f"len(regexp_extract_all({cur}, {_sql_str(pattern)}, 0)) AS \"{label}\"")
        cur = f"regexp_replace({cur}, {_sql_str(pattern)}, {_sql_str(_M.placeholder_for(label))}, 'g')"
    kinds = sorted({r[0] for r in D.GAZETTEER_FIXTURE.rows})
    for kind in kinds:
        words = ", ".join(_sql_str(r[1]) for r in D.GAZETTEER_FIXTURE.rows if r[0] == kind)
        cols.append(f"len(list_filter(regexp_extract_all(lower({cur}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w IN ({words}))) AS \"{kind}\"")
    labels = ", ".join(f'"{lb}"' for lb in [lb for lb, _ in _M.DETECTORS] + kinds)
    return f"""WITH c AS (SELECT {', '.join(cols)} FROM documents),
u AS (UNPIVOT c ON {labels} INTO NAME label VALUE n)
SELECT label, count_if(n > 0) AS n_docs, CAST(SUM(n) AS BIGINT) AS n_mentions FROM u GROUP BY label"""


SQL["entity_counts"] = _entity_counts_sql()

_GAZ_WORDS = ", ".join(_sql_str(r[1]) for r in D.GAZETTEER_FIXTURE.rows)


def _n_spans(expr: str) -> str:
    parts, cur = [], expr
    for label, pattern in _M.DETECTORS:
        parts.append(f"len(regexp_extract_all({cur}, {_sql_str(pattern)}, 0))")
        cur = f"regexp_replace({cur}, {_sql_str(pattern)}, {_sql_str(_M.placeholder_for(label))}, 'g')"
    parts.append(f"len(list_filter(regexp_extract_all({cur}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w) IN ({_GAZ_WORDS})))")
    return " + ".join(parts)


SQL["phrase_mentions"] = f"""
WITH b AS (SELECT {toks('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n)),
d AS (SELECT doc_id, {toks('text')} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n))
SELECT phrase, COUNT(DISTINCT doc_id) AS n_docs, COUNT(*) AS n_mentions FROM g WHERE phrase IN (SELECT phrase FROM p) GROUP BY phrase"""

def _one_byte(c: str) -> str:
    """DuckDB counts edits of bytes; the letters of the test texts get one byte each (words have no capitals)."""
    return f"translate({c}, 'ßàáâäçèéêëíîïñóôöùúûü', 'ABCDEFGHIJKLMNOPQRSTU')"


SQL["misspelt_terms"] = f"""
WITH t AS (SELECT DISTINCT term FROM (SELECT unnest({toks('text')}) AS term FROM benchmark) WHERE length(term) >= 8),
w AS (SELECT word, COUNT(*) AS n FROM (SELECT unnest({toks('text')}) AS word FROM documents) GROUP BY word)
SELECT term, word, n, levenshtein({_one_byte('term')}, {_one_byte('word')})::INT AS distance FROM t, w
WHERE abs(length(term) - length(word)) <= 2 AND levenshtein({_one_byte('term')}, {_one_byte('word')}) <= 2"""

SQL["missing_input"] = """SELECT 'documents' AS name, COUNT(*) AS n, true AS found FROM documents
UNION ALL SELECT 'no_such_table', 0, false UNION ALL SELECT 'labels', COUNT(*), true FROM labels"""
SQL["strict_cast"] = with_reviews(f"""
SELECT SUM(CASE WHEN {num('rating')} IS NOT NULL THEN CAST(rating AS DOUBLE) END) AS total, COUNT({num('rating')}) AS n_cast,
  COUNT(*) FILTER ({num('rating')} IS NULL) AS n_refused FROM reviews""")

def _role(role: str) -> str:
    return ", ".join(_sql_str(w) for r, w in _CX.ROLES_FIXTURE.rows if r == role)


_STATE = "{{'c': {c}, 's': {s}, 'f': {f}, 'p': {p}, 'm': {m}, 'n': {n}}}"
_KEPT = {"p": "a.p", "m": "a.m", "n": "a.n"}
SQL["polarity_in_context"] = with_reviews(rf""",
x AS (SELECT id, list_filter(list_transform(regexp_extract_all(lower({CORPUS}), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_'']+|[.,;:!?\n]'), lambda x: CASE
    WHEN x IN ('.', ',', ';', ':', '!', '?', chr(10), {_role('contrast')}) THEN 100 WHEN x IN ({_role('negator')}) OR x LIKE '%n''t' THEN 101
    WHEN x IN ({_role('stronger')}) THEN 102 WHEN x IN ({_role('weaker')}) THEN 103
    {' '.join(f"WHEN x = {_sql_str(t)} THEN {w}" for t, w in D.LEXICON_FIXTURE.rows)} END), lambda c: c IS NOT NULL) AS codes FROM reviews),
y AS (SELECT id, list_reduce(list_prepend({_STATE.format(c=0, s=1, f=2, p='0::BIGINT', m='0::BIGINT', n='0::BIGINT')},
    list_transform(codes, lambda c: {_STATE.format(c='c::INT', s=1, f=2, p='0::BIGINT', m='0::BIGINT', n='0::BIGINT')})), lambda a, b: CASE b.c
    WHEN 100 THEN {_STATE.format(c=0, s=1, f=2, **_KEPT)} WHEN 101 THEN {_STATE.format(c=0, s='-a.s', f='a.f', **_KEPT)}
    WHEN 102 THEN {_STATE.format(c=0, s='a.s', f=4, **_KEPT)} WHEN 103 THEN {_STATE.format(c=0, s='a.s', f=1, **_KEPT)}
    ELSE {_STATE.format(c=0, s='a.s', f=2, p='a.p + a.s * a.f * b.c', m='a.m + abs(a.f * b.c)', n='a.n + (a.s < 0)::INT')} END) AS r FROM x)
SELECT id, r.p::BIGINT AS polarity, r.m::BIGINT AS magnitude, r.n::BIGINT AS n_negated FROM y""")

SQL["mask_spans"] = f"""SELECT doc_id, CAST({_n_spans('text')} AS INT) AS n_spans,
  {_gazetteer_mask(_mask_chain('text'))} AS masked FROM documents"""

# --- chunking, indexing, retrieval -------------------------------------------------------
_CHUNKS = """SELECT doc_id, source, CAST(i AS INT) AS chunk_pos, substring(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS text
  FROM (SELECT doc_id, source, text,
          unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS i
        FROM documents)"""

SQL["chunk_fixed"] = f"SELECT doc_id, chunk_pos, text FROM ({_CHUNKS})"

SQL["batch_assign"] = f"""
SELECT source, doc_id, chunk_pos, idx, CAST(floor(idx / 100) AS BIGINT) AS batch_id FROM (
  SELECT source, doc_id, chunk_pos,
    CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_pos) - 1 AS BIGINT) AS idx
  FROM ({_CHUNKS}))"""

_CENTROIDS = """q AS (
  SELECT CAST(label AS BIGINT) AS question_id, list(m ORDER BY pos) AS qv FROM (
    SELECT label, pos, avg(v) AS m FROM (
      SELECT label, unnest(generate_series(1, len(embedding))) AS pos,
             unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings)
    GROUP BY label, pos)
  GROUP BY label)"""


def _knn_sql(per_batch: bool) -> str:
    part = "batch_id, " if per_batch else ""
    return f"""WITH {_CENTROIDS},
e AS (SELECT vec_id, CAST(floor(vec_id / 100) AS BIGINT) AS batch_id, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings),
d AS (SELECT e.batch_id, q.question_id, e.vec_id,
        list_reduce(list_transform(range(1, len(e.ev) + 1), lambda i: (e.ev[i] - q.qv[i]) * (e.ev[i] - q.qv[i])),
                    lambda a, b: a + b) AS distance
      FROM e, q)
SELECT {part}question_id, CAST(rank AS INT) AS rank, vec_id, round(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY {part}question_id ORDER BY distance, vec_id) AS rank FROM d)
WHERE rank <= 4"""


SQL["knn_per_batch"] = _knn_sql(True)
SQL["knn_global"] = _knn_sql(False)
SQL["knn_pruned"] = SQL["knn_global"]

SQL["stuff_context"] = f"""WITH nn AS ({_knn_sql(True)})
SELECT nn.batch_id, nn.question_id, string_agg(d.text, chr(10) || chr(10) ORDER BY nn.rank) AS context
FROM nn JOIN documents d ON nn.vec_id = d.doc_id GROUP BY nn.batch_id, nn.question_id"""

SQL["gather_by_key"] = """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined, COUNT(*) AS n_parts
FROM conversations GROUP BY conv_id"""

SQL["prompt_messages"] = with_reviews(" UNION ALL ".join(f"""
SELECT id, '{name}' AS template, 0 AS msg_pos, 'system' AS role, {_sql_str(rules)} AS content FROM reviews
UNION ALL
SELECT id, '{name}' AS template, 1 AS msg_pos, 'user' AS role, concat(title, '. ', body) AS content FROM reviews"""
                                                     for name, rules in _PR.TEMPLATES.items()))

# --- pages and stores --------------------------------------------------------------------
SQL["page_take_while"] = """
WITH p AS (
  SELECT conv_id, CAST(turn + 1 AS INT) AS page, max(length(text)) > 1500 AS bad
  FROM conversations WHERE turn + 1 >= 1 AND turn + 1 < 100 GROUP BY conv_id, turn),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) <> page AS gap FROM p),
s AS (SELECT *, min(CASE WHEN bad OR gap THEN page END) OVER (PARTITION BY conv_id) AS stop FROM g)
SELECT conv_id, CAST(page - 1 AS BIGINT) AS turn FROM s WHERE stop IS NULL OR page < stop"""

SQL["page_bound_stream"] = """
WITH p AS (
  SELECT conv_id, CAST(turn + 1 AS INT) AS page,
    NOT bool_or(COALESCE(length(text) <= 1500, TRUE)) AS bad,
    max(length(text)) FILTER (length(text) <= 1500) AS n_chars
  FROM conversations WHERE turn + 1 >= 1 AND turn + 1 < 100 GROUP BY conv_id, turn),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page) <> page AS gap FROM p),
s AS (SELECT *, min(CASE WHEN bad OR gap THEN page END) OVER (PARTITION BY conv_id) AS stop FROM g)
SELECT conv_id, CAST(page - 1 AS BIGINT) AS turn, CAST(n_chars AS INT) AS n_chars FROM s WHERE stop IS NULL OR page < stop"""

SQL["next_data_reviews"] = with_reviews("""
SELECT company, CAST(floor(CAST(id AS BIGINT) / 20) + 1 AS INT) AS page, id,
  COALESCE(title, 'No Title') AS title, COALESCE(body, 'No Review Body') AS body,
  CAST(published_date AS VARCHAR) || 'T00:00:00.000Z' AS published,
  COALESCE(rating, 'unknown') AS rating_raw, COALESCE(verified, FALSE) AS verified
FROM reviews""")

_ALL = "id, company, title, body, published_date, rating, text_rating, topic, verified, lang"
SQL["reviews_csv_roundtrip"] = with_reviews(f"SELECT {_ALL} FROM reviews")
SQL["reviews_json_roundtrip"] = with_reviews(f"SELECT {_ALL} FROM reviews")
SQL["append_union_all"] = with_reviews(
    f"SELECT {_ALL} FROM reviews UNION ALL SELECT {_ALL} FROM reviews")

SQL["dedupe_latest"] = with_reviews("""
, both_copies AS (
  SELECT company, id, title, body, published_date FROM reviews
  UNION ALL
  SELECT company, id, title || ' (edited)' AS title, body,
    CAST(published_date + CAST(length(body) % 3 - 1 AS INT) AS DATE) AS published_date FROM reviews)
SELECT company, id, title, published_date FROM (
  SELECT *, row_number() OVER (PARTITION BY company, id
    ORDER BY published_date DESC, sha256(concat_ws(chr(1), COALESCE(title, ''), COALESCE(body, ''))) DESC) AS rn
  FROM both_copies) WHERE rn = 1""".replace("\n, both_copies", ",\nboth_copies", 1))

# --- flagship ----------------------------------------------------------------------------
SQL["company_summary"] = f"""WITH {ENRICHED_CTE},
{polarity_cte(CORPUS, 'r.company, r.id').replace('FROM reviews r', 'FROM enriched r').replace('FROM reviews)', 'FROM enriched)')},
pc AS (SELECT company, {_PCT} FROM pol GROUP BY company),
ra AS (SELECT company, round(avg(text_rating), 6) AS avg_text_rating,
              round(avg(discrepancy), 6) AS avg_discrepancy FROM enriched GROUP BY company),
tc AS (SELECT company, topic, COUNT(*) AS n FROM enriched WHERE topic IS NOT NULL GROUP BY company, topic),
tt AS (SELECT company, topic AS top_topic FROM (
         SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, topic) AS rn FROM tc) WHERE rn = 1)
SELECT company, total, round(pct_positive, 6) AS pct_positive, round(pct_negative, 6) AS pct_negative,
  avg_text_rating, avg_discrepancy, top_topic
FROM pc FULL JOIN ra USING (company) LEFT JOIN tt USING (company)"""

_TR = ("round(least(5.0::DOUBLE, greatest(1.0::DOUBLE, 3.0::DOUBLE + 2.0::DOUBLE * "
       "CASE WHEN p.magnitude > 0 THEN CAST(p.polarity AS DOUBLE) / CAST(p.magnitude AS DOUBLE) "
       "ELSE 0.0::DOUBLE END)), 3)")

SQL["ingest_reviews"] = f"""WITH {REVIEWS_CTE},
{polarity_cte(SCORING)},
tk AS (SELECT id, unnest({toks(SCORING)}) AS term FROM reviews),
ts AS (SELECT tk.id, x.topic, x.topic_order, CAST(SUM(x.weight) AS BIGINT) AS score
       FROM tk JOIN {values(D.TAXONOMY_FIVE_FIXTURE, 'x')} ON tk.term = x.keyword
       GROUP BY tk.id, x.topic, x.topic_order),
tb AS (SELECT id, topic FROM (
         SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_order) AS rn FROM ts)
       WHERE rn = 1 AND score > 0)
SELECT r.company, r.id, {_gazetteer_mask(_mask_chain('r.title'))} AS title, {_gazetteer_mask(_mask_chain('r.body'))} AS body,
  CAST(r.published_date AS TIMESTAMP) AS published_at, r.rating AS rating_raw,
  {num('r.rating')} AS rating, {_TR} AS text_rating, abs({_TR} - {num('r.rating')}) AS discrepancy,
  CAST(floor(CAST(r.id AS BIGINT) / 20) + 1 AS INT) AS page,
  CASE WHEN p.polarity > 0 THEN 'positive' WHEN p.polarity < 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
  COALESCE(tb.topic, 'unknown') AS topic, r.verified
FROM reviews r JOIN pol p ON r.id = p.id LEFT JOIN tb ON r.id = tb.id"""

# streaming: the final state of the update-mode daily counts equals the batch aggregate
SQL["stream_daily_counts"] = """
SELECT date_trunc('day', ts) AS day, event_type, COUNT(*) AS n, round(SUM(value), 6) AS total_value
FROM events GROUP BY 1, 2"""

# scoring job with the stub scorer: label by word counts; texts whose SHA-256 ends in 0 fail
_WORDS = "string_split_regex(lower(concat(title, '. ', body)), '\\s+')"
SQL["score_with_stub"] = with_reviews(f"""
SELECT id,
  CASE WHEN right(sha256(concat(title, '. ', body)), 1) = '0' THEN NULL
       WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS value,
  CASE WHEN right(sha256(concat(title, '. ', body)), 1) = '0'
       THEN 'RuntimeError: scorer rejected input' END AS error
FROM (SELECT id, title, body,
        len(list_filter({_WORDS}, lambda w: w IN ('the', 'la'))) AS pos,
        len(list_filter({_WORDS}, lambda w: w IN ('of', 'der'))) AS neg
      FROM reviews)""")

SQL["by_company_counts"] = with_reviews(f"""
SELECT c.company, g.base_url, lower(replace(c.company, ' ', '_')) AS slug, c.n_reviews
FROM (SELECT company, COUNT(*) AS n_reviews FROM reviews GROUP BY company) c
LEFT JOIN (SELECT DISTINCT company, concat('https://reviews.example/review/', company) AS base_url FROM reviews) g
  ON c.company = g.company""")

SQL["value_counts_top"] = with_reviews("""
SELECT column_name, value, frequency, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY frequency DESC, value) AS rank FROM (
    SELECT column_name, value, COUNT(*) AS frequency FROM (
      UNPIVOT (SELECT CAST(rating AS VARCHAR) AS rating, CAST(topic AS VARCHAR) AS topic,
                      CAST(lang AS VARCHAR) AS lang, CAST(company AS VARCHAR) AS company,
                      CAST(title AS VARCHAR) AS title FROM reviews)
      ON rating, topic, lang, company, title INTO NAME column_name VALUE value)
    WHERE value IS NOT NULL GROUP BY column_name, value))
WHERE rank <= 5""")

SQL["rating_scatter"] = with_enriched("SELECT id, published_at, rating FROM enriched")

SQL["product_ranking"] = f"""WITH p AS ({SQL["product_feedback"]}),
s AS (SELECT product, 'positive' AS side, n_positive AS n_reviews FROM p
      UNION ALL SELECT product, 'negative' AS side, n_negative AS n_reviews FROM p)
SELECT product, side, n_reviews, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY side ORDER BY n_reviews DESC, product) AS rank FROM s) WHERE rank <= 3"""

# Rows of the view united with itself are told apart by a number, not by their ids.
SQL["sentiment_pct_repeated"] = f"""WITH {REVIEWS_CTE},
twice AS (SELECT row_number() OVER () AS n, company, {CORPUS} AS t
          FROM (SELECT * FROM reviews UNION ALL SELECT * FROM reviews)),
pol AS (SELECT r.n, r.company, CAST(COALESCE(SUM(l.weight), 0) AS BIGINT) AS polarity
        FROM twice r LEFT JOIN (SELECT n, unnest({toks('t')}) AS term FROM twice) t ON r.n = t.n
        LEFT JOIN {values(D.LEXICON_FIXTURE, 'l')} ON t.term = l.term GROUP BY r.n, r.company)
SELECT company, {_PCT} FROM pol GROUP BY company"""

SQL["ingest_repeated_pages"] = f"""WITH one AS ({SQL["ingest_reviews"]})
SELECT company, id, page, text_rating, sentiment, topic FROM one
UNION ALL SELECT company, id, NULL AS page, text_rating, sentiment, topic FROM one"""

_LABELLED = f"""SELECT id, CASE WHEN pos > neg THEN 'positive' WHEN neg > pos THEN 'negative' ELSE 'neutral' END AS value
FROM (SELECT id, len(list_filter({_WORDS}, lambda w: w IN ('the', 'la'))) AS pos,
        len(list_filter({_WORDS}, lambda w: w IN ('of', 'der'))) AS neg FROM reviews)"""
SQL["score_with_retry"] = with_reviews(f"SELECT id, value, CAST(NULL AS VARCHAR) AS error FROM ({_LABELLED})")
SQL["score_within_rate"] = SQL["score_with_retry"]
SQL["score_coverage"] = f"""SELECT COUNT(value) AS n_scored, COUNT(error) AS n_failed, COUNT(*) AS n_rows
FROM ({SQL["score_with_stub"]})"""

SQL["knn_lsh"] = """SELECT DISTINCT CAST(label AS BIGINT) AS question_id, CAST(4 AS BIGINT) AS n_found, TRUE AS recall_ok FROM embeddings"""

# --- hashed vectors and the question chain ------------------------------------------------
DIM = 256


def _vectors(source: str, id_col: str, text: str, name: str) -> str:
    """``name``(id, embedding): unit vectors of term counts by the leading MD5 digits."""
    return f"""{name}_t AS (SELECT {id_col} AS id, unnest({toks(text)}) AS term FROM {source}),
{name}_c AS (SELECT id, CAST('0x' || substring(md5(term), 1, 8) AS BIGINT) % {DIM} AS b, COUNT(*)::DOUBLE AS n
  FROM {name}_t GROUP BY 1, 2),
{name}_m AS (SELECT id, map_from_entries(list((b, n))) AS m, sqrt(SUM(n * n)) AS norm FROM {name}_c GROUP BY id),
{name} AS (SELECT s.{id_col} AS id, list_transform(range({DIM}),
    lambda b: COALESCE(m.m[b] / m.norm, 0.0::DOUBLE)) AS embedding
  FROM {source} s LEFT JOIN {name}_m m ON s.{id_col} = m.id)"""


SQL["hashed_vectors"] = f"""WITH {REVIEWS_CTE},
corpus AS (SELECT id, {CORPUS} AS t FROM reviews),
{_vectors('corpus', 'id', 't', 'v')}
SELECT id, embedding FROM v"""


def _answers(questions: list[str]) -> str:
    q = values(D.questions_table(questions), "q0")
    return f"""WITH {REVIEWS_CTE},
ch AS (SELECT id, id || ':' || CAST(i AS VARCHAR) AS chunk_id, i, substring(t, CAST(i * 800 + 1 AS BIGINT), 1000) AS t FROM (
  SELECT id, {CORPUS} AS t, unnest(range(0, greatest(1, CAST(ceil((length({CORPUS}) - 200) / 800.0) AS BIGINT)))) AS i FROM reviews)),
ix AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY id, i) - 1) / 100) AS BIGINT) AS batch_id FROM ch),
qs AS (SELECT question_id, question FROM {q}),
{_vectors('ch', 'chunk_id', 't', 'cv')},
{_vectors('qs', 'question_id', 'question', 'qv')},
d AS (SELECT ix.batch_id, qv.id AS question_id, ix.chunk_id, ix.t,
        round(list_reduce(list_transform(range(1, {DIM} + 1),
          lambda j: (cv.embedding[j] - qv.embedding[j]) * (cv.embedding[j] - qv.embedding[j])), lambda a, b: a + b), 9) AS distance
      FROM ix JOIN cv ON ix.chunk_id = cv.id, qv),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, question_id ORDER BY distance, chunk_id) AS rank FROM d)
       WHERE rank <= 4),
st AS (SELECT batch_id, question_id, rank, unnest(parts) AS sentence, unnest(range(len(parts))) AS pos FROM (
  SELECT batch_id, question_id, rank,
    string_split_regex(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+') AS parts FROM nn)),
sc AS (SELECT st.*, len(list_intersect(list_distinct({toks('sentence')}), list_distinct({toks('qs.question')}))) AS score
       FROM st JOIN qs ON st.question_id = qs.question_id WHERE length(trim(sentence)) > 0),
answers AS (SELECT batch_id, question_id, CASE WHEN score > 0 THEN sentence END AS answer, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, question_id ORDER BY score DESC, rank, pos) AS rn FROM sc) WHERE rn = 1)"""


def _picked(src: str, n: int, out: str) -> str:
    """``out``: per (q, b) the ``n`` sentences that graph ranks and likeness pick from ``src`` (q, b, pos, s, w)."""
    d, steps, least, balance = SM.DAMPING, SM.STEPS, SM.LEAST, SM.BALANCE
    return f"""
{out}_g AS (SELECT q, b, list(pos ORDER BY pos) AS ps, list(s ORDER BY pos) AS ss, list(w::DOUBLE ORDER BY pos) AS ws, list(t ORDER BY pos) AS ts,
            count(*)::INT AS n, sum(w)::DOUBLE AS total FROM (
  SELECT *, list_filter(list_distinct({toks('s')}), lambda x: NOT list_contains([{_stop_list()}], x)) AS t FROM {src}) GROUP BY q, b),
{out}_l AS (SELECT *, list_transform(ws, lambda x: x / total) AS p, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
    CASE WHEN i = j OR len(ts[i]) = 0 OR len(ts[j]) = 0 THEN 0.0::DOUBLE ELSE (
      CASE WHEN round(len(list_intersect(ts[i], ts[j])) / sqrt(len(ts[i])::DOUBLE * len(ts[j])), 9) >= {least}
           THEN round(len(list_intersect(ts[i], ts[j])) / sqrt(len(ts[i])::DOUBLE * len(ts[j])), 9) ELSE 0.0::DOUBLE END) END)) AS m FROM {out}_g),
{out}_f AS (SELECT *, list_transform(range(1, n + 1), lambda j: list_sum(list_transform(range(1, n + 1), lambda k: m[j][k] * ws[k]))) AS sums FROM {out}_l),
{out}_t AS (SELECT *, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j:
    CASE WHEN sums[j] > 0 THEN m[j][i] * ws[i] / sums[j] ELSE p[i] END)) AS mv FROM {out}_f),
{out}_r AS (SELECT q, b, 0 AS step, p AS r FROM {out}_t UNION ALL
  SELECT x.q, x.b, step + 1, list_transform(range(1, n + 1), lambda i: {1 - d} * p[i] + {d} * list_dot_product(mv[i], r))
  FROM {out}_r x JOIN {out}_t y ON x.q = y.q AND x.b = y.b WHERE step < {steps}),
{out}_k AS (SELECT y.*, list_transform(r, lambda v: round(v / list_max(r), 6)) AS rk FROM {out}_r x JOIN {out}_t y ON x.q = y.q AND x.b = y.b
            WHERE step = {steps}),
{out}_v AS (SELECT q, b, []::INT[] AS picked, list_transform(rk, lambda v: round({balance} * v, 6)) AS v FROM {out}_k UNION ALL
  SELECT q, b, picked, list_transform(range(1, n + 1), lambda i: CASE WHEN list_contains(picked, i) THEN -9.0 ELSE
    round({balance} * rk[i] - {1 - balance:.1f} * list_max(list_transform(picked, lambda j: m[i][j])), 6) END) AS v
  FROM (SELECT y.*, list_append(x.picked, list_position(x.v, list_max(x.v))::INT) AS picked
        FROM {out}_v x JOIN {out}_k y ON x.q = y.q AND x.b = y.b WHERE len(x.picked) < least({n}, y.n))),
{out} AS (SELECT q, b, ps[i] AS pos, ss[i] AS s, ws[i]::BIGINT AS w FROM (
  SELECT y.*, unnest(x.picked) AS i FROM {out}_v x JOIN {out}_k y ON x.q = y.q AND x.b = y.b WHERE len(x.picked) = least({n}, y.n)))"""


def _summary(levels: int = 4) -> str:
    """CTEs that end in ``sm``; as many levels as the table needs, the rest pass on."""
    block, keep, length = (_SUMMARY_BLOCKS[x] for x in ("block", "keep", "length"))
    fan = max(2, block // keep)
    parts = [f"""l0 AS (SELECT question_id AS q, floor(min(batch_id) / {block})::BIGINT AS b, min(batch_id) AS pos, answer AS s, count(*) AS w
  FROM answers WHERE answer IS NOT NULL GROUP BY question_id, answer)"""]
    for k in range(levels):
        parts += [_picked(f"l{k}", keep, f"p{k}"), f"""
l{k + 1} AS (SELECT q, floor(b / {fan})::BIGINT AS b, pos, s, w FROM p{k} WHERE (SELECT max(b) FROM l{k}) > 0
  UNION ALL SELECT q, b, pos, s, w FROM l{k} WHERE (SELECT max(b) FROM l{k}) = 0)"""]
    return ",".join([*parts, _picked(f"l{levels}", length, "pz")]) + """,
sm AS (SELECT a.question_id, coalesce(t.summary, '') AS summary, a.n_batches, a.n_answered
       FROM (SELECT question_id, COUNT(*) AS n_batches, COUNT(answer) AS n_answered FROM answers GROUP BY question_id) a
       LEFT JOIN (SELECT q, string_agg(s, ' ' ORDER BY pos) AS summary FROM pz GROUP BY q) t ON t.q = a.question_id)"""


SQL["answer_extractive"] = _answers(D.REPORT_QUESTIONS) + "\nSELECT batch_id, question_id, answer, score FROM answers"
_SM = _summary()
_RECURSIVE = lambda sql: sql.replace("WITH ", "WITH RECURSIVE ", 1)
SQL["summary_extractive"] = _RECURSIVE(_answers(D.REPORT_QUESTIONS)) + f",\n{_SM} SELECT * FROM sm"
SQL["summary_old_questions"] = _RECURSIVE(_answers(D.REPORT_QUESTIONS_OLD)) + f",\n{_SM} SELECT * FROM sm"

SQL["report_sections"] = _RECURSIVE(_answers(D.REPORT_QUESTIONS)) + f""",
{polarity_cte(CORPUS)},
h AS (SELECT {_PCT} FROM pol),
tr AS (SELECT avg(v) AS a, COUNT(v) AS scored, COUNT(*) AS total FROM (
         SELECT round({num('text_rating')}, 3) AS v FROM reviews)),
{_SM}
SELECT 0 AS part, 0::BIGINT AS section_order, 0 AS level, 'Analytical Report' AS heading, '' AS text
UNION ALL SELECT 0, 1, 1, 'Executive Summary', printf('This report evaluates %d customer reviews of the company.', total) FROM h
UNION ALL SELECT 0, 2, 2, 'Sentiment Analysis',
  format('Positive Reviews: {{:.2f}}%', pct_positive) || chr(10) || format('Negative Reviews: {{:.2f}}%', pct_negative) FROM h
UNION ALL SELECT 1, sm.question_id, 1, qs.question, summary || CASE WHEN n_answered < n_batches
  THEN printf(' (answered in %d of %d batches)', n_answered, n_batches) ELSE '' END FROM sm JOIN qs ON sm.question_id = qs.question_id
UNION ALL SELECT 2, 0, 2, 'Overall Rating', format('Average inferred rating: {{:.3f}}', a)
  || printf(' (scored %d of %d reviews)', scored, total) FROM tr
UNION ALL SELECT 2, 1, 2, 'Charts', 'Inputs: top_terms (term cloud), rating_topic_freq (bar chart).'"""

# one micro-batch: every user once
SQL["stream_dedupe"] = "SELECT DISTINCT user_id FROM events"
