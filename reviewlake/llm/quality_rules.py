"""Quality rules: a threshold table compiled into one projection.

Every rule is a ratio of counts that one pass over a text gives (length,
symbols, stop words, lines); the table of bounds becomes one boolean
expression, so the whole filter is one map stage of built-in functions: no
shuffle, no user function.

Defined results: a null or empty text has no words and fails the base rule;
a null doc_id is passed on; repeated rows are scored one by one; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, whole_text, words_of

WINDOW = 5

# Frequent function words of the languages covered.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "by", "be"],
    "fr": ["de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "qui", "dans", "par", "pour", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "nicht", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una"],
}


@dataclass(frozen=True)
class Rule:
    """Keep a document when ``low <= numerator / denominator <= high`` (counts by name).

    ``from_words``: the rule binds only documents of at least so many words, where a
    ratio means something.
    """

    name: str
    numerator: str
    denominator: str = "one"
    low: float | None = None
    high: float | None = None
    from_words: int = 0


RULES = (
    Rule("words", "n_words", high=1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.3),
    Rule("exclamations_per_word", "n_exclamations", "n_words", high=0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", low=0.02, from_words=50),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_line_ratio", "n_bullet_lines", "n_lines", high=0.9, from_words=50),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", high=0.5, from_words=50),
)


def counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
           stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """Per document: every count that a rule may name."""
    stops = sorted({w for ws in stop_words.values() for w in ws})
    t = F.col("_t")
    d = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("_t"))
    d = d.withColumn("_w", words_of(t)).withColumn("_l", F.filter(
        F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    w, n = F.col("_w"), F.size("_w")
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW),
                        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    d = d.withColumn("_g", F.when(n >= WINDOW, grams).otherwise(none))
    # Most texts repeat no window: only the others are sorted.
    d = d.withColumn("_p", F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col("_p")
    starts = F.sort_array(F.transform(F.filter(p, lambda x, j: (
        (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"]))), lambda x: x["i"]))
    d = d.withColumn("_s", F.coalesce(starts, F.array().cast("array<int>")))
    s = F.col("_s")
    covered = F.aggregate(
        F.transform(s, lambda q, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - q, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.col("_l")
    long = lambda c: c.cast("long")
    return d.select(
        "doc_id",
        long(n).alias("n_words"),
        long(F.length(F.regexp_replace(t, SPACE_CLASS + "+", ""))).alias("word_chars"),
        long(F.regexp_count(t, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        long(F.regexp_count(t, F.lit("!"))).alias("n_exclamations"),
        long(F.size(F.filter(w, lambda x: F.lower(x).isin(stops)))).alias("n_stop_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^[-*•]")))).alias("n_bullet_lines"),
        long(F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…")))).alias("n_ellipsis_lines"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the counts."""
    keep = F.lit(True)
    for r in rules:
        over = F.lit(1) if r.denominator == "one" else F.greatest(F.col(r.denominator), F.lit(1))
        value = F.col(r.numerator) / over
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (value >= r.low)
        if r.high is not None:
            ok = ok & (value <= r.high)
        keep = keep & (ok if not r.from_words else ok | (F.col("n_words") < r.from_words))
    return keep


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts, ``base_failed`` and ``kept`` of every document."""
    return counts(docs, text, doc_id).withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules))
