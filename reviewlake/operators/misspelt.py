"""Misspelt dictionary terms: all words within an edit distance of a term, by deletion neighbourhoods.

Two strings within distance d share a string that each of them becomes by at most d deletions. Terms and distinct
words list these variants (as 64-bit hashes), meet on equal ones, and the exact distance judges each pair. Words
are counted before anything is joined, so a common word is one row; words too long or too short for every term
never list variants, so their number is bounded by the longest term. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.session import stored

DISTANCE = 2


def _less_one(w: Column) -> Column:
    """Every string that lacks one character of ``w``."""
    places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))


def deletions(word: Column, distance: int = DISTANCE) -> Column:
    """Hashes of all strings that ``word`` becomes by at most ``distance`` deletions, itself included."""
    level, every = F.array(word), [F.array(word)]
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, _less_one)))
        every.append(level)
    return F.array_distinct(F.transform(F.concat(*every), lambda x: F.xxhash64(x)))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) of all texts."""
    return docs.select(F.explode(T.tokens(text_col)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def near_terms(words: DataFrame, terms: DataFrame, distance: int = DISTANCE, term_col: str = "term") -> DataFrame:
    """(term, word, n, distance) of every pair within ``distance``; ``words``: (word, n), each word once. Terms are
    compared in lower case; null and empty ones match nothing."""
    named = stored(terms.select(F.lower(F.col(term_col).cast("string")).alias("term")).where("term <> ''").distinct(), "terms")
    size = named.agg(F.min(F.length("term")), F.max(F.length("term"))).first()
    low, high = (size[0] or 0) - distance, (size[1] or -distance - 1) + distance
    able = words.where(F.length("word").between(low, high)).select("word", "n", F.explode(deletions(F.col("word"), distance)).alias("v"))
    keyed = named.select("term", F.explode(deletions(F.col("term"), distance)).alias("v"))
    pairs = able.join(keyed, "v").where(F.abs(F.length("word") - F.length("term")) <= distance)
    near = pairs.withColumn("distance", F.levenshtein("word", "term")).where(F.col("distance") <= distance)
    # a pair meets on each variant that both have
    return near.groupBy("term", "word").agg(F.max("n").alias("n"), F.max("distance").alias("distance"))


def tolerant_mentions(docs: DataFrame, text_col: str, terms: DataFrame, distance: int = DISTANCE, term_col: str = "term") -> DataFrame:
    """(term, n_exact, n_near): occurrences of each term as written, and of words near it that are no term themselves."""
    found = stored(near_terms(word_counts(docs, text_col), terms, distance, term_col), "near-terms")
    exact = found.where("distance = 0").select(F.col("term").alias("word"))
    near = found.where("distance > 0").join(exact, "word", "left_anti").select("term", F.lit(0).cast("bigint").alias("e"), F.col("n").alias("m"))
    both = near.unionByName(found.where("distance = 0").select("term", F.col("n").alias("e"), F.lit(0).cast("bigint").alias("m")))
    return both.groupBy("term").agg(F.sum("e").alias("n_exact"), F.sum("m").alias("n_near"))
