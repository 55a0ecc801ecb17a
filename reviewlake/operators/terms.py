"""Term-cloud inputs: most frequent terms and bigrams over whole review bodies.

One exploded token stream, an anti-join against a broadcast stop-word set, a
hash aggregate (partial + final, so a very frequent word is combined map-side),
and a TakeOrderedAndProject for the top-k.  Ties are broken by the term so the
top-k is deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions import text as T
from reviewlake.operators.joins import small_side
from reviewlake.session import stored

# Fixed value: size of the term cloud.
TERM_CLOUD_SIZE = 500
# Fixed value: likelihood ratio from which neighbours are one term.
COLLOCATION_THRESHOLD = 30.0
#: Stop words that may stand in the plan; a longer list is joined after counting.
MAX_LITERAL_STOPWORDS = 10_000


def term_counts(spark: SparkSession, docs: DataFrame, text_col, stopwords=D.STOPWORDS_EN) -> DataFrame:
    stop = small_side(spark, stopwords)
    ex = docs.select(F.explode(T.tokens(text_col)).alias("term"))
    return (ex.join(stop, "term", "left_anti")
            .groupBy("term").agg(F.count(F.lit(1)).alias("frequency")))


def top_terms(spark: SparkSession, docs: DataFrame, text_col, k: int = TERM_CLOUD_SIZE,
              stopwords=D.STOPWORDS_EN) -> DataFrame:
    counts = term_counts(spark, docs, text_col, stopwords)
    return counts.orderBy(F.desc("frequency"), F.asc("term")).limit(k)


def plural_forms(counts: DataFrame) -> DataFrame:
    """(term, form): terms ending in one 's' have the form without it, where that occurs too."""
    plural = F.col("term").endswith("s") & ~F.col("term").endswith("ss")
    stem = F.when(plural, F.expr("substring(term, 1, length(term) - 1)"))
    known = counts.select(F.col("term").alias("_stem"))
    j = counts.select("term").withColumn("_s", stem).join(known, F.col("_s") == F.col("_stem"), "left")
    return j.select("term", F.coalesce("_stem", "term").alias("form"))


def adjacent_pairs(toks) -> F.Column:
    """ARRAY<STRUCT<w1, w2>> of neighbouring tokens (empty for fewer than two)."""
    n = F.greatest(F.size(toks) - F.lit(1), F.lit(0))
    return F.arrays_zip(F.slice(toks, 1, n).alias("w1"), F.slice(toks, 2, n).alias("w2"))


def likelihood_ratio(both, first, second, total) -> F.Column:
    """Log-likelihood ratio of a pair that occurs ``both`` times, of words that occur ``first`` and ``second``
    times among ``total``: how much better its own rate explains it than the second word's. 0 where a word is all."""
    both, first, second, total = (F.col(c).cast("double") if isinstance(c, str) else c for c in (both, first, second, total))

    def fit(k, n, p):
        return F.log(F.greatest(p, F.lit(1e-10))) * k + F.log(F.greatest(1 - p, F.lit(1e-10))) * (n - k)
    rest = total - first
    # a word may stand in more pairs than it has occurrences of its own only if the counts do not belong together
    p, p1, p2 = second / total, both / first, (second - both) / rest
    ratio = -2 * (fit(both, first, p) + fit(second - both, rest, p) - fit(both, first, p1) - fit(second - both, rest, p2))
    return F.when((total > first) & (total > second), ratio).otherwise(0.0)


def collocations(pairs: DataFrame, counts: DataFrame, threshold: float = COLLOCATION_THRESHOLD) -> DataFrame:
    """(w1, w2, frequency) of the pairs whose likelihood ratio passes the threshold.

    ``pairs``: (w1, w2, frequency), ``counts``: (term, frequency). The total is one number; both joins are on words,
    unless the pairs bring their words' counts along (_1, _2)."""
    total = F.lit(float(counts.agg(F.sum("frequency")).first()[0] or 0))
    known = counts.select(F.col("term"), F.col("frequency").alias("_n"))
    j = pairs
    if "_1" not in pairs.columns:
        j = (pairs.join(known.withColumnsRenamed({"term": "w1", "_n": "_1"}), "w1")
             .join(known.withColumnsRenamed({"term": "w2", "_n": "_2"}), "w2"))
    return j.where(likelihood_ratio("frequency", "_1", "_2", total) > threshold).select("w1", "w2", "frequency")


def with_collocations(pairs: DataFrame, counts: DataFrame, threshold: float = COLLOCATION_THRESHOLD) -> DataFrame:
    """Term counts in which collocations are terms of their own and take their occurrences from their words;
    words that have none left go."""
    found = stored(collocations(pairs, counts, threshold), "collocations")  # read twice below
    taken = found.select(F.explode(F.array("w1", "w2")).alias("term"), (-F.col("frequency")).alias("frequency"))
    single = counts.unionByName(taken).groupBy("term").agg(F.sum("frequency").cast("bigint").alias("frequency")).where("frequency > 0")
    return single.unionByName(found.select(F.concat_ws(" ", "w1", "w2").alias("term"), F.col("frequency").cast("bigint").alias("frequency")))


def term_cloud(spark: SparkSession, docs: DataFrame, text_col, k: int = TERM_CLOUD_SIZE,
               stopwords=D.STOPWORDS_EN, threshold: float = COLLOCATION_THRESHOLD) -> DataFrame:
    """The most frequent terms with plurals merged and neighbours that belong together as one term: the
    term cloud's input. Words and pairs are counted in one pass over the texts, before any join."""
    toks, dropped = T.tokens(text_col), isinstance(stopwords, D.Dictionary) and len(stopwords) <= MAX_LITERAL_STOPWORDS
    if dropped:
        # stop words leave gaps, so that their pairs are never counted and no new neighbours arise
        listed = [row[0] for row in stopwords.rows]
        toks = F.transform(toks, lambda w: F.when(~w.isin(listed), w))
    texts = docs.select(toks.alias("_w"))
    made = texts.select(F.explode(F.concat(F.transform("_w", lambda w: F.struct(w.alias("w1"), F.lit("").alias("w2"))),
                                           adjacent_pairs(F.col("_w")))).alias("p"))
    both = made.where("p.w1 is not null and p.w2 is not null").groupBy("p.w1", "p.w2").agg(F.count(F.lit(1)).alias("n"))
    both = both.withColumn("w2", F.nullif("w2", F.lit("")))
    if not dropped:
        stop = small_side(spark, stopwords)
        both = both.join(stop.withColumnRenamed("term", "w1"), "w1", "left_anti").join(stop.withColumnRenamed("term", "w2"), "w2", "left_anti")
    kept = stored(both, "cloud")
    words = kept.where("w2 is null").select(F.col("w1").alias("term"), F.col("n").alias("frequency"))
    forms = stored(plural_forms(words), "forms")  # (term, form): the counted form of each word
    counts = stored(words.join(forms, "term").groupBy(F.col("form").alias("term")).agg(F.sum("frequency").alias("frequency")), "counts")
    # a pair meets each of its words once: its form and that form's count
    known = stored(forms.join(counts.withColumnRenamed("term", "form"), "form"), "known")
    pairs = (kept.where("w2 is not null").join(known.select(F.col("term").alias("w1"), F.col("form").alias("_f1"), F.col("frequency").alias("_1")), "w1")
             .join(known.select(F.col("term").alias("w2"), F.col("form").alias("_f2"), F.col("frequency").alias("_2")), "w2")
             .groupBy(F.col("_f1").alias("w1"), F.col("_f2").alias("w2"), "_1", "_2").agg(F.sum("n").alias("frequency")))
    return with_collocations(pairs, counts, threshold).orderBy(F.desc("frequency"), F.asc("term")).limit(k)


def top_bigrams(spark: SparkSession, docs: DataFrame, text_col, k: int = TERM_CLOUD_SIZE,
                stopwords=D.STOPWORDS_EN) -> DataFrame:
    """Adjacent token pairs where neither token is a stop word."""
    stop = small_side(spark, stopwords)
    staged = docs.select(T.tokens(text_col).alias("_toks"))
    pairs = staged.select(F.inline(adjacent_pairs(F.col("_toks"))))
    kept = (pairs.join(stop.withColumnRenamed("term", "w1"), "w1", "left_anti")
                 .join(stop.withColumnRenamed("term", "w2"), "w2", "left_anti"))
    counts = (kept.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("frequency"))
              .select(F.concat_ws(" ", "w1", "w2").alias("bigram"), "frequency"))
    return counts.orderBy(F.desc("frequency"), F.asc("bigram")).limit(k)
