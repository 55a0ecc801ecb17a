"""Aggregations over the review table (frequency tables, value counts, pivots).

Every aggregate here is a hash aggregate with a partial (map-side) stage, so a
company or key holding a third of all rows is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rating_topic_freq(reviews: DataFrame, rating: str = "rating", topic: str = "topic") -> DataFrame:
    """Counts per (rating, topic); rows with a NULL key are dropped, zero cells omitted."""
    return (reviews.select(rating, topic)
            .dropna(subset=[rating, topic])
            .groupBy(rating, topic)
            .agg(F.count(F.lit(1)).alias("frequency")))


def value_counts_all(reviews: DataFrame, columns: list[str]) -> DataFrame:
    """value_counts() of every listed column in one job: unpivot, then one aggregate.

    Output (column_name, value, frequency); NULL values are dropped.
    """
    as_text = reviews.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = as_text.unpivot([], columns, "column_name", "value")
    return (long.where(F.col("value").isNotNull())
            .groupBy("column_name", "value")
            .agg(F.count(F.lit(1)).alias("frequency")))


def topic_rating_pivot(reviews: DataFrame, rating_values: list[str],
                       rating: str = "rating", topic: str = "topic") -> DataFrame:
    """Topic x rating count matrix; explicit pivot values avoid a distinct job."""
    return (reviews.select(topic, rating)
            .where(F.col(topic).isNotNull())
            .groupBy(topic)
            .pivot(rating, rating_values)
            .agg(F.count(F.lit(1)))
            .na.fill(0, subset=list(rating_values)))


def gather_text(df: DataFrame, key: str, order_col: str, text_col: str, sep: str = " ",
                block: int = 64) -> DataFrame:
    """Join ``text_col`` per key in ``order_col`` order (e.g. answers per question).

    Two levels, so no task gathers an unbounded number of rows: first blocks of
    ``block`` consecutive orders per key, then the block strings per key.  The
    output row of a key is as long as its text, which is the result itself.
    """
    b = df.select(key, order_col, text_col,
                  F.floor(F.col(order_col) / F.lit(block)).alias("_blk"))
    blocks = (b.groupBy(key, "_blk")
              .agg(F.array_sort(F.collect_list(F.struct(order_col, text_col))).alias("_p"))
              .select(key, "_blk", F.concat_ws(sep, F.transform("_p", lambda x: x[text_col])).alias("_s"),
                      F.size("_p").alias("_n")))
    return (blocks.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("_blk", "_s"))).alias("_b"),
                 F.sum("_n").cast("bigint").alias("n_parts"))
            .select(key, F.concat_ws(sep, F.transform("_b", lambda x: x["_s"])).alias("joined"), "n_parts"))


def value_counts_top(reviews: DataFrame, columns: list[str], k: int = 10,
                     approx: bool = False) -> DataFrame:
    """The ``k`` most frequent values of every listed column: (column_name, value,
    frequency, rank).  Exact: counts then ``row_number() <= k`` per column (ties
    by value), pre-limited before the shuffle.  ``approx=True``: one mergeable
    ``approx_top_k`` sketch per column (bounded memory for high-cardinality text;
    counts may be estimates)."""
    from pyspark.sql import Window
    as_text = reviews.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = as_text.unpivot([], columns, "column_name", "value").where(F.col("value").isNotNull())
    if approx:
        top = long.groupBy("column_name").agg(F.expr(f"approx_top_k(value, {int(k)})").alias("_t"))
        return top.select("column_name", F.posexplode("_t").alias("_p", "_e")).select(
            "column_name", F.col("_e.item").alias("value"), F.col("_e.count").alias("frequency"),
            (F.col("_p") + 1).alias("rank"))
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("frequency"))
    w = Window.partitionBy("column_name").orderBy(F.desc("frequency"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
