"""The review table.

``fixture_reviews`` builds the test view of reviews from the driver's
``documents`` and ``labels`` tables (see FIXTURES.md section 6): the first line
of a document is the title, the rest the body, and rating / text rating /
topic are fixed functions of the document id and length.

``enrich`` turns any raw review frame (string rating and text rating, as the
legacy JSON stores them) into the typed review record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import text as T

# The five-class taxonomy the fixture view draws topics from.
FIXTURE_TOPICS = [
    "in-person shopping",
    "delivery experience",
    "customer service",
    "price",
    "product defects and quality",
]


# Declared schemas of the driver's tables (no footer-based inference per read).
TABLE_DDL = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "benchmark": "item_id BIGINT, text STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(TABLE_DDL[name]) if name in TABLE_DDL else spark.read
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fixture_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``reviews`` test view over whole ``documents`` joined to ``labels``."""
    d = read_table(spark, sf_dir, "documents").alias("d")
    # One row per doc_id on the right (an aggregate), so when a query does not use
    # ``verified`` Catalyst removes the outer join and the document text is never
    # shuffled for it.  labels grows with documents: the join strategy is left to
    # Catalyst/AQE where it is needed.
    lab = (read_table(spark, sf_dir, "labels").groupBy("doc_id")
           .agg(F.max(F.col("quality") == 1).alias("_q1")))
    j = d.join(lab, "doc_id", "left")
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    body = F.substring(F.col("text"), (F.length(title) + 2).cast("int"), 2147483647)
    doc = F.col("doc_id")
    topic = F.when(doc % 7 == 0, F.lit(FIXTURE_TOPICS[0]))
    for i, name in enumerate(FIXTURE_TOPICS[1:], start=1):
        topic = topic.when(doc % 7 == i, F.lit(name))
    topic = topic.when(doc % 7 == 5, F.lit("unknown"))
    text_rating_num = (F.lit(1000) + (F.col("n_chars") * 37 + doc) % 4001).cast("double") / 1000
    return j.select(
        doc.cast("string").alias("id"),
        F.col("source").alias("company"),
        title.alias("title"),
        body.alias("body"),
        F.date_add(F.lit("2024-01-01").cast("date"), (doc % 366).cast("int")).alias("published_date"),
        F.when(doc % 11 == 0, F.lit("unknown"))
         .otherwise((F.lit(1) + F.col("n_chars") % 5).cast("string")).alias("rating"),
        F.when(doc % 13 == 0, F.lit("unknown"))
         .otherwise(text_rating_num.cast("string")).alias("text_rating"),
        topic.alias("topic"),
        F.coalesce(F.col("_q1"), F.lit(False)).alias("verified"),
        F.col("lang"),
    )


def enrich(raw: DataFrame) -> DataFrame:
    """Typed review record: numeric rating / text rating, discrepancy, timestamp.

    ``rating`` and ``text_rating`` keep their raw text in ``rating_raw`` /
    ``text_rating_raw``; non-numbers become NULL instead of failing the job.
    """
    cols = raw.columns
    published = (F.col("published_date").cast("timestamp") if "published_date" in cols
                 else F.to_timestamp(F.col("timestamp")))
    out = raw.select(
        *[c for c in cols if c not in ("rating", "text_rating", "published_date", "timestamp")],
        published.alias("published_at"),
        F.col("rating").cast("string").alias("rating_raw"),
        T.guarded_double("rating").alias("rating"),
        F.col("text_rating").cast("string").alias("text_rating_raw"),
        F.round(T.guarded_double("text_rating"), 3).alias("text_rating"),
    )
    return out.withColumn("discrepancy", F.abs(F.col("text_rating") - F.col("rating")))
