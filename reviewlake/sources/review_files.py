"""Review files and stores: JSON (legacy array or lines), CSV, Parquet store.

All readers take a declared schema (no inference).  A missing path fails fast
with ``FileNotFoundError``.  The legacy JSON file is one array per company
(``multiLine``; such a file cannot be split, so prefer JSON lines or Parquet),
with ``text-rating`` / ``timestamp`` keys that the reader renames.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import text as T

# The raw review table as stored (strings for the mixed-type fields).
REVIEW_DDL = ("id STRING, company STRING, title STRING, body STRING, published_date DATE, "
              "rating STRING, text_rating STRING, topic STRING, verified BOOLEAN, lang STRING")
# CSV marker for NULL, so an empty string stays an empty string on the way back.
NULL_MARK = "\\N"
# Legacy per-company JSON record keys.
LEGACY_DDL = ("id STRING, title STRING, body STRING, timestamp STRING, rating STRING, "
              "`text-rating` STRING, discrepancy STRING, page INT, sentiment STRING, "
              "topic STRING, verified BOOLEAN")


def _read(reader, path: str, fmt: str) -> DataFrame:
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


def read_legacy_json(spark: SparkSession, path: str, company: str | None = None) -> DataFrame:
    """Legacy JSON array file -> raw reviews with canonical names."""
    df = _read(spark.read.schema(LEGACY_DDL).option("multiLine", True), path, "json")
    out = df.withColumnRenamed("text-rating", "text_rating")
    if company is not None:
        out = out.withColumn("company", F.lit(company))
    return out.withColumn("discrepancy", T.guarded_double("discrepancy"))


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def read_json_lines(spark: SparkSession, path: str, ddl: str = REVIEW_DDL) -> DataFrame:
    return _read(spark.read.schema(ddl), path, "json")


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """All columns with a header; bodies contain newlines and quotes, so they are
    quoted, and NULL is written as a marker distinct from the empty string."""
    (df.write.mode(mode).option("header", True).option("escape", '"')
       .option("nullValue", NULL_MARK).csv(path))


def read_csv(spark: SparkSession, path: str, ddl: str = REVIEW_DDL) -> DataFrame:
    reader = (spark.read.schema(ddl).option("header", True).option("multiLine", True)
              .option("escape", '"').option("nullValue", NULL_MARK))
    return _read(reader, path, "csv")


def append_store(df: DataFrame, path: str, partition_by: str = "company") -> None:
    """Append to the review store, partitioned by company (bag semantics: a rerun
    appends the same reviews again; use ``operators.dedupe`` to keep the latest)."""
    df.write.mode("append").partitionBy(partition_by).parquet(path)


def read_store(spark: SparkSession, path: str, ddl: str = REVIEW_DDL) -> DataFrame:
    return _read(spark.read.schema(ddl), path, "parquet")


def write_report(report: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Write the report section table in section order.  The table is small by
    construction (fixed sections plus one per question), so one file is written."""
    (report.orderBy(*[c for c in ("part", "section_order") if c in report.columns]).coalesce(1)
     .write.mode(mode).format(fmt).save(path))
