"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import scratch_dir

# The ASCII white space that separates words (\x20, \x09-\x0D).
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

# A null doc_id counts as the smallest one.
NULL_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (compared as Spark does: without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def id_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def words_of(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def hash128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes of a string."""
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


#: Bytes of an Arrow batch that goes to a Python worker; ten thousand long texts do not fit one.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, its session bound to Arrow batches of ``BATCH_BYTES`` unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if _BATCH_CONF not in conf.getAll:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps whose result is already written.

    The first collection lets go of the plans, the second of what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
