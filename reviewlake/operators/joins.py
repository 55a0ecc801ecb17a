"""Join helpers: broadcast only what is provably small."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.dictionaries import Dictionary

# A dictionary side above this many rows is joined by shuffle, not broadcast.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def small_side(spark: SparkSession, side, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``side`` when its size is bounded, else return it for a shuffle join.

    A ``Dictionary`` is bounded by construction.  A DataFrame is read once, up to
    ``max_rows + 1`` rows and ``MAX_BROADCAST_BYTES``: what was read is broadcast if
    that was all of it, so its plan is not run again.
    """
    if isinstance(side, Dictionary):
        return side.broadcast(spark) if len(side) <= max_rows else side.frame(spark)
    rows = side.limit(max_rows + 1).collect()
    size = sum(len(str(v)) for r in rows for v in r)
    if len(rows) <= max_rows and size <= MAX_BROADCAST_BYTES:
        return F.broadcast(spark.createDataFrame(rows, side.schema))
    return side
