"""Structured Streaming forms: incremental dedupe and daily trends.

Both read a folder of Parquet files as a file stream (new files = new reviews
or events), run with ``availableNow`` (process what is there, then stop, like
a scheduled batch) and keep their state and progress in a checkpoint under
the shared checkpoint folder, so a restarted run resumes where it stopped.

``withWatermark`` needs a TIMESTAMP (not TIMESTAMP_NTZ) column: callers cast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


def file_stream(spark: SparkSession, folder: str, schema: Ty.StructType | str, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format("parquet")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def dedupe_stream(events: DataFrame, key: str, ts: str, watermark: str = "1 day") -> DataFrame:
    """Drop repeats of ``key`` that arrive within the watermark delay.

    State per key is kept until the watermark passes; a key that arrives again
    after that is emitted again (bounded state by design).  Within one
    micro-batch, which of the repeated rows is kept is not specified; use
    ``operators.dedupe.dedupe_latest`` on the sink when the newest must win."""
    return (events.withColumn(ts, F.col(ts).cast("timestamp"))
            .withWatermark(ts, watermark)
            .dropDuplicatesWithinWatermark([key]))


def daily_counts_stream(events: DataFrame, ts: str, key: str, watermark: str = "1 day") -> DataFrame:
    """Counts and sums per (day window, key)."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (e.groupBy(F.window(ts, "1 day").alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
            .select(F.col("w.start").alias("day"), key, "n", "total_value"))


def run_available_now(stream_df: DataFrame, sink_path: str, checkpoint: str,
                      output_mode: str = "append") -> None:
    """Run to the end of the currently available input, writing Parquet.  In
    update/complete mode each micro-batch's rows are appended with an ``_epoch``
    column; readers keep the last epoch per group."""
    w = stream_df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if output_mode == "append":
        q = w.outputMode("append").format("parquet").start(sink_path)
    else:
        def write_batch(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(sink_path)
        q = w.outputMode(output_mode).foreachBatch(write_batch).start()
    q.awaitTermination()
