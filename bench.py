"""Benchmark the headline queries.

Runs each query fully (``noop`` sink: the whole plan executes, nothing is
collected to the driver), one warm-up run, then the median of ``BENCH_RUNS``
timed runs.  Prints one JSON line.

The test tables are single Parquet files of one row group, which Spark cannot split: one task
would read all rows, which says nothing of a cluster.  So before any timing the text tables are
written again as ``BENCH_FILES`` files (default twice the CPUs; 0: read them as they are) into a
scratch folder.  The queries themselves have no switch for small inputs.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma list, default the headline set).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["top_terms", "sentiment_pct", "rating_topic_freq", "chunk_fixed", "knn_per_batch",
            "mask_pii_regex", "company_summary", "ingest_reviews", "summary_extractive", "report_sections"]
TABLES = ["documents", "labels", "pages", "conversations", "embeddings", "benchmark", "events"]


def in_files(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables as ``files`` files each, in a scratch folder."""
    if not files:
        return sf_dir
    from reviewlake.session import scratch_dir
    to = scratch_dir(spark, "bench")
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(files).write.parquet(f"{to}/{t}.parquet")
    return to


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from reviewlake.plans import catalog
    from reviewlake.session import get_session

    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(cpus, 8),
                        extra={"spark.driver.memory": "16g"})
    files = int(os.environ.get("BENCH_FILES", str(2 * cpus)))
    given, sf_dir = sf_dir, in_files(spark, sf_dir, files)
    times, rows = {}, {}
    for name in names:
        fn = catalog.QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        rows[name] = fn(spark, sf_dir).count()
    sf = os.path.basename(given.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows, "sf": sf, "cpus": cpus,
                      "runs": runs, "files": files}))
    spark.stop()


if __name__ == "__main__":
    main()
