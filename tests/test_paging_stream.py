import os
import random
import tempfile

from pyspark.sql import functions as F

from reviewlake.sources import pages as PG
from reviewlake.streaming import incremental as ST
from reviewlake.streaming import paging as SP

SCHEMA = "company string, page int, ok boolean, at long, html string"


def captures(rng, companies=6, n=90):
    rows = [(rng.choice([*map(str, range(companies)), None]), rng.choice([None, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 5, 6, 7, 99, 100, 101]),
             rng.random() < 0.8, rng.choice([None, *range(5)]), f"page {i}\n\"é\"") for i in range(n)]
    rows += [("whole", p, True, 0, f"w{p}") for p in range(1, 103)]
    rows += [("whole", p, True, 0, f"w{p}") for p in (1, 50)]  # the same captures again
    return rows


def streamed(spark, batches, **how):
    base = tempfile.mkdtemp(prefix="rl-paging-")
    src, out, ck = (os.path.join(base, x) for x in ("in", "out", "ck"))
    for rows in batches:  # each run resumes from the checkpoint of the one before
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        s = SP.page_bound_stream(ST.file_stream(spark, src, SCHEMA), ~F.col("ok"), prefer="at", **how)
        ST.run_available_now(s, out, ck)
    return spark.read.schema(SCHEMA).parquet(out)


def test_any_arrival_order_gives_the_batch_rows(spark):
    rng = random.Random(5)
    rows = captures(rng)
    df = spark.createDataFrame(rows, SCHEMA)
    batch = PG.take_while_pages(PG.dedupe_captures(df, prefer=[F.col("ok"), "at"]), ~F.col("ok"))
    want = sorted(((r.company, r.page, r.at) for r in batch.collect()), key=str)
    assert sum(c == "whole" for c, _, _ in want) == 99
    for cuts in (1, 3):
        rng.shuffle(rows)
        got = PG.dedupe_captures(streamed(spark, [rows[i::cuts] for i in range(cuts)]), prefer=["at"])
        got = [tuple(r) for r in got.select("company", "page", "at", "html").collect()]
        assert sorted(((c, p, a) for c, p, a, _ in got), key=str) == want
        kept = {(c, p, a, h) for c, p, ok, a, h in rows if ok}
        assert set(got) <= kept


def test_held_back_pages_leave_once_the_gap_is_filled(spark):
    out = streamed(spark, [[("a", 3, True, 0, "3"), ("a", 1, True, 0, "1")], [("a", 2, False, 0, "bad")], [("a", 2, True, 0, "2"), ("a", 1, True, 0, "1")]])
    assert sorted(r.page for r in out.collect()) == [1, 2, 3]


def test_content_of_silent_companies_is_dropped(spark):
    day = 86400
    batches = [[("a", 3, True, 100 * day, "3"), ("a", 1, True, 100 * day, "1")], [("b", 1, True, 110 * day, "1")], [("a", 2, True, 110 * day, "2")]]
    out = streamed(spark, batches, captured="at", idle="1 day")
    assert sorted((r.company, r.page) for r in out.collect()) == [("a", 1), ("a", 2), ("b", 1)]
    out = streamed(spark, batches, captured="at", idle="20 days")
    assert sorted((r.company, r.page) for r in out.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
