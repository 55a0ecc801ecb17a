"""Best-fit packing of token sequences, in bulk-synchronous sweeps over lengths and gaps.

Documents are tokenised, closed with an end id and cut into pieces of at most
``capacity`` ids (only longer ones are cut; the first piece takes what is left over).
Pieces of one length are interchangeable, and so are bins of one gap: a run is a length with
ranks, or a gap with bin numbers. There are at most ``capacity`` runs of pieces and a few per
round and length of gaps, whatever the input's size; the pieces themselves stay distributed and
find their place by (length, rank) in the end.

A round (``_sweep``) matches all long runs at once:

1. Sort. Runs of gaps and of the lengths above ``REACH`` of the longest one left are sorted by size, falling.
2. Successors. ``c``, a prefix sum, is the number of bins that hold a length; the c-th bin is its
   successor, the smallest gap that is large enough.
3. Conflicts by rank. Longer pieces go first; with P pieces so far, K = P + min(0, min(c - P)) of them get a
   bin, as a prefix minimum. The k-th of them takes bin k + min(c - K) over itself and what follows, a
   suffix minimum: the tightest bins that leave the shorter ones theirs. A bin takes further pieces of that
   length if there are more of them than bins.
4. Update. What is left of a gap is a gap of the next round. Lengths that no gap holds open new bins:
   those above half a bin one each, others no more bins than all of their ids fill.

Rounds repeat until no piece is left; their number grows with the capacity and the logarithm of the number
of pieces. Every round's runs are written tables; the driver only asks whether any is left.

Ranks come from the partitions of the written piece table: the count of a
length in earlier partitions plus the rank within the partition. No sort, no window over
the pieces, and no shuffle of ids.

Defined results: a null or empty text is the end id alone; a null doc_id is passed on;
repeated rows are packed each; an empty table gives an empty table; a text of any length is cut into as many
pieces as it takes; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, whole_text, written
from .tokens import MEMO, encoder

CAPACITY, END_ID = 1024, 2
#: Rows of the (partition, length) table that may be broadcast (24 bytes each); beyond it a shuffle join.
MAX_BROADCAST_ROWS = 1_000_000
#: A round takes the lengths above this share of the longest one that waits.
REACH = 0.5
_FLUSH = 8 << 20  # bytes of ids in an output batch

GAP_RUN = "struct<from:bigint,to:bigint,size:bigint,at:bigint,number:bigint,kept:bigint>"
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
           capacity: int = CAPACITY, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32 bit), partition and rank among equal lengths there.

    ``memo``: words that a Python worker remembers (about 200 bytes each).
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, memo).encode, TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(t.as_py()) + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rank = seen.get(size, 0)
                    seen[size] = rank + 1
                    rows.append((d, piece, at, size, ids[4 * at:4 * (at + size)], part, rank))
                    at, piece = at + size, piece + 1
                held += len(ids)
                if held >= _FLUSH:
                    yield flush()
                    rows.clear()
                    held = 0
        if rows:
            yield flush()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"))
    return in_batches(src).mapInArrow(run, PIECES)


#: A round as SQL: one statement is analysed at once. Its sweeps order runs, a number bounded by the capacity, not pieces.
_ROUND = """
WITH active AS (SELECT * FROM (SELECT *, max(length) OVER () AS longest FROM {runs}) WHERE length > longest * {reach}),
events AS (
  SELECT gap AS size, false AS piece, first AS at, number, 0L AS bins FROM {gaps}
  UNION ALL SELECT length, true, lo, n, bins FROM active),
counted AS (  -- c: bins that hold the length; p: pieces so far
  SELECT *, coalesce(sum(if(piece, 0, number)) OVER w, 0) AS c, coalesce(sum(if(piece, number, 0)) OVER w, 0) AS p
  FROM events WINDOW w AS (ORDER BY size DESC, piece, at ROWS UNBOUNDED PRECEDING)),
ranked AS (SELECT *, p + least(0, coalesce(min(if(piece, c - p, NULL)) OVER w, 0)) AS k
  FROM counted WINDOW w AS (ORDER BY size DESC, piece, at ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT *, lag(k, 1, 0L) OVER (ORDER BY size DESC, piece, at) AS before FROM ranked),
shifted AS (SELECT *, min(if(piece AND k > before, c - k, NULL)) OVER w AS shift
  FROM kept WINDOW w AS (ORDER BY size DESC, piece, at ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
-- both sides as intervals of bin ranks; every start and end cuts them into stretches of one gap and one length
spans AS (SELECT piece, CASE WHEN piece THEN before + shift ELSE c - number END AS x, CASE WHEN piece THEN k + shift ELSE c END AS y,
    size, at, number, k - before AS n FROM shifted WHERE NOT piece OR k > before),
cuts AS (
  SELECT x AS b, CASE WHEN NOT piece THEN struct(x, y, size, at, number, n) END AS g,
    CASE WHEN piece THEN struct(x, y, size, at, number, n) END AS r FROM spans
  UNION ALL SELECT y, NULL, NULL FROM spans),
carried AS (
  SELECT b, last(g, true) OVER w AS g, last(r, true) OVER w AS r, lead(b) OVER (ORDER BY b) - b AS number
  FROM cuts WINDOW w AS (ORDER BY b RANGE UNBOUNDED PRECEDING)),
stretches AS (SELECT b, g, CASE WHEN b < r.y THEN r END AS r, number FROM carried WHERE number > 0),
placed AS (
  SELECT b, g.size AS gap, g.at + b - g.x AS first, number, r.size AS length, r.at + b - r.x AS lo,
    CASE WHEN r IS NULL THEN 0L ELSE number END AS n, r.at + r.n AS rest_lo, r.number - r.n AS rest,
    coalesce(g.size div r.size - 1, 0L) AS per_more FROM stretches),
-- pieces of a length beyond its bins join those placed, tightest bins first
fuller AS (SELECT *, coalesce(sum(number * per_more) OVER (PARTITION BY length ORDER BY b DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS held FROM placed),
-- lengths that no gap holds
waiting AS (SELECT size AS length, at AS lo, number AS n, bins, {capacity} div size AS per,
    (number + {capacity} div size - 1) div ({capacity} div size) AS need FROM shifted WHERE piece AND c = 0),
allowed AS (SELECT *, sum(length * n) OVER () AS ids, coalesce(sum(need) OVER (ORDER BY length DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS used FROM waiting),
opened AS (SELECT *, CASE WHEN length * 2 > {capacity} THEN need ELSE least((ids + {capacity} - 1) div {capacity} - used, need) END AS number
  FROM allowed)
SELECT gap, first, number, length, lo, 1L AS per, n, rest_lo + held AS more_lo,
  coalesce(greatest(0L, least(rest - held, number * per_more)), 0L) AS more, per_more FROM fuller
UNION ALL
SELECT bigint({capacity}), bins + used, number, length, lo, per, least(n, number * per), 0L, 0L, 0L FROM opened WHERE number > 0
"""


def _sweep(runs: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """One round: what happens to each run of bins.

    ``runs`` (length, lo, n, bins): pieces of ranks lo to lo + n, and the number of open bins; ``gaps`` (gap, first,
    number): bins from first on have that much room. Rows of the result: (gap, first, number) and, if pieces of
    ``length`` go there, their first rank ``lo``, ``per`` pieces a bin, ``n`` in all; ``more_lo`` and ``more``: further pieces
    of that length, ``per_more`` a bin.
    """
    return runs.sparkSession.sql(_ROUND, runs=runs, gaps=gaps, reach=REACH, capacity=capacity)


def _filled(step: DataFrame) -> DataFrame:
    """(gap, first, number): the bins of a round's rows with the room that is left."""
    # bins with all further pieces, one with some of them, and the rest; or full new bins and a last one
    joined = F.expr("struct(gap - (per_more + 1) * length as gap, first as first, more div per_more as number)"), F.expr(
        "struct(gap - (1 + more % per_more) * length as gap, first + more div per_more as first, cast(sign(more % per_more) as bigint) as number)"), F.expr(
        "struct(gap - length as gap, first + (more + per_more - 1) div per_more as first, number - (more + per_more - 1) div per_more as number)")
    opened = F.expr("struct(gap - per * length as gap, first as first, n div per as number)"), F.expr(
        "struct(gap - (n % per) * length as gap, first + n div per as first, cast(sign(n % per) as bigint) as number)")
    same = F.expr("struct(gap as gap, first as first, number as number)")
    parts = F.when(F.col("n") == 0, F.array(same)).when(F.col("more") > 0, F.array(*joined)).otherwise(F.array(*opened))
    return step.select(F.explode(parts).alias("x")).select("x.*").where("number > 0 and gap > 0")


def _places(step: DataFrame, capacity: int) -> DataFrame:
    """(length, lo, hi, first_bin, per, at): rank r goes to bin first_bin + (r - lo) div per, at + (r - lo) % per * length."""
    at = F.lit(capacity) - F.col("gap")
    both = F.array(F.struct("length", "lo", (F.col("lo") + F.col("n")).alias("hi"), F.col("first").alias("first_bin"), "per", at.alias("at")),
                   F.struct("length", F.col("more_lo").alias("lo"), (F.col("more_lo") + F.col("more")).alias("hi"), F.col("first").alias("first_bin"),
                            F.col("per_more").alias("per"), (at + F.col("length")).alias("at")))
    return step.where("n > 0").select(F.explode(both).alias("x")).select("x.*").where("hi > lo")


#: Set while the rounds run. They are many plans over tables of a few thousand rows: replanning them by stage and
#: keeping their descriptions whole is what fills the driver, and neither helps.
ROUND_CONF = {"spark.sql.adaptive.enabled": "false", "spark.sql.maxPlanStringLength": "2000", "spark.sql.shuffle.partitions": "4"}


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in wanted}
    own = spark.conf.getAll
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if k in own:
                spark.conf.set(k, v)
            else:
                spark.conf.unset(k)


def match(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(length, lo, hi, first_bin, per, at) for ``counts`` (length, n): rounds of sweeps until every rank has a bin."""
    counts = written(counts, "pack-lengths")  # the last job over the pieces
    with _settings(counts.sparkSession, ROUND_CONF):
        return _match(counts, capacity)


def _match(counts: DataFrame, capacity: int) -> DataFrame:
    spark = counts.sparkSession
    runs = counts.selectExpr("bigint(length) AS length", "0L AS lo", "bigint(n) AS n", "0L AS bins")
    runs = written(runs.coalesce(1), "pack-runs")
    gaps = spark.createDataFrame([], "gap long, first long, number long")
    steps = []
    while not runs.isEmpty():
        step = written(_sweep(runs, gaps, capacity).coalesce(1), "pack-step")
        steps.append(step)
        runs = written(spark.sql("""
            WITH done AS (SELECT length AS l, sum(n + more) AS placed FROM {step} GROUP BY length)
            SELECT length, lo + coalesce(placed, 0L) AS lo, n - coalesce(placed, 0L) AS n,
              greatest(bins, (SELECT max(first + number) FROM {step})) AS bins
            FROM {runs} LEFT JOIN done ON length = l WHERE n > coalesce(placed, 0L)""", runs=runs, step=step.coalesce(1)).coalesce(1), "pack-runs")
        gaps = _filled(step)
    places = [_places(s, capacity) for s in steps]
    if not places:
        return spark.createDataFrame([], ", ".join(f"{n} long" for n in ("length", "lo", "hi", "first_bin", "per", "at")))
    return written(reduce(DataFrame.unionByName, places).coalesce(1), "pack-places")


def best_fit(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (as ``pieces`` returns, written) its sequence_id and offset."""
    by_part = written(made.groupBy("part", "length").count(), "piece-counts")
    places = match(by_part.groupBy("length").agg(F.sum("count").alias("n")), capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    if by_part.count() <= MAX_BROADCAST_ROWS:
        base = F.broadcast(base)
    ranked = made.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    # A few places per length and round: bounded by the capacity, not by the pieces.
    placed = ranked.alias("a").join(F.broadcast(places).alias("b"), F.expr("a.length = b.length and rank >= lo and rank < hi"))
    turn = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "a.length", "ids",
                         (F.col("first_bin") + F.expr("(rank - lo) div per")).alias("sequence_id"),
                         (F.col("at") + turn % F.col("per") * F.col("a.length")).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
         capacity: int = CAPACITY, end_id: int = END_ID, memo: int = MEMO) -> DataFrame:
    """Tokenise, cut and place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return best_fit(written(pieces(docs, tokenizer, text, doc_id, capacity, end_id, memo), "pieces"), capacity)
