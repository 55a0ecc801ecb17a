"""Hard negatives: rows of other labels that score almost as high as an anchor's positives (operator 12).

The rows become an STR-packed R-tree: Spark range-sorts them by the coordinate of the largest spread, each task
cuts its range into tiles and sorts and slices a tile by further coordinates into leaves. Every leaf, a row of a
written table, has the bounding box of its vectors; runs of leaves have the box of theirs. Over a box the inner
product with an anchor lies in the sum of its per-coordinate intervals. Anchors are a stated query set: blocks of
bounded size are broadcast, one after the other, and every task walks its boxes best first (by their upper bound).
A box is left out only if its interval misses every score window of the anchor or lies strictly below the k-th
score found, so ties by id are kept and the result is that of the exhaustive search. Each task returns k rows a
window; Spark ranks them.

Defined results: rows with a null id, label or vector, or with a null or non-finite component take no part; rows
that repeat an id are one row (the least label, then vector); shorter vectors count as filled up with zeros; an
anchor without another row of its label has no positives and returns nothing; only the three named columns are
read, so others may have any name; an empty table gives no rows. Scores have to fit a 64-bit integer, else the
job ends with an error.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.session import scratch_dir

from .common import in_batches, written

#: Rows of a leaf, leaves of an inner box, rows that a task packs at a time, coordinates that slice a tile.
LEAF, FANOUT, TILE, SLICED = 64, 8, 8_192, 3
#: Rows whose spread names the coordinate of the range sort; speed alone depends on it.
SPREAD_ROWS = 10_000
#: Bytes of the anchors' vectors that are broadcast at a time.
BLOCK_BYTES = 4 << 20


def integer_rows(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, v): the rows that take part, components as floor(scale * x), one row an id."""
    x = F.col(vector).cast("array<double>")
    sound = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.where(sound).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                                  F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column as rows of ``dims`` numbers, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def str_leaves(v: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Sort-tile-recursive packing: row numbers of each leaf, neighbours in order."""
    coordinates = np.argsort(-v.std(axis=0), kind="stable")[:SLICED].tolist() if len(v) else []

    def pack(rows, left):
        if len(rows) <= leaf:
            return [rows]
        if not left:
            return [rows[i:i + leaf] for i in range(0, len(rows), leaf)]
        rows = rows[np.argsort(v[rows, left[0]], kind="stable")]
        slabs = math.ceil((len(rows) / leaf) ** (1 / len(left)))
        step = leaf * math.ceil(len(rows) / leaf / slabs)
        return [x for i in range(0, len(rows), step) for x in pack(rows[i:i + step], left[1:])]

    return pack(np.arange(len(v)), coordinates) if len(v) else []


LEAVES = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(T.LongType())),
                       T.StructField("low", T.ArrayType(T.LongType())), T.StructField("high", T.ArrayType(T.LongType())),
                       T.StructField("vectors", T.BinaryType())])


def build_index(rows: DataFrame, dims: int) -> DataFrame:
    """The leaves of the tree as a written table: ids, labels, box and vectors (64-bit integers) of each."""
    def run(batches):
        ids, labels, vs, held = [], [], [], 0

        def out():
            i, lab, v = np.concatenate(ids), np.concatenate(labels), np.concatenate(vs)
            leaves = str_leaves(v)
            cols = [[i[x] for x in leaves], [lab[x] for x in leaves], [v[x].min(axis=0) for x in leaves],
                    [v[x].max(axis=0) for x in leaves], [v[x].astype("<i8").tobytes() for x in leaves]]
            types = [pa.list_(pa.int64())] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], LEAVES.names)

        for batch in batches:
            for start in range(0, batch.num_rows, TILE):
                part = batch.slice(start, TILE)
                ids.append(part.column("id").to_numpy())
                labels.append(part.column("label").to_numpy())
                vs.append(_matrix(part.column("v"), dims))
                held += part.num_rows
                if held >= TILE:
                    yield out()
                    ids, labels, vs, held = [], [], [], 0
        if held:
            yield out()

    head = rows.limit(SPREAD_ROWS).agg(*[F.stddev(F.get("v", F.lit(i))).alias(str(i)) for i in range(dims)]).first() if dims else ()
    widest = max(range(dims), key=lambda i: head[i] or 0.0) if dims else 0
    order = [F.coalesce(F.get("v", F.lit(widest)), F.lit(0)), F.col("id")]
    return written(in_batches(rows.repartitionByRange(*order).sortWithinPartitions(*order)).mapInArrow(run, LEAVES), "rtree")


class _Boxes:
    """The leaves of an Arrow batch, with inner boxes over runs of them."""

    def __init__(self, batch: pa.RecordBatch, dims: int, kind):
        n = batch.num_rows
        self.low = _matrix(batch.column("low"), dims).astype(kind)
        self.high = _matrix(batch.column("high"), dims).astype(kind)
        self.ids = [x.values.to_numpy() for x in batch.column("ids")]
        self.labels = [x.values.to_numpy() for x in batch.column("labels")]
        self.vectors = [np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dims).astype(kind) for x in batch.column("vectors")]
        runs = np.arange(0, n, FANOUT)
        self.inner_low = np.minimum.reduceat(self.low, runs) if n else self.low
        self.inner_high = np.maximum.reduceat(self.high, runs) if n else self.high
        self.visited = 0

    @staticmethod
    def interval(up, down, low, high):
        """Least and greatest inner product of an anchor (its parts above and below zero) over boxes."""
        return low @ up + high @ down, high @ up + low @ down

    def search(self, q, own, label, same, windows, found, k):
        """Best-first walk for one anchor. ``windows``: (least, most) scores; ``found``: for each of them
        the best (-score, id) so far in order, extended in place."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)

        def wanted(least, most):
            return any(least <= hi and most >= lo and (len(f) < k or most >= -f[-1][0]) for (lo, hi), f in zip(windows, found))

        lows, highs = self.interval(up, down, self.inner_low, self.inner_high)
        queue = [(-h, 0, i) for i, (low, h) in enumerate(zip(lows.tolist(), highs.tolist())) if wanted(low, h)]
        least_of = lows.tolist()
        heapq.heapify(queue)
        while queue:
            most, is_leaf, i = heapq.heappop(queue)
            if not is_leaf:
                if not wanted(least_of[i], -most):
                    continue
                a, b = i * FANOUT, min((i + 1) * FANOUT, len(self.low))
                lo, hi = self.interval(up, down, self.low[a:b], self.high[a:b])
                for j, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
                    if wanted(x, y):
                        heapq.heappush(queue, (-y, 1, a + j))
                continue
            if not any(-most >= lo and (len(f) < k or -most >= -f[-1][0]) for (lo, _), f in zip(windows, found)):
                continue
            self.visited += 1
            scores, ids = self.vectors[i] @ q, self.ids[i]
            able = (self.labels[i] == label) & (ids != own) if same else self.labels[i] != label
            for (lo, hi), f in zip(windows, found):
                floor = max(lo, -f[-1][0]) if len(f) == k else lo
                at = np.flatnonzero(able & (scores >= floor) & (scores <= hi))
                if len(at):
                    at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                    f[:] = sorted(f + list(zip((-scores[at]).tolist(), ids[at].tolist())))[:k]


def _nearest(leaves: DataFrame, block: dict, dims: int, kind: str, same: bool, k: int) -> DataFrame:
    """(anchor, w, score, id): the best k rows of each task for each score window ``w`` of the block's anchors."""
    shared = leaves.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        q = b["v"].astype(kind)
        found = [[[] for _ in w] for w in b["windows"]]
        for batch in batches:
            boxes = _Boxes(batch, dims, kind)
            for j, own in enumerate(b["ids"]):
                if b["windows"][j]:
                    boxes.search(q[j], own, b["labels"][j], same, b["windows"][j], found[j], k)
        rows = [(b["ids"][j], w, int(-s), i) for j, fs in enumerate(found) for w, f in enumerate(fs) for s, i in f]
        columns = list(zip(*rows)) or [()] * 4
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "w", "score", "id"])

    got = leaves.mapInArrow(run, "anchor long, w int, score long, id long")
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column | str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 5, share: int = 80,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (rows whose
    ``id`` meets the condition) and each of its first ``positives`` rows of the same label, the first ``negatives``
    rows of other labels that score at most as high as the positive and at least ``share`` per cent of it."""
    spark = df.sparkSession
    rows = written(integer_rows(df, vec_id, vector, label, scale), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda c: F.greatest(c, -c)))).alias("most"),
                    F.count(F.when(F.expr(anchors) if isinstance(anchors, str) else anchors, 1)).alias("anchors")).first()
    dims, most, n = size["dims"] or 0, size["most"] or 0, size["anchors"]
    path = scratch_dir(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not dims:
        return spark.createDataFrame([], schema)
    if dims * most * most >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit a 64-bit integer")
    kind = "f8" if dims * most * most < 1 << 53 else "i8"  # either way exact
    leaves = build_index(rows, dims)
    blocks = -(-n * dims * 8 // block_bytes)
    chosen = written(rows.where(anchors).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), "anchors")
    for i in range(blocks):
        part = chosen.where(F.col("block") == i).orderBy("id").toArrow()
        if not part.num_rows:
            continue
        ids = part.column("id").to_pylist()
        block = {"ids": ids, "labels": part.column("label").to_pylist(), "v": _matrix(part.column("v").combine_chunks(), dims)}
        everything = float("inf") if kind == "f8" else 1 << 62
        near = written(_nearest(leaves, block | {"windows": [[(-everything, everything)]] * len(ids)}, dims, kind, True, positives), "positives")
        windows = {a: [None] * positives for a in ids}
        for r in near.select("anchor", "rank", "score").collect():  # at most ``positives`` an anchor of the block
            windows[r["anchor"]][r["rank"] - 1] = (-(-share * r["score"] // 100), r["score"])
        hard = _nearest(leaves, block | {"windows": [[x for x in windows[a] if x] for a in ids]}, dims, kind, False, negatives)
        named = near.select("anchor", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        hard.join(named, ["anchor", "w"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")).write.parquet(f"{path}/block={i}")
    return spark.read.schema(schema).parquet(f"{path}/block=*")
