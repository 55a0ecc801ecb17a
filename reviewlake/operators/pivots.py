"""Exact k-NN that leaves out most distances: items in cells around pivots, bounds by the triangle inequality.

Items belong to their nearest pivot (vectors of a bounded sample) and are stored by cell and distance to it, so a
cell is a run of rows of a table, cut by distance where it is large. A question first looks into the cells nearest
to it until they hold k items: the k-th of them is a radius within which the answer lies. Since an item's distance
to a question differs from the question's distance to its pivot by at most the item's own, only the items of a
cell whose distance lies within the radius of the question's are compared; cells out of reach are not read at all.
Results are those of ``retrieval.knn`` (squared L2 to 9 decimals, ties by item id).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.operators import retrieval as RT
from reviewlake.session import stored

#: Pivots, and the items (by a hash of the id) that they are spread over.
PIVOTS, SAMPLE = 64, 2_000
#: Relative slack of bounds, beyond rounding of sums of squares.
SLACK = 1e-6


def spread_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each the farthest from those taken before (fewer if the rest repeat them)."""
    taken = [0]
    far = ((vectors - vectors[0]) ** 2).sum(axis=1)
    while len(taken) < n and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[taken[-1]]) ** 2).sum(axis=1))
    return vectors[taken]


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(y)))
    for j, v in enumerate(y):
        d = x - v
        out[:, j] = np.einsum("rd,rd->r", d, d)
    return np.sqrt(out)


def build_cells(spark: SparkSession, items: DataFrame, item_id: str, item_vec: str, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """(item_id, v, cell, dist) as a stored table in the order of (cell, dist), and the pivots."""
    src = items.select(item_id, RT.as_double_array(item_vec).alias("v")).where("v is not null")
    few = src.orderBy(F.xxhash64(item_id), item_id).limit(SAMPLE).select("v").collect()
    if not few:
        return stored(src.withColumns({"cell": F.lit(0), "dist": F.lit(0.0)}), "cells"), np.zeros((0, 0))
    chosen = spread_pivots(np.array([r[0] for r in few], float), pivots)
    shared = spark.sparkContext.broadcast(chosen)

    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(np.stack(pdf["v"].to_numpy()), shared.value)
                yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), dist=d.min(axis=1))

    schema = src.select("*").schema.add("cell", "integer").add("dist", "double")
    cells = src.mapInPandas(run, schema)
    return stored(cells.repartitionByRange("cell", "dist").sortWithinPartitions("cell", "dist"), "cells"), chosen


def _compare(cells: DataFrame, item_id: str, question_id: str, qtype: str, block: dict, k: int, counter) -> DataFrame:
    """(question, item, distance): of each batch and cell the best k items within ``reach`` of each question."""
    shared = cells.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        for pdf in batches:
            for cell, rows in pdf.groupby("cell", sort=False):
                rows = rows.sort_values("dist", kind="mergesort")
                dist, ids, x, compared = rows["dist"].to_numpy(), rows[item_id].to_numpy(), None, 0
                near = b["near"][:, cell]  # the questions' distances to this cell's pivot
                slack = SLACK * (1 + near)
                lo = np.searchsorted(dist, near - b["reach"][:, cell] - slack, "left")
                hi = np.searchsorted(dist, near + b["reach"][:, cell] + slack, "right")
                out = []
                for q in np.flatnonzero(hi > lo):
                    x = np.stack(rows["v"].to_numpy()) if x is None else x
                    diff = x[lo[q]:hi[q]] - b["v"][q]
                    d = np.round(np.einsum("rd,rd->r", diff, diff), 9)
                    compared += len(d)
                    best = np.lexsort((ids[lo[q]:hi[q]], d))[:k]
                    out.append(pd.DataFrame({question_id: [b["ids"][q]] * len(best), item_id: ids[lo[q]:hi[q]][best], "distance": d[best]}))
                if counter is not None and compared:
                    counter.add(compared)
                if out:
                    yield pd.concat(out)

    item_type = dict(cells.dtypes)[item_id]
    got = cells.mapInPandas(run, f"`{question_id}` {qtype}, `{item_id}` {item_type}, distance double")
    w = Window.partitionBy(question_id).orderBy("distance", item_id)
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_pruned(spark: SparkSession, items: DataFrame, questions: DataFrame, item_id: str, item_vec: str, k: int = RT.DEFAULT_K,
               question_id: str = "question_id", question_vec: str = "embedding", pivots: int = PIVOTS,
               broadcast_bytes: int = RT.BROADCAST_BYTES, counter=None) -> DataFrame:
    """(question_id, rank, item_id, distance), as ``retrieval.knn`` without partitions gives them. ``counter``: a
    Spark accumulator of the distances computed between questions and items (a retried task counts again)."""
    cells, chosen = build_cells(spark, items, item_id, item_vec, pivots)
    qtype = dict(questions.dtypes)[question_id]
    types = f"`{question_id}` {qtype}, rank int, `{item_id}` {dict(items.dtypes)[item_id]}, distance double"
    if not chosen.size:
        return spark.createDataFrame([], types)
    held = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()}
    number = np.array([held[c]["n"] if c in held else 0 for c in range(len(chosen))])
    found = None
    for ids, vectors, _ in RT.question_blocks(questions, question_id, question_vec, broadcast_bytes):
        v = np.array(vectors, float)
        block = {"ids": ids, "v": v, "near": _distances(v, chosen)}
        # first look: the nearest cells until they hold k items, without a bound
        order = np.argsort(block["near"], axis=1, kind="stable")
        first = np.full(block["near"].shape, -np.inf)
        for q, cs in enumerate(order):
            enough = int(np.searchsorted(np.cumsum(number[cs]), k)) + 1
            first[q, cs[:enough]] = np.inf
        look = cells.where(F.col("cell").isin([int(c) for c in np.flatnonzero((first > 0).any(axis=0))]))
        kth = _compare(look, item_id, question_id, qtype, block | {"reach": first}, k, counter).where(F.col("rank") == k)
        radius = dict(map(tuple, kth.select(question_id, "distance").collect()))  # one number a question of the block
        r = np.array([np.sqrt(radius[i] + 1e-9) if i in radius else np.inf for i in ids])
        reach = np.repeat(r[:, None], len(chosen), axis=1)
        able = [c for c in held if ((block["near"][:, c] - r <= held[c]["hi"] * (1 + SLACK) + SLACK)
                                    & (block["near"][:, c] + r >= held[c]["lo"] * (1 - SLACK) - SLACK)).any()]
        part = _compare(cells.where(F.col("cell").isin(able)), item_id, question_id, qtype, block | {"reach": reach}, k, counter)
        part = stored(part.select(question_id, "rank", item_id, "distance"), "neighbours")
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], types)
