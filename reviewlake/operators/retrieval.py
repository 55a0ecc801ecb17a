"""Nearest-chunk retrieval and context assembly.

``knn`` is the one exact path: the questions are a stated set that meets all items in
blocks of bounded size, and only top-k candidates leave a block.  ``knn_lsh`` is the
approximate option, with ``knn`` for the questions that it cannot fill.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.session import bounded_batches, stored

# Fixed value: neighbours returned per question.
DEFAULT_K = 4


def sq_l2(a, b) -> F.Column:
    """Squared Euclidean distance of two equal-length DOUBLE arrays."""
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def as_double_array(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("array<double>")


def centroids(vectors: DataFrame, label_col: str, vec_col: str, id_name: str = "question_id") -> DataFrame:
    """Mean vector per label: (question_id, embedding ARRAY<DOUBLE>).

    Element-wise means come from a (label, position) aggregate with a partial
    stage; the per-label gather holds exactly one value per dimension.
    """
    el = vectors.select(label_col, F.posexplode(as_double_array(vec_col)).alias("pos", "v"))
    means = el.groupBy(label_col, "pos").agg(F.avg("v").alias("m"))
    return (means.groupBy(label_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("pm"))
            .select(F.col(label_col).cast("bigint").alias(id_name),
                    F.transform("pm", lambda x: x["m"]).alias("embedding")))


#: Bytes of question vectors that go to the executors in one broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Bytes of the (rows, questions, dimensions) differences that a task holds at a time.
BLOCK_BYTES = 32 * 1024 * 1024
#: Item rows of a block; each block hands on at most k candidates per question.
BLOCK_ROWS = 1024


def question_blocks(questions: DataFrame, question_id: str, question_vec: str, broadcast_bytes: int):
    """The question set in blocks of about ``broadcast_bytes``: (ids, vectors, number of blocks) of each."""
    q = questions.select(F.col(question_id).alias("qid"), as_double_array(question_vec).alias("_qv"))
    stats = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_qv")).alias("d")).first()
    n_blocks = max(1, -(-stats["n"] * max(stats["d"] or 1, 1) * 8 // broadcast_bytes))
    for b in range(n_blocks):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows], n_blocks


def knn(spark: SparkSession, items: DataFrame, questions: DataFrame, item_id: str,
        item_vec: str, partition_by: list[str] | None = None, k: int = DEFAULT_K,
        question_id: str = "question_id", question_vec: str = "embedding",
        broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k items per (partition_by..., question) by squared L2; ties (to 9 decimals) by item id.

    The questions are a stated query set; they meet all items in blocks, whatever their
    number: blocks of ``broadcast_bytes`` are broadcast one after the other, and
    a task compares ``block_rows`` items with as many questions as keep the differences
    within ``block_bytes``.  A block of items hands on at most k candidates per
    (partition keys, question), so what is emitted and shuffled is a k-th of a block's
    share, not items x questions rows; ``row_number() <= k`` over the candidates, limited
    again before the shuffle, gives the answer.

    Output: partition_by..., question_id, rank (1..k), item_id, distance.
    """
    partition_by = list(partition_by or [])
    src = items.select(*partition_by, item_id, as_double_array(item_vec).alias("_iv")).where(F.col("_iv").isNotNull())
    types = dict(src.dtypes)
    qtype = dict(questions.dtypes)[question_id]
    cols = partition_by + [item_id]
    schema = ", ".join([f"`{c}` {types[c]}" for c in cols] + [f"`{question_id}` {qtype}", "distance double"])

    def candidates(shared):
        def run(batches):
            qid, qm = shared.value
            step = max(1, block_bytes // (8 * max(1, qm.shape[1]) * block_rows))
            for pdf in batches:
                if pdf.empty:
                    continue
                # rows sorted by (partition keys, item id): a stable sort of distances
                # then breaks ties by item id
                pdf = pdf.sort_values(cols, kind="mergesort").reset_index(drop=True)
                x = np.stack(pdf["_iv"].to_numpy())
                # all groups of a block at once: they stand one after the other, whatever the question
                group = (pdf.groupby(partition_by, sort=False, dropna=False).ngroup().to_numpy() if partition_by
                         else np.zeros(len(pdf), np.int64))
                named = pdf[cols]
                for lo in range(0, len(pdf), block_rows):
                    rows, of = x[lo:lo + block_rows], group[lo:lo + block_rows]
                    of = np.cumsum(np.concatenate([[0], of[1:] != of[:-1]]))
                    first = np.searchsorted(of, of)  # where a row's group begins
                    near = np.flatnonzero(np.arange(len(of)) - first < k)
                    for at in range(0, len(qid), step):
                        diff = rows[:, None, :] - qm[None, at:at + step, :]
                        d = np.round(np.einsum("rqd,rqd->rq", diff, diff), 9)
                        order = np.argsort(d, axis=0, kind="stable")
                        order = np.take_along_axis(order, np.argsort(of[order], axis=0, kind="stable"), axis=0)
                        top = order[near]  # (k of each group, questions)
                        part = named.iloc[lo + top.reshape(-1)].reset_index(drop=True)
                        part[question_id] = np.tile(qid[at:at + step], len(top))
                        part["distance"] = np.take_along_axis(d, top, axis=0).reshape(-1)
                        yield part
        return run

    found = None
    for ids, vectors, n_blocks in question_blocks(questions, question_id, question_vec, broadcast_bytes):
        shared = spark.sparkContext.broadcast((np.array(ids), np.array(vectors, dtype=np.float64)))
        part = bounded_batches(src).mapInPandas(candidates(shared), schema)
        if n_blocks > 1:  # one block's vectors at a time
            part = stored(part, "candidates")
            shared.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], ", ".join([*(f"`{c}` {types[c]}" for c in partition_by), f"`{question_id}` {qtype}",
                                                    "rank int", f"`{item_id}` {types[item_id]}", "distance double"]))
    w = Window.partitionBy(*partition_by, question_id).orderBy("distance", item_id)
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select(*partition_by, question_id, "rank", item_id, "distance")


#: Items (by a hash of the id) from which knn_lsh derives its bucket length.
LSH_SAMPLE = 2_000


def knn_lsh(spark: SparkSession, items: DataFrame, questions: DataFrame, item_id: str, item_vec: str,
            k: int = DEFAULT_K, bucket_length: float | None = None, num_tables: int = 6,
            question_id: str = "question_id", question_vec: str = "embedding", seed: int = 7,
            sample: int = LSH_SAMPLE) -> DataFrame:
    """Approximate top-k by BucketedRandomProjectionLSH (Euclidean), with an exact way for the rest.

    The bucket length is derived from the data unless given: the median distance of the questions to
    their k-th neighbour in a bounded sample of the items.  Questions that find fewer than
    k items in their buckets are answered by ``knn``, so every question gets k rows.
    Distances are squared, as in ``knn``.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    if bucket_length is None:
        few = items.orderBy(F.xxhash64(item_id), item_id).limit(sample)
        kth = knn(spark, few, questions, item_id, item_vec, k=k, question_id=question_id, question_vec=question_vec)
        bucket_length = kth.where(F.col("rank") == k).agg(F.median(F.sqrt("distance"))).first()[0] or 1.0
    a = items.select(F.col(item_id).alias("item"), array_to_vector(as_double_array(item_vec)).alias("v"))
    b = questions.select(F.col(question_id).alias("q"), array_to_vector(as_double_array(question_vec)).alias("v"))
    lsh = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=float(bucket_length),
                                      numHashTables=num_tables, seed=seed)
    pairs = lsh.fit(a).approxSimilarityJoin(a, b, float("inf"), distCol="dist").select(
        F.col("datasetB.q").alias(question_id), F.col("datasetA.item").alias(item_id),
        F.round(F.pow("dist", F.lit(2)), 9).alias("distance"))
    w = Window.partitionBy(question_id).orderBy("distance", item_id)
    near = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    full = near.groupBy(question_id).count().where(F.col("count") >= k).select(question_id)
    rest = questions.join(full, question_id, "left_anti")
    exact = knn(spark, items, rest, item_id, item_vec, k=k, question_id=question_id, question_vec=question_vec)
    return near.join(full, question_id).select(question_id, "rank", item_id, "distance").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame, item_id: str, question_id: str = "question_id") -> DataFrame:
    """(question_id, recall): the share of the exact neighbours that were found."""
    hit = found.select(question_id, item_id).withColumn("_f", F.lit(1))
    j = exact.select(question_id, item_id).join(hit, [question_id, item_id], "left")
    return j.groupBy(question_id).agg((F.count("_f") / F.count(F.lit(1))).alias("recall"))


def stuff_context(neighbours: DataFrame, texts: DataFrame, item_id: str, text_col: str,
                  group: list[str], sep: str = "\n\n") -> DataFrame:
    """Retrieved texts joined in rank order per group (k rows per group, bounded)."""
    j = neighbours.join(texts.select(item_id, text_col), item_id, "inner")
    return (j.groupBy(*group)
            .agg(F.array_sort(F.collect_list(F.struct("rank", text_col))).alias("_r"))
            .select(*group, F.concat_ws(sep, F.transform("_r", lambda x: x[text_col])).alias("context")))


def hashed_vectors(docs: DataFrame, id_col: str, tokens_col: str, dim: int = 256,
                   keep: list[str] | None = None) -> DataFrame:
    """Test-only embedding: L2-normalised term counts, a term's place being the first 8 hex digits
    of its MD5 modulo ``dim``.  ``keep`` columns are carried through (no join back)."""
    held = {}

    @F.pandas_udf("array<double>")
    def vector(tokens: pd.Series) -> pd.Series:
        if "place" not in held:  # a worker remembers places over its batches
            held["place"] = lru_cache(maxsize=200_000)(lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim)
        place = held["place"]
        sizes = np.fromiter((len(ts) if ts is not None else 0 for ts in tokens), np.int64, len(tokens))
        places = np.fromiter((place(t) for ts in tokens if ts is not None for t in ts), np.int64, int(sizes.sum()))
        v = np.bincount(np.repeat(np.arange(len(sizes)) * dim, sizes) + places, minlength=len(sizes) * dim).astype(float).reshape(-1, dim)
        norm = np.sqrt((v * v).sum(axis=1))
        return pd.Series(list(v / np.where(norm > 0, norm, 1.0)[:, None]))

    return bounded_batches(docs).select(id_col, *(keep or []), vector(tokens_col).alias("embedding"))
