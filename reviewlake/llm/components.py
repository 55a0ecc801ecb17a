"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations over the edges; its result is written to the
shared folder, so lineage stays short and a lost executor costs one round. The
number of rounds grows with the logarithm of the longest path, not with
its length. Only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _to_min(pairs: DataFrame, own: bool) -> DataFrame:
    """For pairs (u, v): link every v to the least of u's neighbours and u itself."""
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = pairs.join(low, "u")
    out = j.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node on an edge (u, v)."""
    e = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above u move to the least neighbour
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its neighbours below move to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = written(_to_min(down, own=True), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
