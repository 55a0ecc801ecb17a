"""SimHash near-dedup: a self-join of binary tries over distinct fingerprints.

A fingerprint bit is the majority of that bit over the XXH64 hashes (seed 42)
of a text's word shingles. Two fingerprints link when at most ``max_bits`` bits
differ. Copies collapse first: the join only sees distinct fingerprints.

The trie join walks node pairs from the root down, adds up the bits in which
the two paths differ and drops a pair once the budget is exceeded. To deal it
out, the 64 bits are cut into ``max_bits + 1`` blocks; a linked pair agrees on one
block at least, so one trie per block, rotated to start with it, is
partitioned by that block's value: a task holds whole subtrees below a shared
first block. Subtrees larger than ``max_subtree`` are split by their next
bits into node pairs within the budget, and these again, until none is above it. Within a task, pairs of nodes whose leaves
are all known to be connected are dropped, and only joining links (a
spanning forest) leave the task, so a large group of near copies yields as many rows as
members, not all pairs.

Defined results: a null or empty text, or one without words, has fingerprint
zero and links like any other; texts of fewer words than a shingle are one shingle; a
null doc_id counts as the smallest id in component_id and is passed on in
doc_id; repeated rows get the same result; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, in_batches, whole_text, written
from .components import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
MAX_SUBTREE = 500_000
_PART = 1 << 20  # shingles whose bits are counted at once
_STEP = 4  # bits by which a subtree above the bound is split in a round


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower: A-Z only; bytes.split: \x20, \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _PART):
        part = shingles[at:at + _PART]
        bits = np.unpackbits(np.frombuffer(b"".join(map(xxhash.xxh64_digest, part, repeat(SEED))), np.uint8))
        votes += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(shingles)).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, _d, _r, fp): the row's id, its key, a hash of its text and its fingerprint."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "_d", "_r", "fp"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), id_key(doc_id).alias("_d"),
                    F.xxhash64(whole_text(text)).alias("_r"), whole_text(text).alias("_t"))
    return in_batches(d).mapInArrow(run, "doc_id long, _d long, _r long, fp long")


class _Forest:
    """Union-find over 0..n-1 that keeps labels as an array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []
        self.runs()

    def runs(self) -> None:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q
        self.parent = p
        self.run = np.cumsum(np.r_[0, p[1:] != p[:-1]]) if len(p) else p

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.parent[i] != self.parent[j]
        if not new.any():
            return
        p = self.parent
        for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
            x, y = a, b
            while p[x] != x:
                p[x] = p[p[x]]
                x = p[x]
            while p[y] != y:
                p[y] = p[p[y]]
                y = p[y]
            if x != y:
                p[max(x, y)] = min(x, y)
                self.links.append((a, b))
        self.runs()

    def done(self, a0, a1, b0, b1) -> np.ndarray:
        """Pairs of ranges all of whose members are already connected."""
        r, p = self.run, self.parent
        return (r[a0] == r[a1 - 1]) & (r[b0] == r[b1 - 1]) & (p[a0] == p[b0])


def trie_links(x: np.ndarray, depth: int, max_bits: int, step: int = 1 << 13) -> list[tuple[int, int]]:
    """Links that connect the sorted distinct ``x`` (uint64) as all pairs within ``max_bits`` would.

    Only pairs that agree in the first ``depth`` bits are looked at.
    """
    n = len(x)
    forest = _Forest(n)
    if n < 2:
        return []
    top = x >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
    near = np.flatnonzero((top[1:] == top[:-1]) & (np.bitwise_count(x[1:] ^ x[:-1]) <= max_bits))
    forest.join(near, near + 1)
    cut = np.flatnonzero(np.r_[True, top[1:] != top[:-1]])
    lo, hi = cut, np.r_[cut[1:], n]
    big = hi - lo > 1
    stack = [(depth, np.stack([lo[big], hi[big], lo[big], hi[big], np.zeros(big.sum(), np.int64)]))]
    while stack:
        d, nodes = stack.pop()
        if nodes.shape[1] > step:  # depth first, a bounded number of node pairs at a time
            stack.append((d, nodes[:, step:]))
            nodes = nodes[:, :step]
        nodes = nodes[:, ~forest.done(*nodes[:4])]
        a0, a1, b0, b1, bits = nodes
        small = ((a1 - a0) * (b1 - b0) <= 16) | (d == 64)
        if small.any():  # leaves: compare the few pairs outright
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            w = t1 - t0
            k = (s1 - s0) * w
            owner = np.repeat(np.arange(len(k)), k)
            nth = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            i, j = s0[owner] + nth // w[owner], t0[owner] + nth % w[owner]
            ok = (i < j) & (np.bitwise_count(x[i] ^ x[j]) <= max_bits)
            forest.join(i[ok], j[ok])
        a0, a1, b0, b1, bits = nodes[:, ~small]
        if not len(a0):
            continue
        bit = np.uint64(1) << np.uint64(63 - d)
        low = bit | (bit - np.uint64(1))
        am = np.searchsorted(x, (x[a0] & ~low) | bit)
        bm = np.searchsorted(x, (x[b0] & ~low) | bit)
        same = a0 == b0
        kids = [(a0, am, b0, bm, bits), (am, a1, bm, b1, bits), (a0, am, bm, b1, bits + 1)]
        other = ~same  # of a node with itself, (right, left) is (left, right) again
        kids.append((am[other], a1[other], b0[other], bm[other], bits[other] + 1))
        out = np.concatenate([np.stack(k) for k in kids], axis=1)
        live = (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= max_bits) & ~(
            (out[0] == out[2]) & (out[1] - out[0] == 1))
        if live.any():
            stack.append((d + 1, out[:, live]))
    return forest.links


def _rotated(fp, by: int):
    if by == 0:
        return fp
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def _task(max_bits: int, starts: list[int], widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        block, node = t.column("block").to_numpy(), t.column("node").to_numpy()
        x = t.column("x").to_numpy().view(np.uint64)
        for r in np.unique(block):
            for k in np.unique(node[block == r]):
                # node -1: whole subtrees below their first block; else one pair of split nodes
                at = np.unique(x[(block == r) & (node == k)])
                links = np.array(trie_links(at, widths[r], max_bits), np.int64).reshape(-1, 2)
                if len(links):
                    by = np.uint64(starts[r])
                    u, v = (at if by == 0 else (at >> by) | (at << (np.uint64(64) - by)) for at in at[links].T)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])
    return run


def _split(hot: DataFrame, groups: dict[int, tuple[int, int, int]], widths: list[int], max_bits: int, max_subtree: int) -> DataFrame:
    """``hot`` (block, x, top, node) dealt to pairs of nodes of at most ``max_subtree`` fingerprints.

    ``groups`` names the block and the two prefixes (below the first block) of a node pair. Every round
    appends the next bits to the prefixes of the pairs above the bound; only pairs within the budget whose
    sides both hold fingerprints go on, so the driver sees a bounded number of counts per such pair.
    """
    spark = hot.sparkSession
    hot = hot.withColumn("own", F.lit(0).cast("long"))
    done, used, named = [], 0, max(groups) + 1
    while groups:
        steps = [max(0, min(_STEP, 64 - w - used)) for w in widths]
        of_block = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("block") + 1)
        child = F.call_function("shiftrightunsigned", F.call_function("shiftleft", F.col("x"), of_block([w + used for w in widths])),
                                of_block([64 - s for s in steps]))
        grown = F.call_function("shiftleft", F.col("own"), of_block(steps)).bitwiseOR(child)
        hot = written(hot.withColumn("own", grown), "split-nodes")
        held: dict[int, dict[int, int]] = {k: {} for k in groups}
        for r in hot.groupBy("node", "own").count().collect():
            held[r["node"]][r["own"]] = r["count"]
        table, after = [], {}
        for node, (block, a, b) in groups.items():
            count, step = held[node], steps[block]
            for p in (p for p in count if p >> step == a):
                for q in (q for q in count if q >> step == b):
                    if (p ^ q).bit_count() > max_bits or a == b and p > q or p == q and count[p] == 1:
                        continue
                    more = count[p] + (count[q] if p != q else 0) > max_subtree and widths[block] + used + step < 64
                    table += [(node, own, named, more) for own in {p, q}]
                    if more:
                        after[named] = (block, p, q)
                    named += 1
        pairs = spark.createDataFrame(table, "node long, own long, pair long, more boolean")
        dealt = hot.join(F.broadcast(pairs), ["node", "own"]).select("block", "x", "top", F.col("pair").alias("node"), "own", "more")
        done.append(dealt.where("not more").select("block", "x", "top", "node"))
        hot, groups, used = dealt.where("more").drop("more"), after, used + _STEP
    return reduce(DataFrame.unionByName, done)


def links(fps: DataFrame, max_bits: int = MAX_BITS, max_subtree: int = MAX_SUBTREE) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints of ``fps`` (fp) as all pairs within the budget would."""
    blocks = max_bits + 1
    starts = [64 * k // blocks for k in range(blocks)]
    widths = [64 * (k + 1) // blocks - s for k, s in enumerate(starts)]
    rows = fps.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), _rotated(F.col("fp"), starts[k]).alias("x"),
                 F.shiftrightunsigned(_rotated(F.col("fp"), starts[k]), 64 - widths[k]).alias("top"))
        for k in range(blocks)])).alias("s")).select("s.*")
    # Subtrees above the bound: counted for all, the few large ones are split by their next bits.
    size = rows.groupBy("block", "top").count().where(F.col("count") > max_subtree)
    large = [(r["block"], r["top"], k) for k, r in enumerate(size.collect()) if widths[r["block"]] < 64]  # at most rows / max_subtree
    if large:
        marked = rows.join(F.broadcast(fps.sparkSession.createDataFrame(large, "block int, top long, node long")), ["block", "top"], "left")
        hot = marked.where("node is not null").select("block", "x", "top", "node")
        rows = marked.where("node is null").select("block", "x", "top", F.lit(-1).cast("long").alias("node")).unionByName(
            _split(hot, {k: (r, 0, 0) for r, _, k in large}, widths, max_bits, max_subtree))
    else:
        rows = rows.withColumn("node", F.lit(-1).cast("long"))
    dealt = rows.repartition("block", "top", "node").select("block", "node", "x")
    return dealt.mapInArrow(_task(max_bits, starts, widths), "u long, v long")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                  max_bits: int = MAX_BITS, max_subtree: int = MAX_SUBTREE) -> DataFrame:
    """Per row: doc_id, fp (signed long), component_id (the smallest doc_id reachable), _d and _r, and the
    _r of the group's least (_d, _r) as _first."""
    rows = written(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(F.struct("_d", "_r")).alias("low"))
    found = written(links(nodes.select("fp"), max_bits, max_subtree), "links")
    roots = components(found).withColumnRenamed("node", "fp")
    least = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    label = least.groupBy("root").agg(F.min("low").alias("low"))
    label = label.select("root", F.col("low._d").alias("component_id"), F.col("low._r").alias("_first"))
    named = written(least.select("fp", "root").join(label, "root").select("fp", "component_id", "_first"), "labels")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "_d", "_r", "_first")
