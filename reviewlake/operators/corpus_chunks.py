"""Recursive chunks of one corpus that is spread over many rows.

``chunk_corpus`` gives the chunks that ``chunking.split_recursive`` would cut from the rows' texts
joined in order, so a chunk may span rows, yet no task holds more than a block of the corpus:

1. Rows are laid out in order once (range partitions, written). Character offsets and the run of line
   breaks before a row are running values over the partitions: one small row per partition is summed.
2. The corpus is cut into blocks of ``block`` characters; a block also gets the few thousand characters around it that
   its own cuts depend on.
3. The level at which the splitter cuts at a character depends on the distance to the nearest separators, and the
   chunk that starts at a piece, and the piece where the chunk after it starts, on the next two chunk
   lengths: all of it is computed inside the block with numpy.
4. Where a block's first chunk starts depends on all blocks before it. Each block therefore tells, for every piece at
   which it may be entered (within one chunk length of its start), where the next block is then entered.
   In most blocks all entries lead to the same exit; chains of other blocks are followed by pointer doubling
   over the table of entries.
5. With its entry known, each block writes the chunks that start in it.

Defined results: null texts are empty; rows whose order keys tie are ordered by their text, so
equal rows are interchangeable; an empty corpus has no chunk; blank chunks go, as in the splitter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE
from reviewlake.session import bounded_batches, stored

#: Characters of a block; a task holds one block and its surroundings at a time.
BLOCK = 1 << 20

_BLANK, _LINE, _SPACE, _CHAR = range(4)  # levels: blank line, line break, space, single characters


def _margins(size: int) -> tuple[int, int]:
    """Characters before and after a block that decide its cuts: a piece's level needs ``size`` on either side, the
    last chunk that starts in the block needs two chunk lengths more."""
    return size + 2, 3 * size + 2


def _before(mask: np.ndarray, none: int) -> np.ndarray:
    """For each position the last marked one up to it, else ``none``."""
    at = np.where(mask, np.arange(len(mask)), none)
    return np.maximum.accumulate(at)


def _after(mask: np.ndarray, none: int) -> np.ndarray:
    """For each position the first marked one after it, else ``none``."""
    at = np.where(mask, np.arange(len(mask)), none)
    return np.append(np.minimum.accumulate(at[::-1])[::-1][1:], none)


class Pieces:
    """The pieces of a stretch of the corpus and where the chunks that start at them lead.

    ``odd``: an odd number of line breaks comes right before the stretch; ``first`` and ``last``: it opens or closes
    the corpus. Positions count from its start."""

    def __init__(self, text: str, size: int, overlap: int, odd: bool = False, first: bool = True, last: bool = True):
        self.text, self.size, self.overlap = text, size, overlap
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(cp)
        here = np.arange(n)
        line = cp == 10
        # blank lines are cut off a run of line breaks two at a time, from its start
        start = _before(~line, -1) + 1
        nth = here - start + np.where(start == 0, int(odd), 0)
        blank = line & np.append(line[1:], False) & (nth % 2 == 0)
        cuts = [blank, line, cp == 32]
        level = np.full(n, _CHAR)
        settled = np.zeros(n, bool)
        any_cut = np.zeros(n, bool)
        if first and n:
            any_cut[0] = True
        begins = np.ones(n, bool)
        grade = np.full(n, _CHAR)  # the coarsest level that cuts before a character
        far = 4 * size + n  # a piece whose ends lie outside is long: only the margins are wrong in that
        for lv, cut in enumerate(cuts):
            any_cut = any_cut | cut
            grade[cut] = np.minimum(grade[cut], lv)
            lo = _before(any_cut, -far)
            hi = _after(any_cut, n if last else far)
            short = (hi - lo < size) & ~settled
            level[short] = lv
            begins[short] = any_cut[short]
            settled |= short
        if first and n:
            grade[0] = -1
        prior = np.append(_CHAR + 1, level[:-1])
        fresh = begins & ((grade < level) | (prior > level))
        self.at = np.flatnonzero(begins)
        ends = np.append(self.at[1:], n)
        # per piece: the end of its run of pieces that are merged with each other
        runs = np.append(np.flatnonzero(fresh[self.at]), len(self.at))
        run_end = np.append(self.at, n)[runs[np.searchsorted(runs, np.arange(len(self.at)), "right")]]
        over = np.searchsorted(ends, self.at + size, "right")  # the first piece that does not fit the chunk any more
        cut_at = np.append(self.at, n)[np.minimum(over, len(self.at))]
        whole = cut_at >= run_end
        self.end = np.where(whole, run_end, cut_at)
        stop = np.append(ends, n)[np.minimum(over, len(self.at))]
        again = np.maximum(cut_at - overlap, np.minimum(stop - size, cut_at))
        self.next = np.where(whole, np.searchsorted(self.at, run_end), np.searchsorted(self.at, again))

    def exits(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces within a chunk length of ``lo`` at which the stretch [lo, hi) may be entered, and the piece
        at or after ``hi`` that their chains reach first (both as positions)."""
        at = np.append(self.at, len(self.text))
        hi = min(hi, len(self.text))
        i, j = np.searchsorted(self.at, [lo, lo + self.size + 1])
        jump = np.append(self.next, len(self.at))
        reached = np.arange(i, j)
        while True:
            open_ = at[reached] < hi
            if not open_.any():
                return self.at[i:j], at[reached]
            reached = np.where(open_, jump[reached], reached)
            # positions beyond ``hi`` stay; the others jump twice as far the next time
            jump = np.where(at[jump] < hi, jump[jump], jump)

    def chunks(self, entry: int, hi: int) -> Iterator[tuple[int, str]]:
        """(start, text) of the chunks of the chain from ``entry`` that start before ``hi``."""
        p = int(np.searchsorted(self.at, entry))
        while p < len(self.at) and self.at[p] < hi:
            cut = self.text[self.at[p]:self.end[p]].strip()
            if cut:
                yield int(self.at[p]), cut
            p = int(self.next[p])


def _carry(text: str, run: int) -> int:
    """Line breaks at the end of the corpus so far, ``run`` of them before ``text``."""
    kept = len(text) - len(text.rstrip("\n"))
    return kept + (run if kept == len(text) else 0)


def _laid_out(rows: DataFrame, order_by: list[str], text: str, partitions: int | None) -> DataFrame:
    """(pid, at, odd, t): texts in order within their partitions, and the offset and the line breaks before each partition."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"_k{i}" for i in range(len(order_by))]
    src = rows.select(*[F.col(c).alias(k) for c, k in zip(order_by, keys)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    laid = src.repartitionByRange(n, *keys, F.xxhash64("t")).sortWithinPartitions(*keys, "t").select("t").checkpoint(eager=True)
    laid = laid.select(F.spark_partition_id().alias("pid"), "t")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, chars, run, whole = None, 0, 0, True
        for b in batches:
            for p, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                pid, chars, run, whole = p, chars + len(t), _carry(t, run), whole and not t.strip("\n")
        if pid is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([chars], pa.int64()), pa.array([run], pa.int64()),
                                              pa.array([whole])], ["pid", "chars", "run", "whole"])

    # one row per partition: offsets and runs of line breaks are summed over them in order
    sums = laid.mapInArrow(measure, "pid int, chars long, run long, whole boolean")
    w = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pid", F.coalesce(F.sum("chars").over(w), F.lit(0)).alias("at"),
                       F.max(F.when(~F.col("whole"), F.col("pid"))).over(w).alias("_last"), "chars", "run")
    sums = stored(sums, "corpus-partitions")
    own = sums.select(F.col("pid").alias("_last"), (F.col("at") + F.col("chars") - F.col("run")).alias("_since"))
    # all since the last partition with other characters is line breaks, after those at its end
    sums = sums.join(F.broadcast(own), "_last", "left").select("pid", "at", (F.col("at") - F.coalesce("_since", F.lit(0))).alias("run"))
    return laid.join(F.broadcast(sums), "pid").select("at", "run", "t")


def _blocks(rows: DataFrame, order_by: list[str], text: str, size: int, block: int, partitions: int | None) -> DataFrame:
    """(block, at, odd, last, text): every block with its margins, as a written table."""
    left, right = _margins(size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            found: list[tuple] = []
            for base, before, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = t.as_py()
                if at is None:
                    at, run = base, before
                # blocks whose stretch [k * block - left, (k + 1) * block + right) meets the row
                for k in range(max(0, (at - right) // block), (at + len(t) + left) // block + 1):
                    lo, hi = max(at, k * block - left), min(at + len(t), (k + 1) * block + right)
                    if lo < hi:
                        part = t[lo - at:hi - at]
                        found.append((k, lo, _carry(t[:lo - at], run) % 2 == 1, hi, part))
                run = _carry(t, run)
                at += len(t)
            if found:
                k, lo, odd, hi, part = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(lo, pa.int64()), pa.array(odd, pa.bool_()),
                                                  pa.array(hi, pa.int64()), pa.array(part, pa.string())], ["block", "lo", "odd", "hi", "part"])

    parts = _laid_out(rows, order_by, text, partitions).mapInArrow(cut, "block long, lo long, odd boolean, hi long, part string")
    # a block is bounded by its characters: a gather of at most block + margins of them
    joined = parts.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("lo", "part", "odd"))).alias("p"), F.max("hi").alias("hi"))
    joined = joined.select("block", F.col("p")[0]["lo"].alias("at"), F.col("p")[0]["odd"].alias("odd"), "hi",
                           F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"))
    out = stored(joined, "corpus-blocks")
    # a block that ends before its right margin does holds the corpus' end
    return out.withColumn("last", F.col("hi") < (F.col("block") + 1) * F.lit(block) + F.lit(right))


def _pieces(b: pa.RecordBatch, size: int, overlap: int) -> Iterator[tuple[int, int, Pieces]]:
    for k, at, odd, last, t in zip(*(b.column(n).to_pylist() for n in ("block", "at", "odd", "last")), b.column("text")):
        yield k, at, Pieces(t.as_py(), size, overlap, odd, at == 0, last)


def _entries(blocks: DataFrame, size: int, overlap: int, block: int) -> DataFrame:
    """(block, entry): the offset of the first chunk that starts in each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, at, pieces in _pieces(b, size, overlap):
                lo = k * block
                entry, leave = (x + at for x in pieces.exits(lo - at, lo + block - at))
                if k == 0:
                    entry, leave = entry[:1], leave[:1]
                if len(entry) and (leave == leave[0]).all():  # wherever it is entered, it is left at one place
                    entry, leave = [None], leave[:1]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(entry), pa.int64()), pa.array(entry, pa.int64()),
                                                  pa.array(leave, pa.int64())], ["block", "entry", "leave"])

    exits = stored(blocks.mapInArrow(run, "block long, entry long, leave long"), "corpus-exits")
    known = exits.where("entry is null").select((F.col("block") + 1).alias("block"), F.col("leave").alias("entry"))
    spark = blocks.sparkSession
    known = known.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("entry")))
    hops = exits.where("entry is not null").select("block", "entry", (F.col("block") + 1).alias("to"), "leave")
    while not hops.isEmpty():  # each round follows twice as many blocks as the one before
        reached = known.join(hops, ["block", "entry"]).select(F.col("to").alias("block"), F.col("leave").alias("entry"))
        known = stored(known.unionByName(reached).distinct(), "corpus-entries")
        on = hops.select(F.col("block").alias("to"), F.col("entry").alias("leave"), F.col("to").alias("_to"), F.col("leave").alias("_leave"))
        hops = stored(hops.join(on, ["to", "leave"]).select("block", "entry", F.col("_to").alias("to"), F.col("_leave").alias("leave")), "corpus-hops")
    return known


def chunk_corpus(rows: DataFrame, order_by: list[str], text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                 block: int = BLOCK, partitions: int | None = None) -> DataFrame:
    """(start, text): the chunks of the rows' texts joined in the order of ``order_by``; ``start`` is the offset of a
    chunk's first character (before the white space at its edges goes) and orders them."""
    if not 1 < size <= block or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size and 1 < size <= block are needed")
    blocks = _blocks(bounded_batches(rows), order_by, text, size, block, partitions)
    entries = _entries(blocks, size, overlap, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entry, (k, at, pieces) in zip(b.column("entry").to_pylist(), _pieces(b, size, overlap)):
                got = list(pieces.chunks(entry - at, (k + 1) * block - at))
                yield pa.RecordBatch.from_arrays([pa.array([at + s for s, _ in got], pa.int64()), pa.array([c for _, c in got], pa.string())],
                                                 ["start", "text"])

    return blocks.join(entries, "block").mapInArrow(run, "start long, text string")
