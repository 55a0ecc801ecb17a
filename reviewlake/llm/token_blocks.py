"""Token ids in a binary format of patched frame-of-reference blocks.

A segment holds whole documents in ascending doc_id order. Its ids are cut into
blocks of 256; a block subtracts its minimum and packs the rest at the width that
covers the ``percentile`` of its values; larger values keep their low bits in place
and their whole value in an exception list. An index of block starts lets a reader decode any range of
ids without the rest.

Segment layout, little-endian:

    "PFR1" | u32 documents | u64 ids | u32 blocks
    i64 doc_id per document | u8 1 where doc_id is null | u32 ids per document
    u64 start of each block, and of the end, from the first block
    block: u32 minimum | u8 width | u8 0 | u16 exceptions | packed u64 words | u8 place per exception, padded to 4 | u32 value per exception

Texts are dealt by doc_id ranges, sorted within a partition and encoded there;
segments go into a Parquet table as their container, so Spark's committer makes a
rewritten task harmless. Only per-partition totals are needed to number the ids of the
whole corpus.

Defined results: a null or empty text is the end id alone; a null doc_id sorts
first and is kept; repeated rows are written each, those of one doc_id in the
order of their texts; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, in_batches, whole_text
from .tokens import encoder

BLOCK, PERCENTILE, END_ID = 256, 90.0, 0
SEGMENT_IDS = 1 << 20
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQI")
_BLOCK_HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("extra", "<u2")])

SEGMENTS = "part int, segment int, first long, n_ids long, payload binary"


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) unsigned values below 2**width -> (n, 4 * width) words of 64 bits."""
    out = np.zeros((4 * width, len(rows)), np.uint64)
    lanes = np.ascontiguousarray(rows.T.astype(np.uint64))
    for i in range(BLOCK):
        word, bit = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, len(words)), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK):
        word, bit = divmod(i * width, 64)
        v = lanes[word] >> np.uint64(bit)
        if bit + width > 64:
            v = v | (lanes[word + 1] << np.uint64(64 - bit))
        out[i] = v & mask
    return np.ascontiguousarray(out.T)


def encode_segment(doc_ids: list[int | None], texts: list[bytes], percentile: float = PERCENTILE) -> bytes:
    """A segment from each document's ids (little-endian unsigned 32 bit)."""
    ids = np.frombuffer(b"".join(texts), "<u4")
    n = len(ids)
    blocks = -(-n // BLOCK)
    rows = np.empty((blocks, BLOCK), np.uint32)
    flat = rows.reshape(-1)
    flat[:n] = ids
    if n < len(flat):
        flat[n:] = ids[-1]
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows -= low[:, None]
    at = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    chosen = np.partition(rows, at, axis=1)[:, at] if blocks else low
    widths = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.int64)
    body: list[bytes] = [b""] * blocks
    for w in np.unique(widths):
        these = np.flatnonzero(widths == w)
        part = rows[these]
        over = part >= np.uint64(1) << np.uint64(w)
        extra = over.sum(axis=1)
        heads = np.zeros(len(these), _BLOCK_HEAD)
        heads["low"], heads["width"], heads["extra"] = low[these], w, extra
        packed = _pack(part & np.uint32((1 << int(w)) - 1), int(w)) if w else np.zeros((len(these), 0), np.uint64)
        places = np.nonzero(over)[1].astype(np.uint8)
        values = part[over]
        ends = np.cumsum(extra)
        for k, b in enumerate(these):
            s, e = ends[k] - extra[k], ends[k]
            body[b] = (heads[k].tobytes() + packed[k].tobytes() + places[s:e].tobytes() + bytes(-int(extra[k]) % 4)
                       + values[s:e].tobytes())
    starts = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype("<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    sizes = np.array([len(t) // 4 for t in texts], "<u4")
    head = _HEAD.pack(_MAGIC, len(doc_ids), n, blocks)
    return b"".join([head, known.tobytes(), null.tobytes(), sizes.tobytes(), starts.tobytes(), *body])


class Segment:
    """A reader of one segment; ids are decoded block by block on demand."""

    def __init__(self, data: bytes):
        magic, docs, self.n_ids, self.n_blocks = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a segment")
        at = _HEAD.size
        self.data = data
        known = np.frombuffer(data, "<i8", docs, at)
        null = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.sizes = np.frombuffer(data, "<u4", docs, at + 9 * docs)
        self.doc_ids = [None if z else int(d) for d, z in zip(known, null, strict=True)]
        at += 13 * docs
        self.starts = np.frombuffer(data, "<u8", self.n_blocks + 1, at)
        self.at = at + 8 * (self.n_blocks + 1)

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids from ``lo`` to ``hi``, reading only their blocks."""
        hi = self.n_ids if hi is None else hi
        if hi <= lo:
            return np.zeros(0, np.uint32)
        b0, b1 = lo // BLOCK, -(-hi // BLOCK)
        offsets = self.at + self.starts[b0:b1].astype(np.int64)
        raw = np.frombuffer(self.data, np.uint8)
        heads = raw[offsets[:, None] + np.arange(_BLOCK_HEAD.itemsize)].copy().view(_BLOCK_HEAD)[:, 0]
        rows = np.zeros((b1 - b0, BLOCK), np.uint32)
        for w in np.unique(heads["width"]):
            w = int(w)
            these = np.flatnonzero(heads["width"] == w)
            start = offsets[these] + _BLOCK_HEAD.itemsize
            if w:
                rows[these] = _unpack(raw[start[:, None] + np.arange(32 * w)].copy().view("<u8"), w)
            for k, s, n in zip(these, start + 32 * w, heads["extra"][these].astype(int), strict=True):
                if n:
                    rows[k, raw[s:s + n]] = np.frombuffer(self.data, "<u4", n, s + n + -n % 4)
        rows += heads["low"][:, None]
        return rows.reshape(-1)[lo - b0 * BLOCK:hi - b0 * BLOCK]


def write_blocks(docs: DataFrame, path: str, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
                 end_id: int = END_ID, percentile: float = PERCENTILE, segment_ids: int = SEGMENT_IDS) -> None:
    """Tokenise every text and write segments in ascending doc_id order to ``path``."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = segment = first = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                pa.array([held], pa.int64()), pa.array([encode_segment(ids, texts, percentile)], pa.binary())],
                ["part", "segment", "first", "n_ids", "payload"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = encode(t.as_py()) + end
                ids.append(d)
                texts.append(got)
                held += len(got) // 4
                if held >= segment_ids:
                    yield flush()
                    segment, first, held, ids, texts = segment + 1, first + held, 0, [], []
        if ids:
            yield flush()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).alias("t"), id_key(doc_id).alias("_d"))
    dealt = src.repartitionByRange("_d").sortWithinPartitions("_d", "t").select("doc_id", "t")
    in_batches(dealt).mapInArrow(run, SEGMENTS).write.parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    """Per document, from the files at ``path``: doc_id, start, n_tokens, ids (little-endian unsigned 32 bit)."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the writer
    base = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = segments.join(F.broadcast(base), "part").select((F.col("base") + F.col("first")).alias("at"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Segment(payload.as_py())
                ids = s.ids().astype("<u4").tobytes()
                ends = np.cumsum(s.sizes, dtype=np.int64)
                cut = [ids[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), s.sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(s.doc_ids, pa.int64()), pa.array(at + ends - s.sizes, pa.int64()),
                    pa.array(s.sizes.astype(np.int64)), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
