"""Suffix-array dedup: repeated byte strings found bucket by bucket, ties by difference-cover ranks.

Every byte covered by a ``length``-byte string that also starts earlier (smaller doc_id, or the same
document at an earlier place) goes. Strings are judged on the input; none crosses documents.

Suffixes are compared to a depth of ``length`` bytes, so a suffix stands for the string (window) that
starts there.

1. Buckets. A window's bucket is its least 16-byte gram under a hash order, so equal windows share a
   bucket wherever they stand, and neighbouring windows mostly share one too: they travel as one
   run of bytes, not as ``length`` bytes each.
2. Runs with equal bytes collapse first: only hashes and places are shuffled. All but
   the first of equal runs go as a whole. A bucket left with one distinct run is done.
3. Blocks. The bytes of the other runs are fetched and dealt by bucket. A task takes its buckets in blocks
   of bounded size and sorts one block's suffixes at a time: by their first 31 bytes and the last
   31 of their depth, and where those tie by the precomputed ranks of difference-cover samples. The cover
   (6 residues of 31) has for every two places an offset below 31 at which both are
   samples, so two suffixes are equal exactly if their ends tie and they share a (offset, sample rank).
   Only samples, a fifth of all places, are ranked to the long depth of 70 bytes.

Skew: a bucket with more than ``HOT`` distinct runs in one task (or ``HOT_BUCKET`` in all) is
dealt by the 128-bit hashes of its windows instead, after collapsing equal ones within the task; so the
number of rows that meet in one task does not follow how often a passage occurs. Long texts are cut into slices
that overlap by ``length - 1`` bytes.

Each step is written to the shared folder, so lineage is short and shuffle files of finished steps can go.

Whole runs are compared by two 64-bit hashes (bucket and bytes) and windows of hot buckets by 128 bits;
blocks compare bytes.

Defined results: a null or empty text, or one shorter than ``length``, loses nothing; a null doc_id
is the smallest; rows with one doc_id and different texts are ordered by a hash of the text; rows that
repeat (doc_id, text) are one document and get the same result each; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, in_batches, release, whole_text, written

LENGTH = 100
GRAM = 16
HOT, HOT_BUCKET = 64, 4_000
SLICE = 2 << 20  # bytes hashed at once
FLUSH = 4_000_000  # runs held by a task before it collapses them
BLOCK = 2 << 20  # bytes of a block whose suffixes are sorted at once

V = 31
COVER = np.array([1, 5, 11, 24, 25, 27])  # a perfect difference set: all differences modulo 31 occur

RUN, GONE, OPEN, TOKEN = range(4)  # kinds of rows
ROWS = "kind int, to long, bucket long, content long, d long, r long, at long"


def _words(buf: np.ndarray, kind: str) -> np.ndarray:
    """The 8 bytes from every place as an integer; ``buf`` needs 8 spare bytes."""
    n = len(buf) - 8
    out = np.empty(n, np.uint64)
    for k in range(8):
        part = buf[k:k + (n - k + 7) // 8 * 8].view(kind)
        out[k::8] = part
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_of(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, bucket) of the runs in texts laid end to end; ``ends`` are the texts' ends."""
    n = len(buf)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    w = _words(np.concatenate([buf, np.zeros(24, np.uint8)]), "<u8")
    h = _mix(w[:n - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(w[8:n - GRAM + 9] + np.uint64(0x632BE59BD9B4E019)))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, m = length - GRAM + 1, key
    have = 1
    while have * 2 <= width:  # minimum over a power of two, then the rest by overlap
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        m = np.minimum(m[:len(m) - (width - have)], m[width - have:])
    place = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)  # leftmost among equal hashes
    valid = np.ones(len(place), bool)
    for e in ends[:-1]:
        valid[max(0, e - length + 1):e] = False
    cut = np.ones(len(place), bool)
    cut[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    # the end of one text and the start of the next may not share a run
    inner = ends[:-1]
    cut[inner[inner < len(cut)]] = True
    first = np.flatnonzero(cut)
    count = np.diff(np.r_[first, len(place)])
    keep = valid[first]
    return first[keep], count[keep], h[place[first[keep]]]


def _batch(kind, to, bucket, content, d, r, at) -> pa.RecordBatch:
    cols = [np.asarray(kind, np.int32), *(np.asarray(c).astype(np.uint64).view(np.int64) if np.asarray(c).dtype == np.uint64
                                          else np.asarray(c, np.int64) for c in (to, bucket, content, d, r, at))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "to", "bucket", "content", "d", "r", "at"])


def _collapse(bucket, content, d, r, at):
    """Order by (bucket, content, place); (order, first of its equals, place of that first equal to the own place)."""
    order = np.lexsort((at, r, d, content, bucket))
    b, c = bucket[order], content[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])] if len(b) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0)) if len(b) else np.zeros(0, np.int64)
    o = order[head] if len(b) else order
    again = (d[order] == d[o]) & (r[order] == r[o]) & (at[order] >> 7 == at[o] >> 7)  # a repeated row, not a repeated string
    return order, new, again


def _gone(d: np.ndarray, r: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows of runs that go; neighbouring runs of a text join into one, ``content`` is its number of windows."""
    start, n = at >> 7, at & 127
    order = np.lexsort((start, r, d))
    d, r, start, n = d[order], r[order], start[order], n[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (start[1:] > start[:-1] + n[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(d)] - 1 if len(d) else first
    d, r, n, start = d[first], r[first], start[last] + n[last] - start[first], start[first]
    return _batch(np.full(len(d), GONE), d ^ start, np.zeros(len(d)), n, d, r, start << 7)


def _map_task(length: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, content, d, r, at = (np.concatenate(c) for c in zip(*held, strict=True))
            order, new, again = _collapse(bucket, content, d, r, at)
            gone = order[~new & ~again]
            yield _gone(d[gone], r[gone], at[gone])
            first = order[new]
            names, back, many = np.unique(bucket[first], return_inverse=True, return_counts=True)
            busy = many > hot
            kind = np.where(busy[back], OPEN, RUN)
            to = np.where(busy[back], (d[first] ^ at[first]).astype(np.uint64), bucket[first])
            yield _batch(kind, to, bucket[first], content[first], d[first], r[first], at[first])
            tokens = names[busy]
            if len(tokens):
                z = np.zeros(len(tokens), np.int64)
                yield _batch(np.full(len(tokens), TOKEN), tokens, tokens, z, z, z, z)

        def take(parts: list[tuple[bytes, int, int, int]]) -> int:
            data = b"".join(p[0] for p in parts)
            ends = np.cumsum([len(p[0]) for p in parts])
            first, count, bucket = runs_of(np.frombuffer(data, np.uint8), ends, length)
            if not len(first):
                return 0
            owner = np.searchsorted(ends, first, side="right")
            begin = ends - np.array([len(p[0]) for p in parts])
            view = memoryview(data)
            hashes = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (first + count + length - 1).tolist(), strict=True)]
            d, r, base = (np.array([p[k] for p in parts], np.int64)[owner] for k in (1, 2, 3))
            held.append((bucket, np.array(hashes, np.uint64), d, r, (base + first - begin[owner]) << 7 | count))
            return len(first)

        parts: list[tuple[bytes, int, int, int]] = []
        waiting = 0
        for b in batches:
            for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = t.as_py().encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(text) - length + 1), SLICE):
                    piece = text[at:at + SLICE + length - 1]
                    parts.append((piece, d, r, at))
                    waiting += len(piece)
                    if waiting >= SLICE:
                        size += take(parts)
                        parts, waiting = [], 0
                    if size >= FLUSH:
                        yield from flush()
                        held.clear()
                        size = 0
        if parts:
            take(parts)
        if held:
            yield from flush()
    return run


def _bucket_task(hot_bucket: int):
    """Per partition of buckets: runs that repeat go; distinct runs of a shared bucket stay open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        kind, to, bucket, content, d, r, at = (c.to_numpy() for c in t.columns)
        passed = (kind == GONE) | (kind == OPEN)
        if passed.any():
            yield _batch(*(c[passed] for c in (kind, to, bucket, content, d, r, at)))
        tokens = np.unique(bucket[kind == TOKEN])
        own = kind == RUN
        bucket, content, d, r, at = (c[own] for c in (bucket, content, d, r, at))
        order, new, again = _collapse(bucket, content, d, r, at)
        gone = order[~new & ~again]
        yield _gone(d[gone], r[gone], at[gone])
        first = order[new]
        names, back, many = np.unique(bucket[first], return_inverse=True, return_counts=True)
        busy = np.isin(names, tokens) | (many > hot_bucket)
        stay = (many > 1) | busy
        f = first[stay[back]]
        # content tells the next step whether the bucket is dealt by windows
        yield _batch(np.full(len(f), OPEN), bucket[f], bucket[f], busy[back][stay[back]].astype(np.int64), d[f], r[f], at[f])
    return run


def _fetch_task(length: int):
    """(text, open runs) -> bytes by bucket; hashes of windows where the bucket is hot; no bytes for
    windows that are already known to go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "d", "r", "start", "data"]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names)

        windows: dict[bytes, tuple] = {}

        def hashed() -> pa.RecordBatch:
            return out([(int.from_bytes(h[:8], "little", signed=True), *p, h) for h, p in windows.items()])

        for b in batches:
            rows: list[tuple] = []
            for d, r, t, runs in zip(*(b.column(k) for k in range(4)), strict=True):
                d, r, text = d.as_py(), r.as_py(), t.as_py().encode("utf-8", "surrogatepass")
                for x in runs.as_py():
                    start, n = x["at"] >> 7, x["at"] & 127
                    if x["content"] == 0:
                        rows.append((x["bucket"], d, r, start, text[start:start + n + length - 1]))
                        continue
                    for s in range(start, start + n):
                        w = xxhash.xxh3_128_digest(text[s:s + length])
                        place = (d, r, s)
                        other = windows.get(w)
                        if other is None:
                            windows[w] = place
                        elif other != place:  # the later of two equal windows goes at once
                            windows[w] = min(other, place)
                            late = max(other, place)
                            rows.append((late[0] ^ late[2], *late, b""))
                    if len(windows) > 500_000:
                        yield hashed()
                        windows.clear()
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)
        if windows:
            yield hashed()
    return run


def _ranks(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Dense ranks of the ``depth`` bytes from each place, in byte order; equal strings get equal ranks."""
    if not len(places):
        return np.zeros(0, np.int64)
    full, rest = divmod(depth, 8)
    keys = [words[places + 8 * k] for k in range(full)]
    if rest:
        keys.append(words[places + 8 * full] >> np.uint64(64 - 8 * rest))
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _twins(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Windows whose polynomial hash (modulo 2**64) another window has too."""
    n = len(data)
    power = np.cumprod(np.full(n, _BASE, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])
    back = np.cumprod(np.full(n, _INVERSE, np.uint64))
    h = (total[start + length] - total[start]) * back[start]
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    return np.sort(order[np.r_[same, False] | np.r_[False, same]])


def later_equals(data: np.ndarray, begin: np.ndarray, size: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset) of every window of a block that equals one of an earlier place.

    Rows are runs of bytes laid end to end in ``data``; ``rank`` orders the rows by place.
    """
    words = _words(np.concatenate([data, np.zeros(length + 24, np.uint8)]), ">u8")
    n = size - length + 1
    row = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[row] + off
    # most windows of a bucket are its only ones: those that share no 64-bit rolling hash need no sorting
    twin = _twins(data, start, length)
    if not len(twin):
        return row[:0], off[:0]
    start, row, off = start[twin], row[twin], off[twin]
    # one rank over first and last 31 bytes of the depth
    both = _ranks(words, np.concatenate([start, start + length - V]), V)
    ends = both[:len(start)] * (both.max() + 1 if len(both) else 1) + both[len(start):]
    _, q, many = np.unique(ends, return_inverse=True, return_counts=True)
    tied = np.flatnonzero(many[q] > 1)
    if not len(tied):
        return row[:0], off[:0]
    start, row, off, q = start[tied], row[tied], off[tied], q[tied]
    # samples at the cover's residues, ranked to the depth that the ends do not reach
    shift = (COVER[None, :] - start[:, None]) % V
    sample = (start[:, None] + shift).reshape(-1)
    places, which = np.unique(sample, return_inverse=True)
    deep = _ranks(words, places, length - V + 1)[which]
    place = rank[row].astype(np.int64) << 32 | off
    key = (np.repeat(q, len(COVER)).astype(np.uint64) << np.uint64(36)) | (deep.astype(np.uint64) << np.uint64(5)) | shift.reshape(-1).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    least = np.minimum.reduceat(np.repeat(place, len(COVER))[order], cut)
    group = np.zeros(len(k), np.int64)
    group[cut[1:]] = 1
    found = np.empty(len(k), np.int64)
    found[order] = least[np.cumsum(group)]
    late = found.reshape(-1, len(COVER)).min(axis=1) < place
    return row[late], off[late]


def _spans(d, r, start, length: int) -> pa.RecordBatch:
    """Windows at ``start`` as spans of bytes; neighbours of a text join."""
    order = np.lexsort((start, r, d))
    d, r, start = d[order], r[order], start[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(d)] - 1 if len(d) else first
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (d[first], r[first], start[first], start[last] + length)], ["d", "r", "lo", "hi"])


def _first_seen(keys: list[np.ndarray], d, r, start) -> np.ndarray:
    """Rows that equal (in all ``keys``) a row of an earlier place."""
    order = np.lexsort((start, r, d, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order[(d[order] != d[head]) | (r[order] != r[head]) | (start[order] != start[head])]


def _solved(t: pa.Table, length: int) -> Iterator[pa.RecordBatch]:
    """The windows that go among whole buckets (key, d, r, start, data)."""
    size = pc.binary_length(t.column("data")).to_numpy()
    for kind in (size == 0, size == 16, size > 16):
        if not kind.any():
            continue
        part = t.filter(pa.array(kind)).combine_chunks()
        d, r, start = (part.column(k).to_numpy() for k in ("d", "r", "start"))
        data = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8)
        if size[kind].max() == 0:  # known to go
            yield _spans(d, r, start, length)
        elif size[kind].max() == 16:  # windows by their hash
            h = data.view("<u8").reshape(-1, 2)
            late = _first_seen([h[:, 0], h[:, 1]], d, r, start)
            yield _spans(d[late], r[late], start[late], length)
        else:
            n = size[kind].astype(np.int64)
            order = np.lexsort((start, r, d))
            # equal places (a repeated row) share a rank
            step = np.ones(len(order), np.int64)
            step[1:] = (np.diff(d[order]) != 0) | (np.diff(r[order]) != 0) | (np.diff(start[order]) != 0)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(step)
            row, off = later_equals(data, np.cumsum(n) - n, n, rank, length)
            yield _spans(d[row], r[row], start[row] + off, length)


def _block_task(length: int, block: int):
    """Partition sorted by bucket -> spans that go, block after block of whole buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= block:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                end = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if end:  # the last bucket may go on in the next batch
                    yield from _solved(t.slice(0, end), length)
                    held = t.slice(end).to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from _solved(pa.Table.from_batches(held), length)
    return run


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> what is left of each text."""
    for b in batches:
        rows = []
        for doc, t, spans in zip(b.column(0), b.column(1), b.column(2), strict=True):
            data = t.as_py().encode("utf-8", "surrogatepass")
            kept, at, n = [], 0, 0
            for s in sorted(((x["lo"], x["hi"]) for x in spans.as_py() or ())):
                if s[0] > at or not n:  # a new maximal run
                    n += 1
                    kept.append(data[at:s[0]])
                    at = s[1]
                else:
                    at = max(at, s[1])
            kept.append(data[at:])
            left = b"".join(kept)
            rows.append((doc.as_py(), left, len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                         ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH,
                 hot: int = HOT, hot_bucket: int = HOT_BUCKET, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, kept (the bytes left), n_bytes, n_removed, n_spans, kept_sha256."""
    if not 2 * V <= length < 128 + GRAM:
        raise ValueError(f"length must lie between {2 * V} and {127 + GRAM} bytes")
    spark = docs.sparkSession
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), id_key(doc_id).alias("d"), F.xxhash64(whole_text(text)).alias("r"),
                      whole_text(text).alias("t"))
    runs = in_batches(src.select("d", "r", "t")).mapInArrow(_map_task(length, hot), ROWS)
    judged = written(runs.repartition("to").mapInArrow(_bucket_task(hot_bucket), ROWS), "runs")
    release(spark)
    still = judged.where(F.col("kind") == OPEN)
    # rows opened in the map step are hot; the bucket step says so of its own in ``content``
    asked = still.select("d", "r", "at", "bucket", F.when(F.col("to") == F.col("bucket"), F.col("content")).otherwise(1).alias("content"))
    lists = asked.groupBy("d", "r").agg(F.collect_list(F.struct("at", "bucket", "content")).alias("runs"))
    fetched = src.select("d", "r", "t").join(lists.hint("shuffle_hash"), ["d", "r"]).select("d", "r", "t", "runs").mapInArrow(
        _fetch_task(length), "key long, d long, r long, start long, data binary")
    dealt = fetched.repartition("key").sortWithinPartitions("key")
    spans = written(dealt.mapInArrow(_block_task(length, block), "d long, r long, lo long, hi long"), "spans")
    release(spark)
    whole = judged.where(F.col("kind") == GONE).select("d", "r", F.shiftright("at", 7).alias("lo"), (
        F.shiftright("at", 7) + F.col("content") + (length - 1)).alias("hi"))
    by_doc = whole.unionByName(spans).groupBy("d", "r").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    j = src.join(by_doc.hint("shuffle_hash"), ["d", "r"], "left").select("doc_id", "t", "spans")
    return j.mapInArrow(_cut_task, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
