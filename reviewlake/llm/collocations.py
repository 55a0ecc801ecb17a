"""Phrases that occur far more often than their parts, per language (operator 11).

Rabin-Karp over numpy arrays: prefix polynomials give every word of an Arrow batch its fingerprint from the
text's bytes, and prefix polynomials over the words' fingerprints those of all n-grams. A task adds up equal
fingerprints before the shuffle, which sums them with a pointer to a document that holds one (the least content
hash) and the range of a second hash modulo a prime. Only n-grams of the least count are written. A length is
counted once the shorter one is known: an n-gram can be frequent only if both of its (n-1)-grams are, which a
bitmap of fixed size tells (``filter_bits``; a fuller bitmap prunes less and loses nothing). The last pass reads
the text of each frequent fingerprint in the document it points to. Fingerprints whose second hashes differ stand
for several phrases: those are counted again by their texts.

Defined results: null texts are empty and null languages are ``und``; texts without words add nothing; rows that
repeat count each time; an empty table gives no rows; only the two named columns are read, so others may have any
name; texts are read whole at any length. Ties in rank go by count, then by the phrase's bytes.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, whole_text, written

# Bytes that end a piece (.,;:!? and \x0A-\x0D) and bytes between words (space, tab).
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
NO_LANG = "und"

#: 2**28 bits (32 MB) of a bitmap that prunes; a key sets two of them.
FILTER_BITS = 28
#: N-grams that a task holds before it adds up equal ones, and rows of a batch that it returns.
FLUSH, OUT_ROWS = 3_000_000, 100_000
#: Bytes of text that are hashed at a time (a longer text goes alone).
SLICE = 1 << 20

_BASE, _PRIME, _PRIME_BASE = np.uint64(0x9E3779B97F4A7C15), (1 << 31) - 1, 48_271
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(BLANKS)] = 1
_CLASS[list(PIECE_ENDS)] = 2
_CODE = np.arange(1, 257, dtype=np.int64)  # no byte counts as zero
_CODE[ord("A"):ord("Z") + 1] += 32


class _Powers:
    """Powers of a base and of its inverse, modulo 2**64 or a prime; grown by doubling."""

    def __init__(self, base, inverse, mod=None):
        self.mod, self.up, self.down = mod, self._start(base, mod), self._start(inverse, mod)

    @staticmethod
    def _start(x, mod):
        return np.array([1, x], np.int64 if mod else np.uint64)

    def _grow(self, a):
        top = a[-1:] * a[1:2]
        b = a * (top % self.mod if self.mod else top)
        return np.concatenate([a, b % self.mod if self.mod else b])

    def need(self, n):
        while len(self.up) < n:
            self.up, self.down = self._grow(self.up), self._grow(self.down)

    def ranges(self, codes, start, end):
        """The polynomials of codes[start:end], whatever their place."""
        n = len(codes)
        self.need(n + 1)
        terms = codes * self.up[:n]
        if self.mod:
            terms %= self.mod
        total = np.zeros(n + 1, terms.dtype)
        np.cumsum(terms, out=total[1:])
        out = total[end] - total[start]
        if self.mod:
            return out % self.mod * self.down[start] % self.mod
        return out * self.down[start]


def _hashers():
    return (_Powers(_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))),
            _Powers(_PRIME_BASE, pow(_PRIME_BASE, -1, _PRIME), _PRIME))


def _mix(x):
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batch: pa.RecordBatch):
    """(bytes, document offsets, both hashes of the languages, pointers, languages) of runs of whole documents."""
    texts = batch.column("t")
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    langs = batch.column("lang").to_pylist()
    seed_of = {x: struct.unpack("<QI", hashlib.blake2b(x.encode(), digest_size=12).digest()) for x in set(langs)}
    seeds = np.array([seed_of[x][0] for x in langs], np.uint64)
    marks = np.array([seed_of[x][1] % _PRIME for x in langs], np.int64)
    pointers = batch.column("p").to_numpy(zero_copy_only=False)
    first = 0
    while first < len(langs):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, "right")) - 1)
        yield (data[ends[first]:ends[last]], ends[first:last + 1] - ends[first], (seeds[first:last], marks[first:last]),
               pointers[first:last], langs[first:last])
        first = last


class _Words:
    """The words of a slice: byte ranges, pieces, documents and both hashes."""

    def __init__(self, data, offsets, hashers):
        kind = _CLASS[data]
        word = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        edge = edge[:-1]
        starts = word & (edge | ~np.concatenate([[False], word[:-1]])) if len(data) else word
        ends = word & np.concatenate([edge[1:] | ~word[1:], [True]]) if len(data) else word
        self.data, self.start, self.end = data, np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.piece = np.cumsum((kind == 2) | edge)[self.start] if len(data) else self.start
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        codes = _CODE[data]
        wrap, prime = hashers
        self.h = _mix(wrap.ranges(codes.astype(np.uint64), self.start, self.end))
        self.c = prime.ranges(codes, self.start, self.end)
        self.hashers = hashers

    def __len__(self):
        return len(self.start)

    def grams(self, n, seeds, bits):
        """First words of all n-grams, their fingerprints and second hashes."""
        m = len(self)
        at = np.arange(max(0, m - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        wrap, prime = self.hashers
        doc = self.doc[at]
        fp = _mix(wrap.ranges(self.h, at, at + n) ^ (seeds[0][doc] + np.uint64(n)))
        return at, fp >> np.uint64(64 - bits), (prime.ranges(self.c, at, at + n) + seeds[1][doc]) % _PRIME

    def text(self, i, n):
        return b" ".join(bytes(self.data[self.start[i]:self.end[i + n - 1]]).lower().split()).decode(errors="replace")


def _has(bitmap, keys):
    size = len(bitmap) * 8
    shift, mask = np.uint64(size.bit_length() - 1), np.uint64(size - 1)
    ok = np.ones(len(keys), bool)
    for at in (keys & mask, keys >> shift & mask):
        ok &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return ok


def _pair(fp, pointer):
    p = pointer.view(np.uint64)
    return fp ^ (p << np.uint64(21) | p >> np.uint64(43))


def _pair_column() -> Column:
    """``_pair`` of the columns fp and p."""
    return F.col("fp").bitwiseXOR(F.shiftleft("p", 21).bitwiseOR(F.shiftrightunsigned("p", 43)))


def _frequent_parts(words, at, n, seeds, bits, bitmap):
    """Which of the n-grams at ``at`` have two frequent (n-1)-grams, as far as the bitmap knows."""
    where, fp, _ = words.grams(n - 1, seeds, bits)
    ok = np.zeros(len(words) + 1, bool)
    ok[where] = _has(bitmap, fp)
    return ok[at] & ok[at + 1]


def _counts(docs: DataFrame, n: int, bits: int, filled, flush: int = FLUSH) -> DataFrame:
    """(fp, lo, hi, a, p) of the n-grams of each task; for n = 0 the empty phrase of each language,
    which occurs once a word."""
    def run(batches):
        hashers, held, size = _hashers(), [], 0

        def out():
            fp, c, a, p = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(fp)
            fp, c, a, p = fp[order], c[order], a[order], p[order]
            first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
            cols = [fp[first].view(np.int64), np.minimum.reduceat(c, first).astype(np.int32), np.maximum.reduceat(c, first).astype(np.int32),
                    np.add.reduceat(a, first), np.minimum.reduceat(p, first)]
            made = pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["fp", "lo", "hi", "a", "p"])
            for i in range(0, made.num_rows, OUT_ROWS):
                yield made.slice(i, OUT_ROWS)

        for batch in batches:
            for data, offsets, seeds, pointers, _ in _slices(batch):
                words = _Words(data, offsets, hashers)
                if n == 0:
                    a = np.bincount(words.doc, minlength=len(pointers))
                    fp, c, a, p = (x[a > 0] for x in (seeds[0] >> np.uint64(64 - bits), seeds[1], a, pointers))
                else:
                    at, fp, c = words.grams(n, seeds, bits)
                    if filled is not None:
                        keep = _frequent_parts(words, at, n, seeds, bits, filled.value)
                        at, fp, c = at[keep], fp[keep], c[keep]
                    a, p = np.ones(len(at), np.int64), pointers[words.doc[at]]
                held.append((fp, c, a, p))
                size += len(fp)
                if size >= flush:
                    yield from out()
                    held, size = [], 0
        if size:
            yield from out()

    return docs.mapInArrow(run, "fp long, lo int, hi int, a long, p long")


def _texts(docs: DataFrame, lengths: list[int], bits: int, filled, pointed: bool) -> DataFrame:
    """(n, fp, p, lang, phrase, a) of the n-grams that the bitmap names: by fingerprint and pointer, or by
    fingerprint alone; a task returns a phrase once for each batch."""
    def run(batches):
        hashers, bitmap = _hashers(), filled.value
        types = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            found = {}
            for data, offsets, seeds, pointers, langs in _slices(batch):
                words = _Words(data, offsets, hashers)
                for n in filter(None, lengths):
                    at, fp, _ = words.grams(n, seeds, bits)
                    doc = words.doc[at]
                    hit = _has(bitmap, _pair(fp, pointers[doc]) if pointed else fp)
                    for i, f, d in zip(at[hit].tolist(), fp[hit].view(np.int64).tolist(), doc[hit].tolist()):
                        key = (n, f, int(pointers[d]) if pointed else None, langs[d], words.text(i, n))
                        found[key] = found.get(key, 0) + 1
                if 0 in lengths:
                    fp, a = seeds[0] >> np.uint64(64 - bits), np.bincount(words.doc, minlength=len(pointers))
                    for d in np.flatnonzero((a > 0) & _has(bitmap, _pair(fp, pointers) if pointed else fp)).tolist():
                        key = (0, int(fp[d].view(np.int64)), int(pointers[d]) if pointed else None, langs[d], "")
                        found[key] = found.get(key, 0) + int(a[d])
            columns = list(zip(*((*k, v) for k, v in found.items()))) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["n", "fp", "p", "lang", "phrase", "a"])

    return docs.mapInArrow(run, "n int, fp long, p long, lang string, phrase string, a long")


def _bitmap(keys: DataFrame, key: Column, size: int):
    """A broadcast bitmap of ``size`` bits: what is collected has that size, however many keys there are."""
    part = min(19, size)

    def run(table):
        at = table.column("at").to_numpy()
        filled = np.zeros(1 << part, np.uint8)
        filled[at & ((1 << part) - 1)] = 1
        return pa.table({"chunk": pa.array([int(at[0]) >> part], pa.int64()), "bits": pa.array([np.packbits(filled, bitorder="little").tobytes()], pa.binary())})

    mask = (1 << size) - 1
    at = keys.select(F.explode(F.array(key.bitwiseAND(mask), F.shiftrightunsigned(key, size).bitwiseAND(mask))).alias("at"))
    whole = np.zeros((1 << size) // 8 or 1, np.uint8)
    step = (1 << part) // 8
    for r in at.groupBy(F.shiftright("at", part)).applyInArrow(run, "chunk long, bits binary").collect():
        whole[r["chunk"] * step:(r["chunk"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10,
                     bits: int = 64, filter_bits: int = FILTER_BITS, flush: int = FLUSH) -> DataFrame:
    """(lang, n, phrase, a) of every phrase of at most ``longest`` words that occurs ``least`` times or more,
    and the empty phrase (n = 0) of each language with the number of its words. ``bits`` of the fingerprints
    are used; fewer than 64 only make more collisions to resolve."""
    spark = docs.sparkSession
    src = in_batches(docs.select(whole_text(text).alias("t"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
                     .withColumn("p", F.xxhash64("lang", "t")))
    levels, filled, open_ = [], None, []
    for n in range(longest + 1):
        sums = _counts(src, n, bits, filled, flush).repartition("fp").groupBy("fp").agg(
            F.sum("a").alias("a"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("p").alias("p"))
        level = written(sums.where(F.lit(n == 0) | (F.col("a") >= least)), f"phrases-{n}")
        levels.append(level.select(F.lit(n).alias("n"), "*"))
        if n:
            filled = _bitmap(level, F.col("fp"), filter_bits)
            open_.append(filled)
    found = reduce(DataFrame.unionAll, levels)
    sure, unsure = found.where("lo = hi"), found.where("lo <> hi")
    pointed = _bitmap(sure, _pair_column(), filter_bits)
    texts = _texts(src, list(range(longest + 1)), bits, pointed, True).drop("a")
    known = texts.join(sure.select("n", "fp", "p", "a"), ["n", "fp", "p"]).groupBy("lang", "n", "phrase").agg(F.max("a").alias("a"))
    again = [r["n"] for r in unsure.select("n").distinct().collect()]
    if again:
        named = _bitmap(unsure, F.col("fp"), filter_bits)
        open_.append(named)
        counted = _texts(src, again, bits, named, False).join(unsure.select("n", "fp"), ["n", "fp"], "left_semi")
        known = known.unionAll(counted.groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a")).where((F.col("n") == 0) | (F.col("a") >= least)))
    out = written(known, "phrases")
    for x in [*open_, pointed]:
        x.unpersist()
    return out


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10,
                 share: int = 50, top: int = 2000, **how) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, length, a, l, r, n, score.

    ``score`` is floor(10**6 * a * a / (l * r)) of the weakest cut, in exact decimals. A phrase goes if a longer
    one that holds it has at least ``share`` per cent of its occurrences."""
    found = frequent_phrases(docs, text, lang, longest, least, **how)
    phrases = found.where("n >= 2")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - n)")})
    parts = found.where("n >= 1")
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn(
        "score", F.expr("(cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div "
                        "(cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"))
    weakest = scored.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    inner = phrases.where("n >= 3").withColumn("w", F.split("phrase", " ")).select("lang", "a", F.explode(F.expr(
        "flatten(transform(sequence(2, n - 1), m -> transform(sequence(1, n - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "n", "a", "w.l", "w.r", "w.score").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= top)
    words = found.where("n = 0").select("lang", F.col("a").alias("words"))
    return ranked.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("length"), "a", "l", "r", F.col("words").alias("n"), "score")
