"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

A document is contaminated by an item when some window of as many words as the item (cut where
the text ends) has a weighted similarity of ``min_similarity`` or more to it: the multiset Jaccard
similarity of their five-word shingles, each weighing as often as it occurs (words
``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased).

1. Windows. A window that similar holds at least ``need`` shingles of the item (see
   ``_need``), so only runs of positions with that many shingles of items of one size give windows
   of that size; all of their starts are taken. Nothing that could pass is left out, and no item is named.
2. Fingerprints. Each window's 64-bit SimHash, weighted by shingle counts.
3. Multi-index. Fingerprints are cut into ``radius + 1`` blocks; two that differ in at most
   ``radius`` bits agree in a block, so an equi-join on (size, block, value) finds every item that
   a window may be; the rest is filtered by its Hamming distance. At a similarity of 0.8 the share of
   common shingles is 0.89, which flips 9.7 of 64 bits on average (deviation 2.9): the
   radius of 26 is more than five deviations away.
4. Check. The exact similarity of the pairs that the index found decides.

Built-in functions only. The benchmark's shingles are broadcast after counting them; beyond
``MAX_BROADCAST_ROWS`` the same joins shuffle. Only positions that hold an item's
shingle leave the scan.

Defined results: null or empty texts and items have no words and match nothing; an item
of fewer than five words is one shingle of all its words; a null doc_id is passed on; rows
that repeat (doc_id, text) give one result; items with equal words match alike; empty
tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, id_key, whole_text, words_of, written

SHINGLE, MIN_SIMILARITY, RADIUS = 5, 0.8, 26
#: Rows of benchmark shingles (24 bytes each) that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def _need(n: Column, min_similarity: float) -> Column:
    """Shingles of an item of ``n`` that a window of m <= n must hold: o / (n + m - o) >= s with o <= m means o >= ns."""
    return F.greatest(F.lit(1), F.ceil(F.round(n * min_similarity, 9))).cast("int")


def _grams(words: Column, width: int) -> Column:
    """Hash of the shingle at every position of an array of words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(h: Column, weight: Column) -> Column:
    """Aggregate: the SimHash of hashes by weighted votes."""
    bits = [F.when(F.sum(F.when(F.shiftright(h, b).bitwiseAND(F.lit(1)) == 1, weight).otherwise(-weight)) > 0,
                   F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def _blocks(fp: Column, radius: int) -> Column:
    n = radius + 1
    cut = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("block"),
                              F.shiftrightunsigned(fp, cut[k]).bitwiseAND(F.lit((1 << (cut[k + 1] - cut[k])) - 1)).alias("value"))
                     for k in range(n)])


def decontamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
                    item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE,
                    min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, _d, _r): the best window of every contaminated pair."""
    # Benchmark: items with equal words are one item until the end.
    named = benchmark.select(F.col(item_id).alias("item_id"), words_of(ascii_lower(whole_text(item_text))).alias("w"))
    named = named.where(F.size("w") > 0).withColumn("item", F.xxhash64(F.array_join("w", " ")))
    items = named.groupBy("item").agg(F.any_value("w").alias("w")).withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``shingle`` values
    gram = F.array().cast("array<bigint>")
    for k in widths:
        gram = F.when(F.col("width") == k, _grams(F.col("w"), k)).otherwise(gram)
    items = written(items.select("item", "width", F.size("w").alias("n_words"), gram.alias("g")), "benchmark")
    grams = written(items.select("item", "width", F.explode("g").alias("h")).groupBy("item", "width", "h")
                    .agg(F.count("*").alias("n_item")), "benchmark-shingles")
    small = F.broadcast if grams.count() <= MAX_BROADCAST_ROWS else (lambda d: d)
    # Items of as many shingles are one size; the text is looked at by sizes, which item it is the index tells.
    sized = grams.join(small(items.select("item", F.size("g").alias("n_sh"))), "item").select("width", "n_sh", "h").distinct()

    # 1. Positions that hold a shingle of an item of a size, and the windows they allow.
    t = docs.select(F.col(doc_id).alias("doc_id"), id_key(doc_id).alias("_d"), whole_text(text).alias("_t"))
    t = t.withColumn("_r", F.xxhash64("_t"))
    worded = t.select("_d", "_r", words_of(ascii_lower(F.col("_t"))).alias("w"))
    hits = None
    for k in widths:
        at = worded.select("_d", "_r", F.posexplode(_grams(F.col("w"), k)).alias("pos", "h"))
        found = at.join(small(sized.where(F.col("width") == k)), "h").select("_d", "_r", "width", "n_sh", "pos")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:  # no item has a word
        hits = worded.where(F.lit(False)).select("_d", "_r", F.lit(0).alias("width"), F.lit(0).alias("n_sh"), F.lit(0).alias("pos"))
    runs = hits.groupBy("_d", "_r", "width", "n_sh").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    runs = runs.withColumn("need", _need(F.col("n_sh"), min_similarity)).where(F.size("p") >= F.col("need"))
    p, need, n_sh = F.col("p"), F.col("need"), F.col("n_sh")
    spans = F.transform(F.sequence(F.lit(0), F.size(p) - need), lambda i: F.struct(
        F.greatest(F.lit(0), F.get(p, i + need - 1) - n_sh + 1).alias("lo"), F.get(p, i).alias("hi")))
    runs = runs.select("_d", "_r", "width", "n_sh", F.explode(spans).alias("s")).where("s.lo <= s.hi")
    starts = runs.select("_d", "_r", "width", "n_sh", F.explode(F.sequence("s.lo", "s.hi")).alias("start")).distinct()
    # One row per document with its starts meets the text; the lists are small, the texts stream past.
    wanted = starts.groupBy("_d", "_r").agg(F.collect_list(F.struct("width", "n_sh", "start")).alias("todo"))
    texts = t.select("_d", "_r", "_t").join(written(wanted, "windows").hint("shuffle_hash"), ["_d", "_r"])
    texts = texts.dropDuplicates(["_d", "_r"]).withColumn("w", words_of(ascii_lower(F.col("_t"))))
    for k in widths:
        texts = texts.withColumn(f"g{k}", _grams(F.col("w"), k))
    texts = texts.select("_d", "_r", F.explode("todo").alias("x"), *[f"g{k}" for k in widths])
    shingles = F.array().cast("array<bigint>")
    for k in widths:
        shingles = F.when(F.col("x.width") == k, F.slice(f"g{k}", F.col("x.start") + 1, F.col("x.n_sh"))).otherwise(shingles)
    windows = texts.select("_d", "_r", "x.width", "x.start", "x.n_sh", F.explode(shingles).alias("h"))

    # 2. Fingerprints: a shingle votes as often as it occurs. The window's shingles go with it to the check.
    key = ["_d", "_r", "width", "n_sh", "start"]
    prints = windows.groupBy(*key).agg(_fingerprint(F.col("h"), F.lit(1)).alias("fp"), F.collect_list("h").alias("hs"))
    item_prints = grams.join(small(items.select("item", F.size("g").alias("n_sh"))), "item").groupBy("item", "width", "n_sh").agg(
        _fingerprint(F.col("h"), F.col("n_item")).alias("item_fp"))

    # 3. Multi-index on Hamming blocks: it finds the items that a window may be.
    left = prints.withColumn("b", F.explode(_blocks(F.col("fp"), radius))).select("*", "b.block", "b.value").drop("b")
    right = item_prints.withColumn("b", F.explode(_blocks(F.col("item_fp"), radius))).select("*", "b.block", "b.value").drop("b")
    near = left.join(small(right), ["width", "n_sh", "block", "value"])
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = near.where(F.bit_count(differ) <= radius)
    # a pair that agrees in several blocks counts in the first of them
    agree = F.array_min(F.transform(F.filter(_blocks(differ, radius), lambda x: x["value"] == 0), lambda x: x["block"]))
    near = near.where(F.col("block") == agree).select(*key, "item", "hs")

    # 4. The exact similarity; the best window of each pair stays.
    counted = near.select(*key, "item", F.size("hs").alias("n_window"), F.explode("hs").alias("h")).groupBy(*key, "item", "n_window", "h").agg(
        F.count("*").alias("n"))
    common = F.sum(F.least("n", "n_item"))
    near = counted.join(small(grams.select("item", "h", "n_item")), ["item", "h"]).groupBy(*key, "item", "n_window").agg(common.alias("common"))
    near = near.withColumn("similarity", F.col("common") / (F.col("n_window") + F.col("n_sh") - F.col("common")))
    near = near.where(F.col("similarity") >= min_similarity).withColumn("n_words", F.col("n_sh") + F.col("width") - 1)
    best = near.groupBy("_d", "_r", "item", "n_words").agg(
        F.min(F.struct(-F.col("similarity"), F.col("start"))).alias("top"))
    ids = small(named.select("item", "item_id").distinct())
    # Rows that differ only in what is not compared have one doc_id key; null comes back as null.
    doc = F.when(F.col("_d") != F.lit(-(1 << 63)), F.col("_d"))
    return best.join(ids, "item").select(doc.alias("doc_id"), "item_id", F.col("top.start").alias("start_word"), "n_words",
                                         (-F.col("top.col1")).alias("similarity"), "_d", "_r")
