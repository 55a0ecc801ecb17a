"""Line dedup: hash every normalised line, count documents per hash, drop, reassemble.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Keys of ``min_chars`` code points or more that occur in ``min_docs`` documents
or more lose all their lines except in the smallest doc_id that holds them.

Only fixed-width rows (two 64-bit hashes of the key, the document) are shuffled
by key, after partial aggregation: a line that a third of all documents
share arrives as one row per map task. Positions to drop travel back to
the text once, grouped by document.

Defined results: a null or empty text is one empty line; a null doc_id counts as
the smallest id; rows that repeat (doc_id, text) get the same result each; rows
with one doc_id are one document as far as counting goes; extra columns stay
out of the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, hash128, id_key, whole_text, written

MIN_CHARS, MIN_DOCS = 10, 2


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(_d, _r, _pos, _h1, _h2): document key, hash of the row's text, position and key hashes of long lines."""
    bare = F.btrim(F.col("_line"), F.lit(SPACE_CHARS))
    exploded = docs.select("_d", "_r", F.posexplode(F.split("_t", "\n", -1)).alias("_pos", "_line"))
    keyed = exploded.select("_d", "_r", "_pos", bare.alias("_key")).where(F.length("_key") >= min_chars)
    h1, h2 = hash128(ascii_lower(F.col("_key")))
    return keyed.select("_d", "_r", "_pos", h1.alias("_h1"), h2.alias("_h2"))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys in at least ``min_docs`` documents with the smallest document that holds them."""
    if min_docs == 2:  # two documents differ when the smallest is not the largest
        g = lines.groupBy("_h1", "_h2").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
        return g.where("_first < _last").drop("_last")
    g = lines.select("_h1", "_h2", "_d").distinct().groupBy("_h1", "_h2")
    return g.agg(F.min("_d").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") >= min_docs).drop("_n")


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, carry: bool = False) -> DataFrame:
    """Per input row: doc_id, text (the kept lines), n_lines, n_dropped; with ``carry`` every column of
    ``docs`` instead, the text replaced."""
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_rest")] if carry else []
    d = docs.select(F.col(doc_id).alias("doc_id"), id_key(doc_id).alias("_d"), whole_text(text).alias("_t"), *rest)
    d = d.withColumn("_r", F.xxhash64("_t"))
    lines = _lines(d, min_chars)
    # As a table of its own, the shared keys leave Spark free to split a hot key's lines over tasks.
    shared = written(shared_keys(lines, min_docs), "shared-lines")
    gone = lines.join(shared, ["_h1", "_h2"]).where("_d > _first")
    gone = gone.groupBy("_d", "_r").agg(F.collect_set("_pos").alias("_gone"))
    # The lists are a small share of the text: they are built into hash tables, the texts stream past.
    j = d.join(gone.hint("shuffle_hash"), ["_d", "_r"], "left")
    j = j.withColumn("_ls", F.split("_t", "\n", -1))
    ls = F.col("_ls")
    kept = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone"))
    out = F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))
    if carry:
        return j.select(*[out.alias(text) if c == text else F.col("_rest").getField(c).alias(c) for c in docs.columns])
    return j.select("doc_id", out.alias("text"), F.size(ls).cast("long").alias("n_lines"),
                    F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
