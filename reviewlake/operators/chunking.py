"""Text chunking.

``chunk_fixed``: windows of ``size`` characters every ``size - overlap``
characters over the whole text, built with ``sequence`` + ``transform`` and
``posexplode``: a per-row, shuffle-free projection.

``chunk_recursive``: a recursive character splitter (blank line, newline,
space, then single characters; pieces merged greedily up to ``size`` with up to
``overlap`` characters carried into the next chunk; edges stripped), run per review through
``mapInPandas`` on Arrow batches.  Chunks never span two reviews, so each chunk
keeps its review id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.session import bounded_batches

# Splitter settings.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ["\n\n", "\n", " ", ""]


def n_fixed_chunks(length, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    step = size - overlap
    return F.greatest(F.lit(1), F.ceil((length - F.lit(overlap)) / F.lit(step))).cast("int")


def chunk_fixed(docs: DataFrame, keys: list[str], text_col: str,
                size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(keys..., chunk_pos, text): every character of the text is in some chunk."""
    step = size - overlap
    t = F.col(text_col)
    n = n_fixed_chunks(F.length(t), size, overlap)
    # the text is cut once, and a chunk joins a cut and what it needs of the next ones
    cuts = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), 0)
    staged = docs.select(*keys, n.alias("_n"), cuts.alias("_cuts"))
    several = -(-size // step)
    pieces = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring(F.array_join(F.slice("_cuts", i + 1, several), ""), 1, size))
    return staged.select(*keys, F.posexplode(pieces).alias("chunk_pos", "text"))


# --- recursive splitter (runs inside tasks) ----------------------------------------------
def _pieces(text: str, sep: str) -> list[str]:
    """Cut before every separator, so that it leads the piece after it; no empty pieces."""
    if not sep:
        return list(text)
    first, *rest = text.split(sep)
    return [p for p in [first, *(sep + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Greedy chunks of whole pieces up to ``size``; the last pieces, up to ``overlap``, open the next one.
    White space at a chunk's edges goes; blank chunks go."""
    chunks, window, total = [], deque(), 0
    for p in pieces:
        if window and total + len(p) > size:
            chunks.append("".join(window).strip())
            while total > overlap or (total and total + len(p) > size):
                total -= len(window.popleft())
        window.append(p)
        total += len(p)
    chunks.append("".join(window).strip())
    return [c for c in chunks if c]


def split_recursive(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
                    separators: list[str] | None = None) -> list[str]:
    """Chunks of a text by the first separator that occurs in it; a piece of ``size`` or more is split
    by the separators after it, and its chunks stand on their own: they are not
    merged with what comes before or after."""
    seps = SEPARATORS if separators is None else separators
    at = next((k for k, s in enumerate(seps) if not s or s in text), len(seps) - 1)
    finer = seps[at + 1:] if seps[at] else []
    chunks: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, seps[at]):
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += _pack(short, size, overlap) if short else []
        short = []
        chunks += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return chunks + (_pack(short, size, overlap) if short else [])


def chunk_recursive(docs: DataFrame, key: str, text_col: str,
                    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(key, chunk_pos, text) per review; key must be a string or integer column."""
    key_type = dict(docs.dtypes)[key]
    src = bounded_batches(docs.select(key, text_col))  # ten thousand long reviews and their chunks do not fit a worker

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, pos, texts = [], [], []
            for k, t in zip(pdf[key], pdf[text_col]):
                for i, c in enumerate(split_recursive(t or "", size, overlap)):
                    keys.append(k)
                    pos.append(i)
                    texts.append(c)
            if keys:  # an all-empty batch has nothing to emit
                yield pd.DataFrame({key: keys, "chunk_pos": pd.Series(pos, dtype="int32"), "text": texts})

    return src.mapInPandas(run, f"{key} {key_type}, chunk_pos int, text string")
