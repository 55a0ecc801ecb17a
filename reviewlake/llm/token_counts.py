"""Token counts by a finite-state transducer over characters.

The words of a byte-level BPE (letters, digits, other marks, white space, English
contractions, each with the space that leads it) are a regular language with bounded lookahead. It is
compiled into a deterministic transducer: a symbol per character (its class and what
follows it), eight states, and one output per transition: whether a word ends before this
character. A text is cut into chunks; each chunk's table of (start state -> end state)
is built for all chunks at once, the tables are composed by a parallel prefix scan,
and with every chunk's true start state known the second pass reads the outputs off.

A word's tokens are counted by the vocabulary's merges on the transition that ends it: the
count of each distinct word is compiled once (by the library itself, so that it is the
library's by construction) and remembered per Python worker, up to ``MEMO`` words.

Added special strings inside a text are cut out first, one token each, as the library does
by default.

Defined results: a null or empty text has 0 tokens; a null doc_id is passed on; repeated
rows are counted each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_batches, whole_text

LIMIT = 1024
CHUNK = 256
MEMO = 800_000
_LONGEST = 64
_BATCH = 1 << 20  # characters of texts put through the transducer together

# States: a word is open with letters, digits, marks, a lone leading space or white space; a
# contraction has 1 or 2 letters to go; nothing is open.
LETTERS, DIGITS, MARKS, LED, BLANK, ONE_LEFT, TWO_LEFT, CLOSED = range(8)
# Symbols: letter, digit, mark, apostrophe of a contraction with 1 or 2 letters, space before a
# character, other white space before a character, white space before white space or the end, and
# the border between texts.
L, N, O, C1, C2, SPACE, LONE, RUN, BORDER = range(9)


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """(next state, word ends before this character) by symbol and state."""
    step, ends = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for sym, state in ((L, LETTERS), (N, DIGITS), (O, MARKS)):
        step[sym] = state
        ends[sym, [state, LED]] = False
    step[L, ONE_LEFT], step[L, TWO_LEFT] = CLOSED, ONE_LEFT
    ends[L, [ONE_LEFT, TWO_LEFT]] = False
    for sym, state in ((C1, ONE_LEFT), (C2, TWO_LEFT)):
        step[sym] = state  # opens a contraction, but continues open marks as a mark
        step[sym, [MARKS, LED]] = MARKS
        ends[sym, [MARKS, LED]] = False
    step[SPACE], step[LONE], step[RUN], step[BORDER] = LED, CLOSED, BLANK, CLOSED
    ends[RUN, BLANK] = False
    return step, ends


STEP, ENDS = _compile()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: L, N, O, or RUN for white space."""
    out = np.full(0x110000, O, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c in "LN":
            out[cp] = L if c == "L" else N
    # The characters with the Unicode property White_Space.
    space = [0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x09, 0x0E), *range(0x2000, 0x200B)]
    out[space] = RUN
    return out


def _symbols(cp: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``border`` marks the places between texts."""
    kind = _classes()[cp]
    kind[border] = BORDER
    after = np.r_[kind[1:], BORDER]
    before_char = (kind == RUN) & (after != RUN) & (after != BORDER)
    space = cp == 0x20
    sym = kind.copy()
    sym[before_char & space] = SPACE
    sym[before_char & ~space] = LONE
    tick = np.flatnonzero(cp == 0x27)
    if len(tick):
        tick = tick[kind[tick] == O]
        two = np.r_[cp, 0, 0]
        c, d = two[tick + 1], two[tick + 2]
        one = np.isin(c, [ord(x) for x in "stmd"])
        pair = c.astype(np.int64) << 32 | d
        both = np.isin(pair, [ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")])
        sym[tick[one]] = C1
        sym[tick[both]] = C2
    return sym


def word_ends(sym: np.ndarray) -> np.ndarray:
    """Places where a word ends before the character: two passes around a prefix scan of state maps."""
    n = len(sym)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, BORDER, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    flat = STEP.reshape(-1)
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in grid:  # all chunks advance one character together, from every state
        maps = flat[(row.astype(np.uint16) << 3)[:, None] + maps]
    gap = 1
    while gap < chunks:  # Hillis-Steele: maps[c] becomes the map of chunks 0..c
        maps = np.concatenate([maps[:gap], np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), axis=1)])
        gap *= 2
    state = np.r_[np.uint8(CLOSED), maps[:-1, CLOSED]]
    out = np.empty((CHUNK, chunks), bool)
    cut = ENDS.reshape(-1)
    for k, row in enumerate(grid):
        at = (row.astype(np.uint16) << 3) + state
        out[k] = cut[at]
        state = flat[at]
    return np.flatnonzero(np.ascontiguousarray(out.T).reshape(-1)[:n])


class Counter:
    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if (pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space")
                or spec.get("normalizer") or spec.get("post_processor") or spec.get("truncation")):
            raise ValueError("only byte-level vocabularies that cut words by their own pattern are compiled")
        added = spec.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take white space are not compiled")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.memo_size, self.memo = memo, {}

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > self.memo_size:
            self.memo.clear()
        todo = list(words)
        for at in range(0, len(todo), 10_000):
            part = todo[at:at + 10_000]
            self.memo.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        out = [0] * len(texts)
        owners, parts = [], []
        for k, t in enumerate(texts):
            if self.added is not None and (found := self.added.findall(t)):
                out[k] += len(found)
                plain = self.added.split(t)
            else:
                plain = [t]
            for p in plain:
                if p:
                    owners.append(k)
                    parts.append(p)
        if not parts:
            return out
        joined = "\n".join(parts)  # the joints are borders, not text
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        joints = np.cumsum(lengths + 1)[:-1] - 1
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        border = np.zeros(len(cp), bool)
        border[joints] = True
        cuts = word_ends(_symbols(cp, border))
        edges = np.r_[cuts, len(cp)]
        # joints stand between words: words run from a cut that is no joint to the next cut
        firsts = edges[:-1]
        word = ~border[firsts]
        a, b = firsts[word], edges[1:][word]
        words = [joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        got = list(map(self.memo.get, words))
        if None in got:
            new = {w for w, g in zip(words, got, strict=True) if g is None}
            long = {w for w in new if len(w) > _LONGEST}
            self._learn(new - long)
            rare = {w: len(self.library.encode_batch_fast([w], add_special_tokens=False)[0]) for w in long}
            got = [g if g is not None else rare[w] if w in rare else self.memo[w] for w, g in zip(words, got, strict=True)]
        begin = np.r_[0, joints + 1]
        sums = np.r_[0, np.cumsum(np.array(got, np.int64))]
        at = np.searchsorted(a, np.r_[begin, len(cp) + 1])
        for k, n in zip(owners, (sums[at[1:]] - sums[at[:-1]]).tolist(), strict=True):
            out[k] += n
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
                 limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (more tokens than ``limit``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).counts
        for b in batches:
            got: list[int] = []
            held, size = [], 0
            for t in b.column(1):
                held.append(t.as_py())
                size += len(held[-1])
                if size >= _BATCH:
                    got += count(held)
                    held, size = [], 0
            got += count(held)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.int64()), b.column(2)], ["doc_id", "n_tokens", "n_bytes"])

    t = whole_text(text)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("t"), F.octet_length(t).cast("long").alias("n_bytes"))
    out = in_batches(src).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
