"""Phrase dictionaries of any size: a compiled automaton over words instead of literals in the plan.

The phrases' words become a trie whose edges, failure links and outputs are arrays: ``goto`` as sorted
(state, word) keys, ``fail`` the state of the longest proper suffix, ``end`` the phrase that ends in a state and
``next_end`` the next shorter phrase that ends there too. One pass over a text finds every occurrence of every
phrase, overlaps included. Texts are cut at words that no phrase has (they lead back to the start), and all cuts
of a batch advance side by side.

An automaton of at most ``MAX_WORDS`` phrase words (some 70 MB) is broadcast; a larger dictionary is dealt by
hash to several, each with a pass of its own, and their hits are added. Words and phrases are known by 64-bit
hashes. A phrase is its lower-cased words (``functions.text.tokens``); one without words matches nothing.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.session import bounded_batches, stored

#: Words of all phrases of one automaton.
MAX_WORDS = 3_000_000
#: Words that a worker remembers, and texts whose words it holds as Python strings at once.
MEMO, ROWS = 50_000, 256


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class Automaton:
    def __init__(self, phrases: list[list[str]], ids: np.ndarray):
        """``phrases``: words of distinct phrases; ``ids``: what each is called (64-bit)."""
        names: dict[str, int] = {}
        sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
        flat = np.fromiter((names.setdefault(w, len(names)) for p in phrases for w in p), np.int64, int(sizes.sum()))
        hashes = np.fromiter(map(word_hash, names), np.uint64, len(names))
        order = np.argsort(hashes)
        self.words = hashes[order]  # a word's number is its place here
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        flat = number[flat] if len(flat) else flat
        starts = np.cumsum(sizes) - sizes
        state, live = np.zeros(len(phrases), np.int64), np.flatnonzero(sizes > 0)
        keys, targets, levels, n = [], [], [], 1
        end = [np.full(1, -1, np.int64)]
        for depth in range(int(sizes.max(initial=0))):
            live = live[sizes[live] > depth]
            key = state[live] << 32 | flat[starts[live] + depth]
            level, of = np.unique(key, return_inverse=True)
            made = n + np.arange(len(level))
            state[live] = made[of]
            ends = np.full(len(level), -1, np.int64)
            last = sizes[live] == depth + 1
            ends[of[last]] = live[last]
            keys.append(level)
            targets.append(made)
            levels.append((level >> 32, level & 0xFFFFFFFF, made))
            end.append(ends)
            n += len(level)
        key, target = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, targets))
        order = np.argsort(key)
        self.keys, self.targets = key[order], target[order].astype(np.int32)
        self.end, self.ids = np.concatenate(end), ids
        self.fail, self.next_end = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for depth, (parent, word, made) in enumerate(levels):
            if depth:
                self.fail[made] = self.step(self.fail[parent].astype(np.int64), word)
            f = self.fail[made]
            self.next_end[made] = np.where(self.end[f] >= 0, f, self.next_end[f])
        self.loud = (self.end >= 0) | (self.next_end >= 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after a word each: along edges, and where there is none along failure links."""
        out = np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        state = state.copy()
        while len(todo):
            key = state[todo] << 32 | word[todo]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = self.keys[at] == key if len(self.keys) else np.zeros(len(todo), bool)
            out[todo[hit]] = self.targets[at[hit]]
            todo = todo[~hit]
            todo = todo[state[todo] > 0]  # the start has no shorter suffix
            state[todo] = self.fail[state[todo]]
        return out

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words that no phrase has."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def occurrences(self, words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last word, phrase) of every occurrence; ``words``: numbers of all texts' words one after
        the other, ``edges``: where texts start."""
        known = words >= 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        begins[edges[edges < len(words)]] = known[edges[edges < len(words)]]
        first = np.flatnonzero(begins)
        breaks = np.union1d(np.flatnonzero(~known), first)
        after = np.append(breaks, len(words))
        size = after[np.searchsorted(breaks, first, "right")] - first
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        state, places, phrases = np.zeros(len(first), np.int64), [], []
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))
            at = first[:live] + t
            state[:live] = self.step(state[:live], words[at])
            here = np.flatnonzero(self.loud[state[:live]])
            s, at = state[here], at[here]
            while len(s):
                hit = self.end[s] >= 0
                places.append(at[hit])
                phrases.append(self.end[s[hit]])
                s, at = self.next_end[s], at
                at, s = at[s >= 0], s[s >= 0].astype(np.int64)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(phrases)


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = word_hash(word)
        return got


def _hits(texts: DataFrame, keys: list[str], automaton: Automaton) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(automaton)

    def run(batches):
        a, memo = shared.value, _Hashes()
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            tokens = b.column("_toks").to_pylist()
            sizes = np.fromiter((len(x or ()) for x in tokens), np.int64, len(tokens))
            flat = np.fromiter((memo[w] for x in tokens for w in x or ()), np.uint64, int(sizes.sum()))
            edges = np.cumsum(sizes) - sizes
            place, phrase = a.occurrences(a.numbers(flat), edges[sizes > 0])
            row = np.searchsorted(np.cumsum(sizes), place, "right")
            pair, n = np.unique(np.stack([row, phrase]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            cols = [b.column(k).take(pa.array(pair[0])) for k in keys]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(a.ids[pair[1]]), pa.array(n)], [*keys, "phrase_id", "n"])

    schema = texts.select(*keys).schema.add("phrase_id", "long").add("n", "long")
    return bounded_batches(texts).mapInArrow(run, schema)


def phrase_hits(docs: DataFrame, keys: list[str], text_col: str, phrases: DataFrame, phrase_col: str = "phrase",
                max_words: int = MAX_WORDS) -> DataFrame:
    """(keys..., phrase, n): how often each phrase of the table occurs in each text that has it (one row a row of
    ``docs``). ``phrase`` is the phrase's words with a space between."""
    spark = docs.sparkSession
    known = phrases.select(T.tokens(phrase_col).alias("w")).where(F.size("w") > 0).select(F.array_join("w", " ").alias("phrase"), F.size("w").alias("size"))
    known = stored(known.distinct().withColumn("phrase_id", F.xxhash64("phrase")), "phrases")
    total = known.agg(F.sum("size")).first()[0] or 0
    texts = docs.select(*keys, T.tokens(text_col).alias("_toks"))
    found = []
    parts = max(1, -(-total // max_words))
    for i in range(parts):
        part = known.where(F.pmod(F.xxhash64(F.lit("part"), "phrase"), F.lit(parts)) == i).select("phrase", "phrase_id").toArrow()
        automaton = Automaton([p.split(" ") for p in part.column("phrase").to_pylist()], part.column("phrase_id").to_numpy())
        got = _hits(texts, keys, automaton)
        found.append(got if parts == 1 else stored(got, "phrase-hits"))
    hits = reduce(DataFrame.unionAll, found)
    return hits.join(known.select("phrase_id", "phrase"), "phrase_id").select(*keys, "phrase", "n")


def phrase_counts(docs: DataFrame, text_col: str, phrases: DataFrame, phrase_col: str = "phrase", max_words: int = MAX_WORDS) -> DataFrame:
    """(phrase, n_docs, n_mentions) of the phrases that occur."""
    hits = phrase_hits(docs.select(text_col), [], text_col, phrases, phrase_col, max_words)
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_mentions"))
