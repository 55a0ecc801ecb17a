"""Names that no list holds: a linear-chain tagger for persons, places and the like.

An averaged perceptron scores tag sequences: hashed features of a word and its neighbours, and which tag follows
which; Viterbi finds the best sequence of a sentence. It learns from texts that detectors and a gazetteer label
(``find_spans``). In every other pass the words of names are hidden, so that it learns what stands around a name
and how names are written, not the list. The training set is at most ``MAX_SENTENCES`` sentences with names, and
as many without, of ``max_train`` texts chosen by hash; tagging reads every text. Weights are a few megabytes and are broadcast.
"""

from __future__ import annotations

import io
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions import masking as M
from reviewlake.operators import entities as EN
from reviewlake.session import bound_batches, stored

#: Texts that the training set is taken from, sentences with names in it (and as many without), passes, rows of the weight table.
MAX_TRAIN, MAX_SENTENCES, PASSES, ROWS = 4_000, 2_000, 6, 1 << 16
#: Words that are tagged at once (some 50 MB of scores, tokens and features).
BLOCK_WORDS = 20_000
#: Words whose scores a worker remembers (some 400 bytes each).
MEMO = 60_000
#: Labels that are learnt; numbers, mails and dates stay with the detectors.
NAMES = ("PERSON", "GPE", "LOC", "ORG")
SEED = 5

_TOKEN = re.compile(r"\w+|[^\w\s]")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
_RUNS = re.compile(r"(.)\1+")


def sentence_tokens(text: str):
    """Lists of (start, end, word), one a sentence."""
    at = 0
    for m in [*_SENTENCE_END.finditer(text), None]:
        end = m.start() if m else len(text)
        tokens = [(t.start(), t.end(), t.group()) for t in _TOKEN.finditer(text, at, end)]
        if tokens:
            yield tokens
        at = m.end() if m else end


def shape(word: str) -> str:
    """Capitals, small letters and digits as X, x and 0; runs as one."""
    kinds = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word[:24])
    return _RUNS.sub(r"\1", kinds)


def _row(feature: str) -> int:
    return zlib.crc32(feature.encode()) % ROWS


class Features:
    """Weight rows of each word of a sentence; what a word adds by itself is remembered."""

    def __init__(self, memo: int = 100_000):
        self.memo, self.own, self.near = memo, {}, {}

    def _own(self, w):
        got = self.own.get(w)
        if got is None:
            if len(self.own) >= self.memo:
                self.own.clear()
                self.near.clear()
            low, s = w.lower(), shape(w)
            got = self.own[w] = ([_row("w" + low), _row("p" + low[:3]), _row("e" + low[-3:])], _row("s" + s), s)
        return got

    def _near(self, place, w):
        got = self.near.get((place, w))
        if got is None:
            got = self.near[(place, w)] = (_row(f"{place}w{w.lower()}"), _row(f"{place}s{shape(w)}"))
        return got

    def rows(self, words: list[str], hidden=()) -> list[list[int]]:
        """``hidden``: places whose words show their shape only."""
        padded, out = ["<", "<", *words, ">", ">"], []
        for i, w in enumerate(words):
            own, shape_row, s = self._own(w)
            got = [0, shape_row, *(() if i in hidden else own)]
            for place in (-2, -1, 1, 2):
                j = i + place
                if j in hidden:
                    got.append(_row(f"{place}hidden"))
                else:
                    got += self._near(place, padded[j + 2])
            got.append(_row(f"{s}|{padded[i + 1].lower() if i - 1 not in hidden else ''}"))
            if i == 0:
                got.append(_row("first" + s))
            out.append(got)
        return out


def viterbi(scores: np.ndarray, follow: np.ndarray) -> list[int]:
    """The best tag sequence: ``scores`` (words, tags), ``follow`` (tag before, tag); ties to the lower tag."""
    best, back = scores[0], []
    for s in scores[1:]:
        reach = best[:, None] + follow
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def viterbi_many(scores: np.ndarray, sizes: np.ndarray, follow: np.ndarray, side_by_side: int = 512) -> np.ndarray:
    """``viterbi`` of sentences whose words' scores stand one after the other, some hundred sentences at a time."""
    out, starts = np.zeros(len(scores), np.int64), np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    for lo in range(0, len(order), side_by_side):
        group = order[lo:lo + side_by_side]
        at, n = starts[group], sizes[group]
        best, back = scores[at].copy(), []
        for t in range(1, int(n[0])):
            live = int(np.searchsorted(-n, -t, "left"))  # sentences of more than t words come first
            reach = best[:live, :, None] + follow
            back.append(reach.argmax(axis=1))
            best[:live] = reach.max(axis=1) + scores[at[:live] + t]
        tag = best.argmax(axis=1)
        for t in range(int(n[0]) - 1, 0, -1):
            live = len(back[t - 1])
            out[at[:live] + t] = tag[:live]
            tag[:live] = back[t - 1][np.arange(live), tag[:live]]
        out[at] = tag
    return out


class Tagger:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.tags = ["O", *(f"{p}-{x}" for x in labels for p in "BI")]
        k = len(self.tags)
        self.weights, self.follow = np.zeros((ROWS, k)), np.zeros((k, k))
        # I-x only after B-x or I-x
        self.banned = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] and a != "O" else -1e9 for b in self.tags] for a in self.tags])
        self.start = np.array([-1e9 if t.startswith("I-") else 0.0 for t in self.tags])
        self.read, self.made_of = Features(), None

    @staticmethod
    def flat(rows):
        """The rows of all words one after the other, and where each word's start."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter((r for row in rows for r in row), np.int64, int(sizes.sum())), np.cumsum(sizes) - sizes

    def scores(self, rows):
        flat, starts = rows if isinstance(rows, tuple) else self.flat(rows)
        return np.add.reduceat(self.weights[flat], starts, axis=0)

    def tag(self, words, hidden=()):
        s = self.scores(self.read.rows(words, hidden))
        s[0] += self.start
        return viterbi(s, self.follow + self.banned)

    def _forget(self):
        """An empty table of words; the next ``tag_many`` fills it anew."""
        self.ids, self.low, self.shapes, self.shape_names, self.made_of = {}, [], {}, [], self.weights
        k = len(self.tags)
        self.table, self.shape_of, self.first = np.zeros((0, 5, k), self.weights.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self):
        """Rows of the table for words that have none yet: scores of the word by itself and at four places of a neighbour."""
        words = list(self.ids)[len(self.low):]
        rows, shape_of, first = [[] for _ in range(5)], [], []
        for w in words:
            low, s = w.lower(), shape(w)
            self.low.append(low)
            rows[0].append([0, _row("s" + s), _row("w" + low), _row("p" + low[:3]), _row("e" + low[-3:])])
            for i, place in enumerate((-2, -1, 1, 2), start=1):
                rows[i].append([_row(f"{place}w{low}"), _row(f"{place}s{s}")])
            if s not in self.shapes:
                self.shapes[s] = len(self.shapes)
                self.shape_names.append(s)
            shape_of.append(self.shapes[s])
            first.append(_row("first" + s))
        if not words:
            return
        old, n = len(self.shape_of), len(self.low)
        if len(self.table) < n:
            self.table = np.concatenate([self.table[:old], np.zeros((max(n, 2 * old) - old, *self.table.shape[1:]), self.table.dtype)])
        for i, r in enumerate(rows):
            self.table[old:n, i] = self.scores(r)
        self.shape_of, self.first = np.append(self.shape_of, shape_of), np.append(self.first, first)

    def tag_many(self, sentences: list[list[str]]) -> np.ndarray:
        """Tags of all words, one sentence after the other, as ``tag`` gives them: what a word adds to its own
        place and to its neighbours' is added up once for each word and remembered, up to ``MEMO`` words."""
        if self.made_of is not self.weights or len(self.ids) > MEMO:
            self._forget()
        ids = self.ids
        edge, end = (ids.setdefault(w, len(ids)) for w in "<>")
        sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
        padded = np.fromiter((x for s in sentences for x in (edge, edge, *[ids.setdefault(w, len(ids)) for w in s], end, end)), np.int64, int(sizes.sum() + 4 * len(sizes)))
        self._learn()
        first = np.cumsum(sizes + 4) - sizes - 2
        at = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        s = self.table[padded[at], 0]
        for i, place in enumerate((-2, -1, 1, 2), start=1):
            s += self.table[padded[at + place], i]
        pairs, of = np.unique(self.shape_of[padded[at]] * len(ids) + padded[at - 1], return_inverse=True)
        s += self.weights[[_row(f"{self.shape_names[p // len(ids)]}|{self.low[p % len(ids)]}") for p in pairs.tolist()]][of]
        begin = np.cumsum(sizes) - sizes
        s[begin] += self.weights[self.first[padded[first]]] + self.start
        return viterbi_many(s, sizes, self.follow + self.banned)

    def fit(self, examples: list[tuple[list[str], list[int]]], passes: int = PASSES, seed: int = SEED) -> Tagger:
        """``examples``: words and tag numbers of sentences."""
        rng, step = random.Random(seed), 0
        w_sum, f_sum = np.zeros_like(self.weights), np.zeros_like(self.follow)
        order, known = list(range(len(examples))), {}
        for k in range(passes):
            rng.shuffle(order)
            for i in order:
                words, gold = examples[i]
                step += 1
                rows, flat = known.get((i, k % 2), (None, None))
                if rows is None:
                    rows = self.read.rows(words, frozenset(j for j, t in enumerate(gold) if t) if k % 2 == 0 else frozenset())
                    flat = self.flat(rows)
                    known[(i, k % 2)] = rows, flat
                s = self.scores(flat)
                s[0] += self.start
                guess = viterbi(s, self.follow + self.banned)
                for j, (g, t) in enumerate(zip(guess, gold)):
                    if g != t:
                        for table, by in ((self.weights, 1.0), (w_sum, float(step))):
                            np.add.at(table, (rows[j], t), by)
                            np.add.at(table, (rows[j], g), -by)
                    if j and (g, guess[j - 1]) != (t, gold[j - 1]):
                        for table, by in ((self.follow, 1.0), (f_sum, float(step))):
                            table[gold[j - 1], t] += by
                            table[guess[j - 1], g] -= by
        if step:  # the average of the weights after every step
            self.weights -= w_sum / (step + 1)
            self.follow -= f_sum / (step + 1)
        self.made_of = None
        return self

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str], block: int = BLOCK_WORDS) -> list[list[tuple[int, int, str]]]:
        """The spans of each text; sentences are tagged in blocks of about ``block`` words, whatever the texts' lengths."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        held, n = [], 0

        def flush():
            tags = iter(self.tag_many([[w for _, _, w in s] for _, s in held]).tolist() if held else ())
            for i, s in held:
                out[i] += self._joined(s, tags)
            held.clear()

        for i, t in enumerate(texts):
            for s in sentence_tokens(t):
                held.append((i, s))
                n += len(s)
                if n >= block:
                    flush()
                    n = 0
        flush()
        return out

    def _joined(self, tokens, tags):
        open_ = None
        for (start, end, _), t in zip(tokens, tags):
            tag = self.tags[t]
            if tag.startswith("I-") and open_:
                open_ = (open_[0], end, open_[2])
                continue
            if open_:
                yield open_
            open_ = (start, end, tag[2:]) if t else None
        if open_:
            yield open_

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, weights=self.weights.astype(np.float32), follow=self.follow, labels=np.array(self.labels, dtype=str))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tagger:
        with np.load(io.BytesIO(raw)) as z:
            got = cls([str(x) for x in z["labels"]])
            got.weights, got.follow = z["weights"], z["follow"]
        return got


def labelled_sentences(text: str, spans, labels: list[str]):
    """(words, tag numbers) of the sentences of a text; a word belongs to the span that it starts in."""
    place = {x: 1 + 2 * i for i, x in enumerate(labels)}
    spans = sorted(s for s in spans if s[2] in place)
    k = 0
    for tokens in sentence_tokens(text):
        tags = []
        for start, _, _ in tokens:
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            inside = k < len(spans) and spans[k][0] <= start
            tags.append(0 if not inside else place[spans[k][2]] + (spans[k][0] != start and bool(tags)))
        yield [w for _, _, w in tokens], tags


def fit_tagger(docs: DataFrame, text_col: str, gazetteer=D.GAZETTEER_EN, max_train: int = MAX_TRAIN, passes: int = PASSES) -> bytes:
    """Weights learnt in one task from the ``max_train`` texts of the least hashes; rows that repeat a
    text count once."""
    entries = D.as_dictionary(gazetteer)
    labels = sorted({label for label, _ in entries.rows if label in NAMES})
    rules, index = [(label, re.compile(p)) for label, p in M.DETECTORS], EN._gazetteer_index(entries)
    sample = docs.select(F.col(text_col).cast("string").alias("t")).where("t is not null").groupBy(F.xxhash64("t").alias("h")).agg(
        F.first("t").alias("t")).orderBy("h").limit(max_train)

    def run(batches):
        named, other = [], []
        for b in batches:
            for t in b.column("t").to_pylist():
                for words, tags in labelled_sentences(t, EN.find_spans(t, rules, index), labels):
                    (named if any(tags) else other).append((words, tags))
        rng = random.Random(SEED)
        named = rng.sample(named, min(len(named), MAX_SENTENCES))
        other = rng.sample(other, min(len(other), len(named)))
        yield pa.RecordBatch.from_arrays([pa.array([Tagger(labels).fit(named + other, passes).dump()], pa.binary())], ["weights"])

    made = stored(sample.coalesce(1).select("t").mapInArrow(run, "weights binary"), "tagger").first()
    return made["weights"] if made else Tagger(labels).dump()


def with_names(known, named) -> list[tuple[int, int, str]]:
    """Spans of detectors and gazetteer, and the tagger's where they leave room; both in order of place."""
    out, k = list(known), 0
    for s, e, label in named:
        while k < len(known) and known[k][1] <= s:
            k += 1
        if k == len(known) or known[k][0] >= e:
            out.append((s, e, label))
    return sorted(out)


def make_tagging_detector(spark, weights: bytes, gazetteer=D.GAZETTEER_EN):
    """Pandas UDF: text -> spans for ``masking.mask_spans``, like ``entities.make_span_detector`` and with names
    that the gazetteer lacks. NULL stays NULL."""
    rules, index = [(label, re.compile(p)) for label, p in M.DETECTORS], EN._gazetteer_index(gazetteer)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    held = {}

    @F.pandas_udf(EN.SPAN_TYPE)
    def detect(texts: pd.Series) -> pd.Series:
        if "tagger" not in held:
            held["tagger"] = Tagger.load(shared.value)
        given = ["" if t is None else t for t in texts]
        found = [with_names(EN.find_spans(t, rules, index), named) for t, named in zip(given, held["tagger"].spans_of(given))]
        return pd.Series([None if t is None else [{"start": s, "end": e, "label": label} for s, e, label in spans]
                          for t, spans in zip(texts, found)])

    return detect


def mask_names(docs: DataFrame, text_col: str, weights: bytes, gazetteer=D.GAZETTEER_EN) -> Column:
    """The text with every span masked."""
    return M.mask_spans(text_col, make_tagging_detector(docs.sparkSession, weights, gazetteer)(text_col))
