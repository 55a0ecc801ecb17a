"""Main text of web pages by a recurrent block labeller (operator 13).

A page is its sequence of leaf blocks. A block's input is the mean vector of the hashed names on its tag path
(tags, classes, ids, roles), the mean vector of its hashed words, and six figures (length, words, share of links,
punctuation, place). A bidirectional LSTM in numpy reads all blocks of a page in both directions and labels every
one, so each decision sees the whole document; blocks labelled as article are joined in page order.

The network is trained in one Spark task on at most ``max_train`` pages, chosen by hash: pages with one article
element label themselves (what stands in menus, footers, adverts and the like inside or outside it is not text),
and their texts are set again in invented layouts whose parts are known. Only the training set is bounded; every
block of every page is labelled. Weights come from fixed seeds and are broadcast (under 1 MB).

Defined results: null and empty pages have an empty text; pages without tags are one block; text in script,
style, head, select, svg and the like is never a block; cut-off and malformed pages are read as far as they go;
repeated rows are extracted each; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .html_blocks import Block, blocks, dressed

#: Pages of the training set, invented layouts for each of them, passes over all.
MAX_TRAIN, LAYOUTS, PASSES = 240, 6, 7
#: Hash buckets of path names and of words, size of their vectors, of the hidden state.
NAMES, WORDS, VECTOR, HIDDEN = 2048, 4096, 16, 24
FIGURES = 6
#: Pages that the network reads side by side.
SIDE_BY_SIDE = 64
SEED = 13
#: Bucket numbers of words that a worker remembers.
MEMO = 200_000

# Names on a path that are not article even inside an article element.
OTHER_TAGS = frozenset(("nav", "aside", "footer", "form", "button"))
OTHER_WORDS = frozenset(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "cookie", "consent", "notice", "comment", "comments", "share",
                         "social", "related", "sidebar", "menu", "nav", "newsletter", "subscribe"))
#: Article texts for a training set that has no page of its own.
STOCK = ["The river rises in the northern hills and runs for two hundred miles to the sea.", "It was first surveyed long ago by two engineers.",
         "Three towns stand on its banks, and each has a bridge of its own.", "Boats carried stone and grain until the railway came.",
         "Today most visitors come for the quiet paths along the water.", "A small museum shows tools, maps and letters of that time."]


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = zlib.crc32(word.encode()) % WORDS
        return got


class Figures:
    """Blocks as numbers: hashed path names, hashed words and figures."""

    def __init__(self):
        self.words, self.paths = _Buckets(), {}

    def _path(self, path):
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) >= MEMO:
                self.paths.clear()
            names = [x for tag, words in path for x in (tag, *words)] + (["<" + path[-1][0]] if path else [])
            got = self.paths[path] = np.array([zlib.crc32(x.encode()) % NAMES for x in names] or [0], np.int32)
        return got

    def page(self, bs: list[Block]):
        paths, words, figures = [], [], np.zeros((len(bs), FIGURES))
        for i, b in enumerate(bs):
            n = len(b.text)
            w = list(map(self.words.__getitem__, b.text.lower().split()))
            paths.append(self._path(b.path))
            words.append(np.array(w or [0], np.int32))
            ends = b.text.count(".") + b.text.count(",")
            figures[i] = (np.log1p(n) / 6, np.log1p(len(w)) / 4, b.linked / n, min(1.0, ends / max(1, len(w))), i / len(bs), np.log1p(len(bs)) / 6)
        return paths, words, figures


def _mean_rows(table, ids):
    """Mean of the table's rows named by each array, and where each array starts."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(table[np.concatenate(ids)], starts, axis=0) / sizes[:, None], sizes


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embedding tables, a bidirectional LSTM and a logistic output; training by Adam over back-propagation."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        rng, size = np.random.default_rng(seed), 2 * VECTOR + FIGURES
        self.hidden = hidden
        self.w = {"names": rng.normal(0, 0.3, (NAMES, VECTOR)), "words": rng.normal(0, 0.02, (WORDS, VECTOR)),
                  "out": rng.normal(0, 0.2, 2 * hidden), "bias": np.zeros(1)}
        for d in ("f", "b"):
            self.w |= {d + "x": rng.normal(0, size ** -0.5, (size, 4 * hidden)), d + "h": rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden)),
                       d + "c": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])}

    # ``x``: (steps, pages, inputs); ``mask``: (steps, pages), 0 behind a page's last block.
    def _inputs(self, pages):
        steps, n = max(len(p[0]) for p in pages), len(pages)
        kind = self.w["out"].dtype
        x, mask = np.zeros((steps, n, 2 * VECTOR + FIGURES), kind), np.zeros((steps, n), kind)
        at_step = np.concatenate([np.arange(len(p[0])) for p in pages])
        at_page = np.repeat(np.arange(n), [len(p[0]) for p in pages])
        for lo, name, k in ((0, "names", 0), (VECTOR, "words", 1)):
            x[at_step, at_page, lo:lo + VECTOR] = _mean_rows(self.w[name], [b for p in pages for b in p[k]])[0]
        x[at_step, at_page, 2 * VECTOR:] = np.concatenate([p[2] for p in pages])
        mask[at_step, at_page] = 1
        return x, mask, at_step, at_page

    def _direction(self, d, x, mask, keep):
        h = np.zeros((x.shape[1], self.hidden), x.dtype)
        c, out, memory = h, np.zeros((*x.shape[:2], self.hidden), x.dtype), []
        z_in = x @ self.w[d + "x"] + self.w[d + "c"]
        for t in (range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)):
            z = z_in[t] + h @ self.w[d + "h"]
            gates, g = _sigmoid(z[:, :3 * self.hidden]), np.tanh(z[:, 3 * self.hidden:])
            i, f, o = np.split(gates, 3, axis=1)
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                memory.append((t, h, c, i, f, o, g, tc, m))
            h, c = m * o * tc + (1 - m) * h, m * c2 + (1 - m) * c
            out[t] = h
        return out, memory

    def _backward(self, d, x, memory, d_out, grad):
        dh = dc = np.zeros((x.shape[1], self.hidden))
        dz_all = np.zeros((*x.shape[:2], 4 * self.hidden))
        wh = self.w[d + "h"]
        for t, h, c, i, f, o, g, tc, m in reversed(memory):
            dh = dh + d_out[t]
            do, dc2 = dh * m * tc, dh * m * o * (1 - tc * tc) + dc * m
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad[d + "h"] += h.T @ dz
            dh, dc = dz @ wh.T + dh * (1 - m), dc2 * f + dc * (1 - m)
        flat = dz_all.reshape(-1, 4 * self.hidden)
        grad[d + "x"] += x.reshape(-1, x.shape[2]).T @ flat
        grad[d + "c"] += flat.sum(axis=0)
        return dz_all @ self.w[d + "x"].T

    def chances(self, pages) -> list[np.ndarray]:
        """The chance of being article for every block of every page (pages have at least one block)."""
        x, mask, at_step, at_page = self._inputs(pages)
        h = np.concatenate([self._direction(d, x, mask, False)[0] for d in "fb"], axis=2)
        p = _sigmoid(h @ self.w["out"] + self.w["bias"])
        return [p[:len(page[0]), k] for k, page in enumerate(pages)]

    def gradient(self, pages, labels):
        """Loss (mean over blocks) and its gradient."""
        x, mask, at_step, at_page = self._inputs(pages)
        runs = {d: self._direction(d, x, mask, True) for d in "fb"}
        h = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid(h @ self.w["out"] + self.w["bias"])
        y = np.zeros_like(p)
        y[at_step, at_page] = np.concatenate(labels)
        total = mask.sum()
        loss = -(mask * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() / total
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        dz = mask * (p - y) / total
        grad["out"], grad["bias"] = np.einsum("tn,tnh->h", dz, h), np.array([dz.sum()])
        dh = dz[:, :, None] * self.w["out"]
        dx = sum(self._backward(d, x, runs[d][1], dh[:, :, k * self.hidden:(k + 1) * self.hidden], grad) for k, d in enumerate("fb"))
        for lo, name, k in ((0, "names", 0), (VECTOR, "words", 1)):
            ids = [b for page in pages for b in page[k]]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            each = dx[at_step, at_page, lo:lo + VECTOR] / sizes[:, None]
            np.add.at(grad[name], np.concatenate(ids), np.repeat(each, sizes, axis=0))
        return loss, grad

    def train(self, pages, labels, passes: int = PASSES, rate: float = 0.01, seed: int = SEED):
        rng, m, v, step = random.Random(seed), {}, {}, 0
        by_size = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        groups = [by_size[i:i + 32] for i in range(0, len(by_size), 32)]
        for k in range(passes):
            rng.shuffle(groups)
            for g in groups:
                step += 1
                _, grad = self.gradient([pages[i] for i in g], [labels[i] for i in g])
                r = rate * (1 - k / passes) * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                for name, d in grad.items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * d
                    v[name] = 0.999 * v.get(name, 0) + 0.001 * d * d
                    self.w[name] -= r * m[name] / (np.sqrt(v[name]) + 1e-8)
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype(np.float32) for k, v in self.w.items()})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Labeller:
        got = cls()
        with np.load(io.BytesIO(raw)) as z:
            got.w = {k: z[k] for k in z.files}
        got.hidden = len(got.w["out"]) // 2
        return got


def self_labelled(page: str | None) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page with an article element, or None."""
    bs = blocks(page)
    inside = [any(t == "article" for t, _ in b.path) for b in bs]
    if not any(inside):
        return None

    def other(b):
        below = b.path[next(i for i, (t, _) in enumerate(b.path) if t == "article") + 1:]
        return any(t in OTHER_TAGS or any(w[1:] in OTHER_WORDS for w in ws) for t, ws in below)
    return bs, [int(x and not other(b)) for b, x in zip(bs, inside)]


def train_on(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Labeller:
    """A labeller from raw pages; without usable ones from the stock texts."""
    rng, read, examples = random.Random(seed), Figures(), []
    taught = [x for x in map(self_labelled, pages) if x]
    own = [[b.text for b, y in zip(bs, ys) if y] for bs, ys in taught]
    for texts in [x for x in own if x] or [STOCK] * 40:
        for _ in range(layouts):
            k = rng.randint(1, min(len(texts), 25))
            start = rng.randint(0, len(texts) - k)
            bs = blocks(dressed(texts[start:start + k], rng))
            examples.append((bs, [int(b.label == "1") for b in bs]))
    examples += taught
    return Labeller(seed).train([read.page(bs) for bs, _ in examples], [np.array(ys, float) for _, ys in examples])


def fit(pages: DataFrame, html: str = "html", max_train: int = MAX_TRAIN) -> bytes:
    """The weights, trained in one task on the ``max_train`` pages of the least content hashes."""
    h = F.xxhash64(F.lit("train"), html)
    rows = pages.where(F.col(html).isNotNull()).select(F.col(html).cast("string").alias("html"), h.alias("_h")).orderBy("_h").limit(max_train)

    def run(batches):
        raw = [x for b in batches for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([train_on(raw).dump()], pa.binary())], ["weights"])

    one = in_batches(rows.coalesce(1).select("html")).mapInArrow(run, "weights binary")
    made = written(one, "labeller").first()
    return made["weights"] if made else train_on([]).dump()


def extract(pages: DataFrame, weights: bytes | None = None, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, ``text`` and ``n_chars`` of every row."""
    weights = weights if weights is not None else fit(pages, html)
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    src = pages.select(*keep, F.coalesce(F.col(html).cast("string"), F.lit("")).alias("_html"))

    def run(batches):
        model, read = Labeller.load(shared.value), Figures()
        for batch in batches:
            texts = [""] * batch.num_rows
            read_pages = [(i, blocks(p)) for i, p in enumerate(batch.column("_html").to_pylist())]
            order = sorted((x for x in read_pages if x[1]), key=lambda x: len(x[1]))
            at = 0
            while at < len(order):
                # pages of like length side by side; few at a time where they are long
                group = order[at:at + max(1, min(SIDE_BY_SIDE, 20_000 // len(order[min(at + SIDE_BY_SIDE, len(order)) - 1][1])))]
                for (i, bs), p in zip(group, model.chances([read.page(bs) for _, bs in group])):
                    texts[i] = "\n".join(b.text for b, x in zip(bs, p) if x >= 0.5)
                at += len(group)
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    schema = src.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return in_batches(src).mapInArrow(run, schema)
