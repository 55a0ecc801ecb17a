"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Learning takes a bounded sample of labelled rows (``MAX_TRAIN``, in the order of a hash of
the id; never rows of the held-out fold) and splits it in three by that hash: one part gives the
lexicon, one the trees, one the calibration, so that none sees the rows that it is judged on.

* Lexicon: words and word beginnings of 4 to 8 letters whose document frequency among toxic
  rows exceeds that among others; its size is bounded.
* Features per text: densities, sums and spread of lexicon hits, hits near second-person
  words, capitals, punctuation, obfuscated spellings, word length, size.
* Trees and calibration: Spark ML's GBTClassifier and IsotonicRegression. A thousandth of the
  uncalibrated probability breaks the ties that the calibration's steps leave.

Scoring is one map over all texts; nothing of it is gathered.

Defined results: a null or empty text has all features zero and a score like any other; a null
doc_id is never held out and never learnt from; rows that repeat are scored each; several
labels of a doc_id count as toxic if one is; without toxic or without other labels every score is
the share of toxic rows; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, whole_text, written

MAX_TRAIN = 16_000  # labelled rows that learning may take
MAX_LEXICON = 6_000
THRESHOLD, FOLDS, HELD_OUT = 0.3, 4, 2
TIE = 0.001
SEED = 7

# Second-person words of the languages covered.
SECOND_PERSON = {
    "you", "your", "yours", "yourself", "yourselves", "u", "ur",
    "tu", "toi", "te", "vous", "votre", "vos", "ton", "ta", "tes",
    "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer",
    "tú", "ti", "usted", "ustedes", "vosotros", "vuestro", "tus",
}
# Signs that stand for letters in obfuscated spellings.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
NEAR = 5  # words around a hit in which a second-person word counts

FEATURES = ["hits", "strong", "weight", "top", "kinds", "n_strong", "near_you", "you", "capitals", "shouting",
            "exclamations", "marks", "obfuscated", "obfuscated_hits", "word_length", "size"]

_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_INNER = re.compile(r"[^\W\d_][\d@$*._-]+[^\W\d_]")
_DROP = re.compile(r"[\W\d_]+")
_STRONG = 2.5
_MEMO = 100_000  # words whose code a task remembers
_GRAMS_HELD = 100_000  # counts that a task holds before it hands them on


def stems(word: str) -> tuple[list[str], bool]:
    """What the lexicon may hold of a lower-case word, and whether its spelling is obfuscated."""
    bare = _EDGE.sub("", word)
    odd = _INNER.search(bare) is not None
    if odd:
        bare = _DROP.sub("", bare.translate(LEET))
    if len(bare) < 3:
        return [], odd
    return [bare + "$", *(bare[:k] for k in range(4, min(8, len(bare)) + 1))], odd


def _code(word: str, lexicon: dict[str, float]) -> int:
    """Weight in thousandths, then a bit for an obfuscated spelling and one for the second person."""
    found, odd = stems(word)
    weight = max((lexicon.get(g, 0.0) for g in found), default=0.0)
    return int(weight * 1000) << 2 | odd << 1 | (_EDGE.sub("", word) in SECOND_PERSON)


def features(text: str, lexicon: dict[str, float], memo: dict[str, int]) -> list[float]:
    words = text.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    codes = list(map(memo.get, words))
    if None in codes:
        if len(memo) > _MEMO:
            memo.clear()
        for k, c in enumerate(codes):
            if c is None:
                codes[k] = memo[words[k]] = _code(words[k], lexicon)
    code = np.array(codes)
    weight, odd, you = (code >> 2) / 1000, code >> 1 & 1, code & 1
    hit, strong = weight > 0, weight >= _STRONG
    where = np.flatnonzero(strong)
    seen = np.r_[0, np.cumsum(you)]
    near = (seen[np.minimum(n, where + NEAR + 1)] > seen[np.maximum(0, where - NEAR)]).mean() if len(where) else 0.0
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(raw, minlength=128)
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    marks = kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()
    total = len(raw)
    return [hit.sum() / n, strong.sum() / n, weight.sum() / n, weight.max(), len({words[k] for k in where.tolist()}) / math.sqrt(n),
            math.log1p(len(where)), float(near), you.sum() / n, upper / max(1, upper + lower), float(upper > lower),
            kinds[33] / total, marks / total, odd.sum() / n, (odd & hit).sum() / n, total / n, math.log1p(n)]


def _features(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``rows`` with its last column, the text, turned into the features."""
    keep = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            got = np.array([features(t.as_py(), lexicon, memo) for t in b.column(b.num_columns - 1)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, got.T)], [*keep, *FEATURES])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return in_batches(rows).mapInArrow(run, ", ".join([*kinds, *(f"{f} double" for f in FEATURES)]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int, max_lexicon: int) -> dict[str, float]:
    """Weights (log odds of document frequencies) of words and beginnings that toxic rows prefer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}  # documents without and with the label

        def flush() -> pa.RecordBatch:
            clean, toxic = zip(*seen.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())],
                                              ["gram", "toxic", "clean"])

        for b in batches:
            for toxic, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for g in {g for w in set(t.as_py().lower().split()) for g in stems(w)[0]}:
                    if g in seen:
                        seen[g][toxic] += 1
                    else:
                        seen[g] = [1 - toxic, toxic]
                if len(seen) >= _GRAMS_HELD:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    counts = in_batches(rows).mapInArrow(run, "gram string, toxic long, clean long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(3, round(0.005 * n_toxic))
    top = counts.where(F.col("toxic") >= least).withColumn("weight", weight).where("weight >= 1.5")
    rows_ = top.orderBy(F.desc(F.col("weight") * F.sqrt("toxic")), "gram").limit(max_lexicon).collect()
    return {r["gram"]: r["weight"] for r in rows_}


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, max_train: int) -> DataFrame:
    """(toxic, part, text) of at most ``max_train`` labelled rows outside the held-out fold; part 0..9 by hash."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(
        "_id is not null and toxic in (0, 1)").where(~held_out("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("train"), F.col("_id"))
    chosen = lab.withColumn("_h", order).orderBy("_h", "_id").limit(max_train).withColumn(
        "part", (F.pmod(F.xxhash64(F.lit("part"), F.col("_id")), F.lit(10))).cast("int"))
    # At most ``max_train`` short rows, so the texts need not move to find theirs.
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), whole_text(text).alias("t"))
    return rows.join(F.broadcast(chosen), "_id").select("toxic", "part", "t")


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
             max_train: int = MAX_TRAIN, max_lexicon: int = MAX_LEXICON, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and _r (a hash of the row's text)."""
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(whole_text(text)).alias("_r"), whole_text(text).alias("t"))
    train = written(_sample(docs, labels, text, doc_id, max_train), "toxicity-sample")
    seen = {(r["part"] >= 5, r["part"] >= 8, r["toxic"]): 0 for r in train.select("part", "toxic").distinct().collect()}
    for r in train.groupBy("part", "toxic").count().collect():
        seen[(r["part"] >= 5, r["part"] >= 8, r["toxic"])] += r["count"]
    enough = all(seen.get(k, 0) for k in [(a, b, c) for a, b in ((False, False), (True, False), (True, True)) for c in (0, 1)])
    if not enough:
        n = sum(seen.values())
        share = sum(v for k, v in seen.items() if k[2] == 1) / n if n else 0.0
        scored = src.select("doc_id", "_r", F.lit(share).alias("score"))
    else:
        toxic_a, clean_a = seen[(False, False, 1)], seen[(False, False, 0)]
        lexicon = _learn_lexicon(train.where("part < 5").select("toxic", "t"), toxic_a, clean_a, max_lexicon)
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="x")
        made = written(_features(train.where("part >= 5"), lexicon), "toxicity-features")
        rows = assemble.transform(made.withColumn("label", F.col("toxic").cast("double")))
        trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=25, maxDepth=3, stepSize=0.2, seed=SEED)
        model = trees.fit(rows.where("part < 8").coalesce(2))
        chance = vector_to_array("probability")[1]
        held = model.transform(rows.where("part >= 8")).select("label", chance.alias("p"))
        steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(held.coalesce(1))
        got = model.transform(assemble.transform(_features(src, lexicon))).select("doc_id", "_r", chance.alias("p"))
        got = steps.transform(got)
        scored = got.select("doc_id", "_r", (F.col("calibrated") * (1 - TIE) + F.col("p") * TIE).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "_r")
