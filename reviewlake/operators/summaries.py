"""Summaries of answers, per question, as a tree over blocks of bounded size.

Without a model a summary is extractive. Equal answers of a question are one sentence that weighs as often as it
was given. A block of at most ``block`` sentences is a graph: sentences are linked by the cosine of their term
sets (links below ``least`` are none), damped power iteration ranks them, and sentences are picked one by one by
rank less their likeness to what is picked already. Blocks hand on ``keep`` sentences, neighbouring blocks form the
next level's blocks, and the last block gives the ``length`` sentences of the summary in their first order. With a
model (``scorer_factory``) each block's texts are joined and shortened by it, level by level, until one text is
left: no call and no row ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions import text as T
from reviewlake.operators.scoring import Scorer, score_with
from reviewlake.session import stored

#: Sentences of a block, of those handed on, of the summary.
BLOCK, KEEP, LENGTH = 64, 8, 5
#: Damping and steps of the power iteration, least cosine of a link, weight of rank against likeness.
DAMPING, STEPS, LEAST, BALANCE = 0.85, 20, 0.1, 0.7


def links(terms: list[set], least: float = LEAST) -> np.ndarray:
    """Cosines of term sets; none with itself and none below ``least``."""
    place = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
    m = np.zeros((len(terms), len(place)))
    for i, ts in enumerate(terms):
        m[i, [place[t] for t in ts]] = 1
    size = m.sum(axis=1)
    both = np.sqrt(np.outer(size, size))
    s = np.round(np.divide(m @ m.T, both, out=np.zeros_like(both), where=both > 0), 9)
    np.fill_diagonal(s, 0)
    return np.where(s >= least, s, 0.0)


def ranks(s: np.ndarray, weight: np.ndarray, damping: float = DAMPING, steps: int = STEPS) -> np.ndarray:
    """Shares of a walk that follows links (to heavy sentences more often) and else jumps by weight; the highest is 1."""
    p = weight / weight.sum()
    flow = s * weight
    total = flow.sum(axis=1, keepdims=True)
    move = np.where(total > 0, flow / np.where(total > 0, total, 1), p)
    r = p
    for _ in range(steps):
        r = (1 - damping) * p + damping * (r @ move)
    return np.round(r / r.max(), 6)


def picks(s: np.ndarray, r: np.ndarray, n: int, balance: float = BALANCE) -> list[int]:
    """The ``n`` sentences of the best rank less likeness to those picked before; ties to the earlier one."""
    out: list[int] = []
    like = np.zeros(len(r))
    while len(out) < min(n, len(r)):
        v = np.round(balance * r - (1 - balance) * like, 6)
        v[out] = -np.inf
        out.append(int(v.argmax()))
        like = np.maximum(like, s[:, out[-1]])
    return sorted(out)


def _pick_rows(keep: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["pos", "sentence"]).reset_index(drop=True)
        s = links([set(t) for t in group["terms"]])
        return group.loc[picks(s, ranks(s, group["weight"].to_numpy(float)), keep)]
    return run


def pick_sentences(sentences: DataFrame, per: str, block: int = BLOCK, keep: int = KEEP, length: int = LENGTH) -> DataFrame:
    """(per, pos, sentence, weight) -> at most ``length`` of them for each ``per``; ``pos`` are numbers from 0
    that are unique for each ``per``."""
    level = sentences.select(per, "pos", "sentence", "weight", F.array_distinct(T.tokens("sentence")).alias("terms"),
                             F.floor(F.col("pos") / block).cast("bigint").alias("blk"))
    stop = F.array(*[F.lit(w) for (w,) in D.STOPWORDS_EN.rows])
    level = stored(level.withColumn("terms", F.array_except("terms", stop)), "sentences")
    last = level.agg(F.max("blk")).first()[0] or 0
    while last:
        picked = level.groupBy(per, "blk").applyInPandas(_pick_rows(keep), level.schema)
        level = stored(picked.withColumn("blk", F.floor(F.col("blk") / max(2, block // keep)).cast("bigint")), "sentences")
        last = last // max(2, block // keep)
    return level.groupBy(per, "blk").applyInPandas(_pick_rows(length), level.schema).drop("blk", "terms")


def _shorten(texts: DataFrame, per: str, block: int, factory: Callable[[], Scorer], **scoring) -> DataFrame:
    """(per, pos, text) -> (per, text): joined and shortened by blocks until one is left."""
    level, last = stored(texts, "texts"), None
    while last is None or last > 0:
        joined = level.groupBy(per, F.floor(F.col("pos") / block).cast("bigint").alias("_b")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_t"))
        joined = joined.select(per, F.col("_b").alias("pos"), F.concat_ws(" ", F.transform("_t", lambda x: x["text"])).alias("_text"))
        made = score_with(joined, "_text", factory, keep=[per, "pos"], **scoring)
        level = stored(made.where(F.col("value").isNotNull()).select(per, "pos", F.col("value").alias("text")), "texts")
        last = level.agg(F.max("pos")).first()[0] or 0
    return level.select(per, "text")


def summarise(answers: DataFrame, per: str = "question_id", order_col: str = "batch_id", block: int = BLOCK, keep: int = KEEP,
              length: int = LENGTH, scorer_factory: Callable[[], Scorer] | None = None, **scoring) -> DataFrame:
    """(per, summary, n_batches, n_answered). ``order_col``: whole numbers from 0, one answer for each and question.
    Rows without an answer are counted, never summarised; a question without any answer has an empty summary."""
    counts = answers.groupBy(per).agg(F.count(F.lit(1)).alias("n_batches"), F.count("answer").alias("n_answered"))
    given = answers.where(F.col("answer").isNotNull())
    if scorer_factory is not None:
        made = _shorten(given.select(per, F.col(order_col).alias("pos"), F.col("answer").alias("text")), per, block, scorer_factory, **scoring)
        texts = made.select(per, F.col("text").alias("summary"))
    else:
        once = given.groupBy(per, F.col("answer").alias("sentence")).agg(F.min(order_col).alias("pos"), F.count(F.lit(1)).alias("weight"))
        chosen = pick_sentences(once, per, block, keep, length)
        texts = chosen.groupBy(per).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("_s")).select(
            per, F.concat_ws(" ", F.transform("_s", lambda x: x["sentence"])).alias("summary"))
    return counts.join(texts, per, "left").select(per, F.coalesce("summary", F.lit("")).alias("summary"), "n_batches", "n_answered")
