"""Batch scoring with a user-supplied model, and extractive answers/summaries.

``score_with`` is the slot for any per-text model (chat labeller, rating
model, NER).  The scorer is built once per task by ``scorer_factory`` and
called on lists of texts (Arrow batches via ``mapInPandas``).  Each distinct
text is scored once (inputs are keyed by a SHA-256 of the text and
deduplicated by an aggregate, which is combined map-side), failures are kept
in an ``error`` column instead of a fake answer, a failed batch is split and
each text is retried with backoff, and results can be written to a shared folder so a rerun only scores
what is missing (anti-join on the key).

``answer_extractive`` and ``summarise`` are the model-free default for question
answering: the sentence that shares the most terms with the question, with
deterministic tie-breaks, and all answers of a question joined in two levels.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.operators.joins import small_side

Scorer = Callable[[list[str]], list[str]]


def earlier_results(spark, path: str) -> DataFrame | None:
    """Results of earlier runs, or None when there are none; any other fault is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def score_with(df: DataFrame, text_col: str, scorer_factory: Callable[[], Scorer],
               batch_size: int = 64, max_retries: int = 3, backoff_s: float = 0.5,
               results_path: str | None = None, tasks: int | None = None,
               keep: list[str] | None = None, value_type: str = "string") -> DataFrame:
    """Add ``value`` and ``error`` columns: the scorer's answer for ``text_col``.

    ``results_path`` (a folder under the shared checkpoint folder) keeps scored
    keys; a rerun reads it, scores the keys without a success (new ones and failed
    ones), and appends; the newest result of a key counts.  ``tasks`` is the number of
    scoring tasks, i.e. of clients that call a model at a time.  ``keep`` names the
    columns that meet the answers again (all by default; leave the text out when it
    is not needed, and only keys and answers are joined).  ``value_type`` is the type of an
    answer, e.g. ``array<double>`` for an embedding model.
    """
    spark = df.sparkSession
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    uniq = df.select(key.alias("_key"), F.col(text_col).alias("_text")).groupBy("_key").agg(
        F.any_value("_text").alias("_text"))
    if results_path is not None and (earlier := earlier_results(spark, results_path)) is not None:
        uniq = uniq.join(earlier.where("error is null").select("_key").distinct(), "_key", "left_anti")
    if tasks:
        uniq = uniq.repartition(tasks, "_key")

    def answers(scorer: Scorer, texts: list[str]) -> list[str]:
        values = list(scorer(texts))
        if len(values) != len(texts):
            raise ValueError(f"scorer gave {len(values)} answers to {len(texts)} texts")
        return values

    def score_each(scorer: Scorer, texts: list[str]):
        """Each text alone, up to ``max_retries`` times; those that fail wait together before the next attempt."""
        pairs: list = [None] * len(texts)
        left = list(range(len(texts)))
        for attempt in range(max_retries):
            failed = []
            for i in left:
                try:
                    pairs[i] = (answers(scorer, [texts[i]])[0], None)
                except Exception as e:  # noqa: BLE001
                    pairs[i] = (None, f"{type(e).__name__}: {e}")
                    failed.append(i)
            left = failed
            if not left:
                break
            if attempt + 1 < max_retries:
                time.sleep(backoff_s * (2 ** attempt))
        return [p or (None, None) for p in pairs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_factory()
        for pdf in batches:
            keys, texts = list(pdf["_key"]), [t if t is not None else "" for t in pdf["_text"]]
            pairs: list = [None] * len(texts)
            alone: list[int] = []
            for start in range(0, len(texts), batch_size):
                part = range(start, min(start + batch_size, len(texts)))
                try:
                    for i, v in zip(part, answers(scorer, [texts[i] for i in part])):
                        pairs[i] = (v, None)
                except Exception:  # noqa: BLE001
                    # the batch failed: score each text alone (with retry and
                    # backoff) so one bad input does not take the others down
                    alone += part
            for i, p in zip(alone, score_each(scorer, [texts[i] for i in alone])):
                pairs[i] = p
            yield pd.DataFrame({"_key": keys, "value": [v for v, _ in pairs], "error": [e for _, e in pairs]})

    scored = uniq.mapInPandas(run, f"_key string, value {value_type}, error string")
    if results_path is not None:
        scored.withColumn("run", F.lit(time.time_ns())).write.mode("append").parquet(results_path)
        scored = (spark.read.parquet(results_path).groupBy("_key")
                  .agg(F.max_by(F.struct("value", "error"), F.struct(F.col("error").isNull(), "run")).alias("_r"))
                  .select("_key", "_r.*"))
    keyed = df.select(*(keep if keep is not None else df.columns), key.alias("_key"))
    return keyed.join(scored, "_key", "left").drop("_key")


def coverage(scored: DataFrame) -> DataFrame:
    """One row: how many rows have an answer, how many failed, how many there are."""
    return scored.agg(F.count("value").alias("n_scored"), F.count("error").alias("n_failed"),
                      F.count(F.lit(1)).alias("n_rows"))


def stub_label_scorer_factory(fail_suffix: str = "0") -> Callable[[], Scorer]:
    """A deterministic stand-in for a remote labeller, for tests and the registered
    query: label by counts of a few function words; texts whose SHA-256 ends in
    ``fail_suffix`` raise, to exercise error isolation."""
    import hashlib

    def factory() -> Scorer:
        def score(texts: list[str]) -> list[str]:
            out = []
            for t in texts:
                if hashlib.sha256(t.encode()).hexdigest().endswith(fail_suffix):
                    raise RuntimeError("scorer rejected input")
                low = t.lower().split()
                pos = low.count("the") + low.count("la")
                neg = low.count("of") + low.count("der")
                out.append("positive" if pos > neg else "negative" if neg > pos else "neutral")
            return out
        return score
    return factory


# --- extractive answers ------------------------------------------------------------------
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n+"


def sentences(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys..., sent_pos, sentence) for non-blank sentences of the whole text."""
    parts = F.split(F.col(text_col), SENTENCE_SPLIT)
    out = df.select(*keys, F.posexplode(parts).alias("sent_pos", "sentence"))
    return out.where(F.length(F.trim("sentence")) > 0)


def answer_extractive(neighbours: DataFrame, chunk_texts: DataFrame, questions: DataFrame,
                      group: list[str], item_id: str, text_col: str = "text",
                      question_text: str = "question") -> DataFrame:
    """Best sentence per group (e.g. batch, question) among its retrieved chunks.

    Score = number of distinct question terms in the sentence; ties by chunk
    rank, then sentence position; a NULL answer when no sentence shares a term.
    Only retrieved chunks are cut into sentences.  Groups hold k chunks, so they
    are bounded.
    """
    wanted = neighbours.select(item_id).distinct()
    near = chunk_texts.select(item_id, text_col).join(wanted, item_id, "left_semi")
    sent = sentences(near, [item_id], text_col)
    sent = sent.withColumn("_st", F.array_distinct(T.tokens("sentence")))
    s = neighbours.select(*group, "rank", item_id).join(sent, item_id, "inner")
    q = questions.select("question_id", F.array_distinct(T.tokens(question_text)).alias("_qt"))
    # few questions: a shuffle by question would put all sentences into as many tasks
    s = s.join(small_side(q.sparkSession, q), "question_id", "inner")
    scored = s.withColumn("score", F.size(F.array_intersect("_st", "_qt")).cast("bigint"))
    # arg-max as an aggregate, combined before the shuffle: score, then chunk rank, then position
    best = scored.groupBy(*group).agg(F.min_by(
        F.struct("sentence", "score"), F.struct(-F.col("score"), F.col("rank"), F.col("sent_pos"))).alias("_b"))
    hit = F.col("_b.score") > 0
    return best.select(*group, F.when(hit, F.col("_b.sentence")).alias("answer"), F.col("_b.score").alias("score"))
