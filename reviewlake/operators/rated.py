"""Batch scoring under one budget of calls that all scoring tasks share.

``score_within_rate`` scores each distinct text with a scorer (as ``scoring.score_with`` does) that may refuse calls:

* Faults are classified. ``RATE``: the service refuses for now; the texts are put back and the task slows down.
  ``TRANSIENT``: the call is repeated at the same pace, a few times. ``PERMANENT``: the texts of a batch are tried one by one, and
  the one that fails is an error at once.
* The budget is split: each of ``tasks`` tasks spaces its calls ``tasks / calls_per_s`` seconds apart, so however many
  of them run at a time the calls of all stay within it. A task that is refused doubles its spacing, and after
  ``patience`` refusals in a row puts back what it has left without calling.
* What was put back is scored in the next round, at half the budget if anything was refused and up
  to a tenth more if not, after the longest wait that the service asked for. Rounds go on until nothing is put back;
  ``idle_rounds`` rounds in a row without one answer end it, and the rest is marked as refused.

Every round appends its outcomes to a table in the shared folder; a lost executor repeats the calls of its task only, a
rerun with the same ``results_path`` scores what has no answer yet. The driver reads three figures a round.

Defined results: a null text is scored as an empty one; equal texts are scored once; an empty table has no round.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.operators.scoring import Scorer, earlier_results
from reviewlake.session import scratch_dir, stored

RATE, TRANSIENT, PERMANENT = "rate", "transient", "permanent"


class RateLimited(Exception):
    """A refusal; ``retry_after`` is the wait in seconds that the service asked for."""

    def __init__(self, message: str = "rate limit", retry_after: float = 0.0):
        super().__init__(message)
        self.retry_after = retry_after


def classify(error: Exception) -> str:
    """The kind of a fault by its class, its ``status`` or ``status_code``, or a 429 in its message."""
    status = getattr(error, "status_code", None) or getattr(error, "status", None)
    if isinstance(error, RateLimited) or status == 429 or "429" in str(error):
        return RATE
    if isinstance(error, (TimeoutError, ConnectionError)) or (isinstance(status, int) and status >= 500):
        return TRANSIENT
    return PERMANENT


class Pace:
    """Calls at least ``gap`` seconds apart; refusals double the gap."""

    def __init__(self, gap: float, clock=time.monotonic, sleep=time.sleep):
        self.gap, self.clock, self.sleep, self.due = gap, clock, sleep, clock()

    def wait(self) -> None:
        now = self.clock()
        if now < self.due:
            self.sleep(self.due - now)
        self.due = max(now, self.due) + self.gap

    def slower(self) -> None:
        self.gap *= 2
        self.due = max(self.due, self.clock() + self.gap)


def _round(scorer_factory, batch_size: int, gap: float, retries: int, patience: int, kind_of: Callable[[Exception], str]):
    """The task of a round: (_key, value, error, back, wait) per text; ``back`` marks texts to be scored again."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, pace, refused = scorer_factory(), Pace(gap), 0
        # tasks start together: the first call waits for a share of the gap as well
        pace.due += gap

        def call(texts: list[str]):
            """(values, None, 0) or (None, fault, wait)."""
            nonlocal refused
            for left in range(retries, -1, -1):
                pace.wait()
                try:
                    values = list(scorer(texts))
                    if len(values) != len(texts):
                        raise ValueError(f"scorer gave {len(values)} answers to {len(texts)} texts")
                    refused = 0
                    return values, None, 0.0
                except Exception as e:  # noqa: BLE001
                    kind = kind_of(e)
                    if kind == RATE:
                        refused += 1
                        pace.slower()
                        return None, RATE, float(getattr(e, "retry_after", 0.0) or 0.0)
                    if kind == PERMANENT or not left:
                        return None, f"{type(e).__name__}: {e}", 0.0

        def outcomes(texts: list[str]) -> list[tuple]:
            if refused >= patience:
                return [(None, None, True, 0.0)] * len(texts)
            values, fault, wait = call(texts)
            if values is not None:
                return [(v, None, False, 0.0) for v in values]
            if fault == RATE:
                return [(None, None, True, wait)] * len(texts)
            if len(texts) == 1:
                return [(None, fault, False, 0.0)]
            return [o for t in texts for o in outcomes([t])]

        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                got = outcomes([t if t is not None else "" for t in part["_text"]])
                yield pd.DataFrame({"_key": list(part["_key"]), "value": [o[0] for o in got], "error": [o[1] for o in got],
                                    "back": [o[2] for o in got], "wait": [o[3] for o in got]})

    return run


def score_within_rate(df: DataFrame, text_col: str, scorer_factory: Callable[[], Scorer], calls_per_s: float, tasks: int = 8,
                      batch_size: int = 64, retries: int = 2, patience: int = 3, idle_rounds: int = 5, max_wait_s: float = 60.0,
                      results_path: str | None = None, keep: list[str] | None = None, value_type: str = "string",
                      kind_of: Callable[[Exception], str] = classify) -> DataFrame:
    """Add ``value`` and ``error``: the scorer's answer for ``text_col``, at most ``calls_per_s`` calls a second in all."""
    spark = df.sparkSession
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    path = results_path or scratch_dir(spark, "rated")
    texts = df.select(key.alias("_key"), F.col(text_col).alias("_text")).groupBy("_key").agg(F.any_value("_text").alias("_text"))
    if (earlier := earlier_results(spark, path)) is not None:
        texts = texts.join(earlier.where("error is null and not back").select("_key").distinct(), "_key", "left_anti")
    pending = stored(texts, "rated-texts")
    kinds = f"_key string, value {value_type}, error string, back boolean, wait double"
    rate, idle, left = calls_per_s, 0, not pending.isEmpty()
    while left:
        out = scratch_dir(spark, "rated-round")
        run = _round(scorer_factory, batch_size, tasks / rate, retries, patience, kind_of)
        # round robin: however few texts are left, they are dealt to all tasks
        pending.repartition(tasks).mapInPandas(run, kinds).write.parquet(out)
        done = spark.read.schema(kinds).parquet(out)
        done.withColumn("run", F.lit(time.time_ns())).write.mode("append").parquet(path)
        back, wait, scored = done.agg(F.count_if("back"), F.max("wait"), F.count_if(~F.col("back"))).first()
        left = back > 0
        idle = 0 if scored else idle + 1
        if not left or idle >= idle_rounds:
            break
        pending = stored(pending.join(done.where("back").select("_key"), "_key", "left_semi"), "rated-texts")
        rate = max(rate / 2, 1 / max_wait_s) if (wait or 0) > 0 or back > scored else min(rate * 1.1, calls_per_s)
        time.sleep(min(wait or 0.0, max_wait_s))
    best = (F.col("value").isNotNull() & F.col("error").isNull(), ~F.col("back"), F.col("run"))
    found = earlier_results(spark, path)
    if found is None:
        found = spark.createDataFrame([], kinds + ", run long")
    found = found.groupBy("_key").agg(F.max_by(F.struct("value", "error", "back"), F.struct(*[b.alias(f"o{i}") for i, b in enumerate(best)])).alias("_r"))
    found = found.select("_key", "_r.value", F.when(F.col("_r.back"), F.lit("RateLimited: refused")).otherwise(F.col("_r.error")).alias("error"))
    keyed = df.select(*(keep if keep is not None else df.columns), key.alias("_key"))
    return keyed.join(found, "_key", "left").drop("_key")


def refusing_stub_factory(least_gap_s: float) -> Callable[[], Scorer]:
    """A stand-in for a limited service, for tests and the registered query: labels as the plain stub does, and refuses a call
    that comes sooner than ``least_gap_s`` after the last one it accepted from this client."""
    from reviewlake.operators.scoring import stub_label_scorer_factory
    label = stub_label_scorer_factory("none")

    def factory() -> Scorer:
        score, last = label(), [float("-inf")]

        def limited(texts: list[str]) -> list[str]:
            now = time.monotonic()
            if now - last[0] < least_gap_s:
                raise RateLimited(retry_after=least_gap_s)
            last[0] = now
            return score(texts)
        return limited
    return factory
