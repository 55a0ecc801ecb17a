import fcntl
import os
import tempfile
import time

import pytest

from reviewlake.operators import rated as RA


def shared_service(folder, calls, window_s, log):
    """A service behind all tasks: accepts ``calls`` calls in any ``window_s`` seconds, and keeps a log."""
    def factory():
        def score(texts):
            with open(os.path.join(folder, "lock"), "w") as lock:
                fcntl.flock(lock, fcntl.LOCK_EX)
                path = os.path.join(folder, log)
                past = [line.split() for line in open(path)] if os.path.exists(path) else []
                now = time.time()
                full = sum(ok == "1" and now - float(t) < window_s for t, ok in past) >= calls
                with open(path, "a") as f:
                    f.write(f"{now} {0 if full else 1}\n")
            if full:
                raise RA.RateLimited(retry_after=window_s / 2)
            if any("poison" in t for t in texts):
                raise ValueError("bad text")
            return [t.upper() for t in texts]
        return score
    return factory


def log_of(folder, log):
    return [(float(t), ok == "1") for t, ok in (line.split() for line in open(os.path.join(folder, log)))]


def frame(spark, n=60):
    rows = [(i, f"text {i % 50}") for i in range(n)] + [(1000, "poison"), (1001, None), (1002, "")]
    return spark.createDataFrame(rows, "id long, t string")


def test_budget_holds_across_tasks(spark):
    d = tempfile.mkdtemp(prefix="rl-rated-")
    out = RA.score_within_rate(frame(spark), "t", shared_service(d, 10 ** 6, 1.0, "log"), calls_per_s=20, tasks=4, batch_size=4).collect()
    assert {r.value for r in out if r.id < 1000} == {f"TEXT {i}" for i in range(50)}
    assert {r.id: (r.value, r.error) for r in out if r.id >= 1000} == {1000: (None, "ValueError: bad text"), 1001: ("", None), 1002: ("", None)}
    times = sorted(t for t, _ in log_of(d, "log"))
    for i, t in enumerate(times):  # any second holds the budget, and one call a task for where the window cuts
        assert sum(t <= x < t + 1 for x in times[i:]) <= 20 + 4


def test_refused_texts_are_scored_in_later_rounds(spark):
    d = tempfile.mkdtemp(prefix="rl-rated-")
    # the service takes a quarter of what the budget says
    out = RA.score_within_rate(frame(spark), "t", shared_service(d, 5, 1.0, "log"), calls_per_s=20, tasks=4, batch_size=4, patience=2)
    rows = out.collect()
    assert len(rows) == 63 and all(r.error is None and r.value == (f"TEXT {r.id % 50}" if r.id < 1000 else "") for r in rows if r.id != 1000)
    log = log_of(d, "log")
    assert not all(ok for _, ok in log)


def test_rounds_end_when_everything_is_refused_and_a_rerun_goes_on(spark):
    d = tempfile.mkdtemp(prefix="rl-rated-")
    path = os.path.join(d, "results")
    df = frame(spark, 5)
    out = RA.score_within_rate(df, "t", shared_service(d, 0, 0.02, "no"), 200, tasks=2, idle_rounds=2, results_path=path).collect()
    assert {r.error for r in out} == {"RateLimited: refused"} and all(r.value is None for r in out)
    out = RA.score_within_rate(df, "t", shared_service(d, 10 ** 6, 1.0, "yes"), 200, tasks=2, results_path=path).collect()
    assert sum(r.error is None for r in out) == 7
    RA.score_within_rate(df, "t", shared_service(d, 10 ** 6, 1.0, "again"), 200, tasks=2, results_path=path).collect()
    assert len(log_of(d, "again")) == 1  # the poisoned text alone


def test_empty_table(spark):
    out = RA.score_within_rate(spark.createDataFrame([], "id long, t string"), "t", RA.refusing_stub_factory(0), 10)
    assert out.columns == ["id", "t", "value", "error"] and out.count() == 0


@pytest.mark.parametrize("error,kind", [(RA.RateLimited(), RA.RATE), (RuntimeError("HTTP 429"), RA.RATE), (TimeoutError(), RA.TRANSIENT),
                                        (ConnectionResetError(), RA.TRANSIENT), (ValueError("x"), RA.PERMANENT)])
def test_classes_of_faults(error, kind):
    assert RA.classify(error) == kind


def test_pace():
    now, slept = [0.0], []
    def sleep(s):
        slept.append(s)
        now[0] += s
    p = RA.Pace(2.0, clock=lambda: now[0], sleep=sleep)
    p.wait(), p.wait(), p.slower(), p.wait()
    assert slept == [2.0, 4.0]
