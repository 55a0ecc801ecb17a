import random

import brute
import numpy as np
import pytest
from conftest import EDGE

from reviewlake.llm import suffix_dedup as SX


def run(df, **kw):
    return sorted((tuple(r)[:1] + tuple(r)[2:] for r in SX.suffix_dedup(df, **kw).collect()), key=str)


def test_cover_has_all_differences():
    assert {(a - b) % SX.V for a in SX.COVER for b in SX.COVER} == set(range(SX.V))


@pytest.mark.parametrize("kw", [{}, {"hot": 1}, {"hot": 100, "hot_bucket": 1}, {"hot": 1, "hot_bucket": 1, "block": 3000}])
def test_against_brute_force(spark, kw):
    random.seed(4)
    base = ["".join(random.choice("abé ") for _ in range(random.choice([90, 120, 300]))) for _ in range(6)]
    rows = [(None, base[0]), (0, None), (1, ""), (2, "a" * 400), (3, "ab" * 200), (4, "a" * 99), (5, "b" * 100)]
    for d in range(6, 60):
        rows.append((d, "".join(random.choice([random.choice(base), random.choice(base)[random.randint(0, 50):],
                                               "".join(random.choice("abcdefgh ") for _ in range(random.randint(0, 150)))])
                                for _ in range(random.randint(0, 4)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, **kw) == sorted(brute.suffix_dedup(rows, 100), key=str)


def test_runs_of_slices_cover_every_window():
    rng = np.random.default_rng(3)
    parts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (50, 100, 700, 99, 333)]
    data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
    first, count, bucket = SX.runs_of(np.frombuffer(data, np.uint8), ends, 100)
    got = {int(f) + k for f, c in zip(first, count) for k in range(c)}
    begin = ends - [len(p) for p in parts]
    assert got == {int(b) + i for b, p in zip(begin, parts) for i in range(len(p) - 99)}
    named = {}
    for f, c, b in zip(first, count, bucket):  # equal windows share a bucket
        for k in range(c):
            assert named.setdefault(data[f + k:f + k + 100], b) == b


def test_edges(edge, empty):
    got = run(edge)
    once = [x for k, x in enumerate(EDGE) if x not in EDGE[:k] and x[0] != 3]
    expected = brute.suffix_dedup(once, 100)
    assert {r for r in got if r[0] != 3} == set(expected) and len(got) == len(EDGE)
    assert run(empty) == []
