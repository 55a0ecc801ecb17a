import math
import random
import re

import numpy as np
import pytest

from reviewlake import dictionaries as D
from reviewlake.operators import summaries as SM

STOP = {w for (w,) in D.STOPWORDS_EN.rows}
SCHEMA = "question_id long, batch_id long, answer string"


def words(t):
    return set(re.findall(r"[a-z0-9]+", t.lower())) - STOP


def plain_pick(items, n):
    """items: (pos, sentence, weight) in order; the same ranking with plain loops."""
    k = len(items)
    ts, w = [words(s) for _, s, _ in items], [x[2] for x in items]
    s = [[0.0 if i == j or not ts[i] or not ts[j] else round(len(ts[i] & ts[j]) / math.sqrt(len(ts[i]) * len(ts[j])), 9) for j in range(k)] for i in range(k)]
    s = [[x if x >= SM.LEAST else 0.0 for x in row] for row in s]
    p = [x / sum(w) for x in w]
    r = p
    for _ in range(SM.STEPS):
        new = [(1 - SM.DAMPING) * p[i] for i in range(k)]
        for j in range(k):
            out = sum(s[j][i] * w[i] for i in range(k))
            for i in range(k):
                new[i] += SM.DAMPING * r[j] * (s[j][i] * w[i] / out if out else p[i])
        r = new
    r = [round(x / max(r), 6) for x in r]
    got = []
    while len(got) < min(n, k):
        v = [(-round(SM.BALANCE * r[i] - (1 - SM.BALANCE) * max([s[i][j] for j in got], default=0), 6), i) for i in range(k) if i not in got]
        got.append(min(v)[1])
    return [items[i] for i in sorted(got)]


def plain(rows, block, keep, length):
    out, most = {}, max([b // block for _, b, a in rows if a is not None], default=0)
    for q in {r[0] for r in rows}:
        once = {}
        for _, b, a in sorted((r for r in rows if r[0] == q and r[2] is not None), key=lambda r: r[1]):
            pos, n = once.get(a, (b, 0))
            once[a] = (pos, n + 1)
        level = {}
        for a, (pos, n) in sorted(once.items(), key=lambda x: x[1]):
            level.setdefault(pos // block, []).append((pos, a, n))
        last = most
        while last:
            up = {}
            for b in sorted(level):
                up.setdefault(b // max(2, block // keep), []).extend(plain_pick(level[b], keep))
            level, last = up, last // max(2, block // keep)
        got = [x for b in sorted(level) for x in plain_pick(level[b], length)]
        mine = [r for r in rows if r[0] == q]
        out[q] = (" ".join(s for _, s, _ in got), len(mine), sum(r[2] is not None for r in mine))
    return out


def made(n, seed=1):
    rng, vocab = random.Random(seed), [f"w{i}" for i in range(25)]
    rows = [(q, b, None if rng.random() < 0.1 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 7))) + ".") for q in (3, 9) for b in range(n)]
    rows += [(5, 0, None), (7, 0, ""), (7, 1, "the the"), (7, 2, "!!!")]
    return rows + [(11, b, "one answer for all") for b in range(n)]


@pytest.mark.parametrize("n, block, keep, length", [(40, 64, 8, 5), (150, 8, 2, 3), (70, 6, 4, 2)])
def test_against_plain_loops(spark, n, block, keep, length):
    rows = made(n)
    got = {r[0]: tuple(r[1:]) for r in SM.summarise(spark.createDataFrame(rows, SCHEMA), block=block, keep=keep, length=length).collect()}
    assert got == plain(rows, block, keep, length)
    for q, (summary, _, _) in got.items():
        assert len(summary) <= sum(len(a) + 1 for x, _, a in rows if x == q and a)
    assert got[11][0] == "one answer for all" and got[5] == ("", 1, 0)


def test_no_level_gets_more_than_a_block(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    keep = SM._pick_rows

    def counted(n):
        run = keep(n)

        def check(group):
            assert len(group) <= 16
            sizes.add(1)
            return run(group)
        return check
    monkeypatch.setattr(SM, "_pick_rows", counted)
    rows = [(1, b, f"answer number {b} about {b % 7}") for b in range(600)]
    out = SM.summarise(spark.createDataFrame(rows, SCHEMA), block=16, keep=4, length=4).collect()
    assert out[0].n_answered == 600 and sizes.value > 600 / 16


def test_likeness_keeps_repeats_out():
    terms = [{"a", "b", "c"}, {"a", "b", "c", "d"}, {"a", "b", "e"}, {"x", "y"}, {"x", "z"}]
    s = SM.links(terms)
    assert 3 in SM.picks(s, SM.ranks(s, np.ones(5)), 2) or 4 in SM.picks(s, SM.ranks(s, np.ones(5)), 2)
    assert SM.links([set(), set()]).tolist() == [[0, 0], [0, 0]]


def test_model_path_sees_blocks_only(spark):
    rows = [(q, b, None if b % 10 == 3 else f"a{b}") for q in (0, 2000) for b in range(150)]
    answers = spark.createDataFrame(rows, SCHEMA)

    def factory():
        return lambda texts: [f"<{len(t.split())}>" for t in texts]
    out = SM.summarise(answers, block=50, scorer_factory=factory).collect()
    assert {(r.summary, r.n_batches, r.n_answered) for r in out} == {("<3>", 150, 135)}
    deep = SM.summarise(answers, block=5, scorer_factory=factory).collect()  # 30 texts, 6, 2, 1
    assert {r.summary for r in deep} == {"<2>"}


def test_empty_table(spark):
    assert SM.summarise(spark.createDataFrame([], SCHEMA)).collect() == []
