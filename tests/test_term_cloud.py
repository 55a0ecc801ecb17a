import math
import random
from collections import Counter

from reviewlake import dictionaries as D
from reviewlake.operators import terms as TM

STOP = {w for (w,) in D.STOPWORDS_EN.rows}


def ratio(c12, c1, c2, n):
    if n <= c1 or n <= c2:
        return 0.0

    def fit(k, m, p):
        return math.log(max(p, 1e-10)) * k + math.log(max(1 - p, 1e-10)) * (m - k)
    p = c2 / n
    return -2 * (fit(c12, c1, p) + fit(c2 - c12, n - c1, p) - fit(c12, c1, c12 / c1) - fit(c2 - c12, n - c1, (c2 - c12) / (n - c1)))


def plain(texts, k, threshold=30.0):
    toks = [t.lower().split() for t in texts if t]
    one = Counter(w for ws in toks for w in ws if w not in STOP)
    form = {w: w[:-1] if w.endswith("s") and not w.endswith("ss") and w[:-1] in one else w for w in one}
    n1 = Counter()
    for w, n in one.items():
        n1[form[w]] += n
    n2 = Counter((form[a], form[b]) for ws in toks for a, b in zip(ws, ws[1:]) if a in form and b in form)
    total, out = sum(n1.values()), Counter(n1)
    for (a, b), n in n2.items():
        if ratio(n, n1[a], n1[b], total) > threshold:
            out[a] -= n
            out[b] -= n
            out[f"{a} {b}"] = n
    return sorted(((w, n) for w, n in out.items() if n > 0), key=lambda x: (-x[1], x[0]))[:k]


def test_against_plain_counts(spark):
    rng = random.Random(4)
    vocab = ["store", "stores", "glass", "queue", "staff", "the", "of", "price", "prices", "milk", "rare"]
    texts = [" ".join(rng.choice(["customer service", "self checkout", "the queue", *vocab]) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(t,) for t in [*texts, None, "", "customer customer customers"]]
    df = spark.createDataFrame(rows, "body string")
    want = plain([t for (t,) in rows], 40)
    assert {"customer service", "self checkout"} <= {w for w, _ in want} and "customer" not in [w for w, _ in want][:3]
    assert [tuple(r) for r in TM.term_cloud(spark, df, "body", 40).collect()] == want
    assert TM.term_cloud(spark, df.where("false"), "body").collect() == []
    # no threshold passes: plain term counts
    assert dict(map(tuple, TM.term_cloud(spark, df, "body", 999, threshold=1e12).collect())) == dict(plain([t for (t,) in rows], 999, 1e12))


def test_pairs_are_counted_before_the_shuffle(spark):
    df = spark.createDataFrame([("a b",)], "body string")
    pairs = df.selectExpr("'a' w1", "'b' w2", "1L frequency")
    plan = TM.collocations(pairs, df.selectExpr("'a' term", "1L frequency"))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def test_stop_words_go_before_counting(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(TM, "stored", lambda df, name, keep=TM.stored: plans.setdefault(name, df._jdf.queryExecution().toString()) and keep(df, name))
    df = spark.createDataFrame([("the van and the vans of the road van road",)] * 3 + [(None,)], "t string")
    got = {r.term: r.frequency for r in TM.term_cloud(spark, df, "t", threshold=1e9).collect()}
    assert got == {"van": 9, "road": 6} and "Join" not in plans["cloud"]
    # a list that does not fit the plan is joined afterwards, with the same result
    monkeypatch.setattr(TM, "MAX_LITERAL_STOPWORDS", 0)
    assert {r.term: r.frequency for r in TM.term_cloud(spark, df, "t", threshold=1e9).collect()} == got
