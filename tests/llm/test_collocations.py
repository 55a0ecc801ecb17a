import random
import re
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import EDGE

from reviewlake.llm import collocations as CO


def plain(rows, longest=3, least=10, share=50, top=2000):
    f, total = Counter(), Counter()
    for t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.ascii_lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + n])) for i in range(len(w) - n + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        held = any(len(v) > len(w) and x == lang and 100 * b >= share * a and any(v[i:i + len(w)] == w for i in range(len(v)))
                   for (x, v), b in cand.items())
        if not held:
            l, r, score = min(((f[lang, w[:k]], f[lang, w[k:]], 10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]])) for k in range(1, len(w))),
                              key=lambda x: x[2])
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, v in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(v)[:top]))


def made(n=400, seed=3):
    rng = random.Random(seed)
    vocab = ["The", "of", "new", "york", "New", "city", "É", "é", "straße", "a" * 30, "x-1"]
    out = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        text = "".join(x + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " \x0b", " "]) for x in w)
        out.append((text, rng.choice(["en", "fr", None, "und", "a.b"])))
    return out + [(None, "en"), ("", None), (" \t ", "fr"), ("...", "fr"), ("alone " * 3000, "en"), ("new york city " * 2000, "de")] + [out[0]] * 5


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    return sorted(map(tuple, CO.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_against_brute_force(spark):
    rows = made()
    want = plain(rows)
    assert len(want) > 90 and run(spark, rows) == want


@pytest.mark.parametrize("bits", [3, 9])
def test_colliding_fingerprints_are_told_apart_by_their_texts(spark, bits):
    rows = made(60, 5)
    assert run(spark, rows, bits=bits, flush=500, filter_bits=10) == plain(rows)


def test_longer_phrases_and_other_limits(spark):
    rows = made(80, 7)
    assert run(spark, rows, longest=4, least=4, share=80, top=9) == plain(rows, 4, 4, 80, 9)


def test_edges(spark, edge, empty):
    got = CO.collocations(edge.withColumn("lang", edge["line"]), least=1)
    assert sorted(r["phrase"] for r in got.collect()) == sorted(x[2] for x in plain([(t, "z") for _, t in EDGE], least=1))
    assert CO.collocations(empty.withColumn("lang", empty["line"])).collect() == []


def test_counts_past_64_bits(spark):
    found = spark.sql("select 'en' lang, n, phrase, a from values (0, '', 9000000000000L), (1, 'x', 3000000000001L), "
                      "(1, 'y', 3000000000007L), (2, 'x y', 3000000000000L) t(n, phrase, a)")
    keep, CO.frequent_phrases = CO.frequent_phrases, lambda *a, **k: found
    try:
        row = CO.collocations(found).collect()
    finally:
        CO.frequent_phrases = keep
    assert [(r["a"], r["score"]) for r in row] == [(3 * 10**12, 10**6 * 9 * 10**24 // (3000000000001 * 3000000000007))]


def test_prefix_polynomials_do_not_depend_on_place():
    wrap, prime = CO._hashers()
    for powers, kind in ((wrap, np.uint64), (prime, np.int64)):
        codes = np.frombuffer(b"abcabcabc", np.uint8).astype(kind)
        got = powers.ranges(codes, np.array([0, 3, 6, 0]), np.array([3, 6, 9, 2]))
        assert got[0] == got[1] == got[2] != got[3]
