import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewlake.operators import misspelt as MS


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def variants(w, d):
    out = {w}
    for _ in range(d):
        out |= {x[:i] + x[i + 1:] for x in out for i in range(len(x))}
    return out


@given(st.text("abcé", max_size=7), st.text("abcé", max_size=7))
@settings(max_examples=300, deadline=None)
def test_near_strings_share_a_variant(a, b):
    if distance(a, b) <= 2:
        assert variants(a, 2) & variants(b, 2)


@pytest.mark.parametrize("d", [0, 1, 2])
def test_all_pairs_within_the_distance(spark, d):
    rng = random.Random(d)
    words = {"".join(rng.choice("abeé") for _ in range(rng.randint(1, 8))) for _ in range(300)} | {"x" * 400, ""}
    terms = rng.sample(sorted(words), 40) + ["abcdefg", "ABBA", "", None, "abba"]
    w = spark.createDataFrame([(x, len(x) + 1) for x in words], "word string, n long")
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    got = {(r.term, r.word): (r.n, r.distance) for r in MS.near_terms(w, t, d).collect()}
    named = {x.lower() for x in terms if x and len(x) < 100}
    assert {k: v for k, v in got.items() if len(k[0]) < 100} == {
        (a, b): (len(b) + 1, distance(a, b)) for a in named for b in words if abs(len(a) - len(b)) <= d and distance(a, b) <= d}


def test_variants_of_a_word(spark):
    got = spark.range(1).select(F.size(MS.deletions(F.lit("abcd"), 2)), F.size(MS.deletions(F.lit(""), 2))).first()
    assert tuple(got) == (len(variants("abcd", 2)), 1)


def test_tolerant_mentions(spark):
    docs = spark.createDataFrame([("Asda and azda, asdaa; Tesco tesko asda",), (None,), ("",)], "body string")
    terms = spark.createDataFrame([("Asda",), ("Tesco",), ("Lidl",)], "term string")
    assert sorted(map(tuple, MS.tolerant_mentions(docs, "body", terms).collect())) == [("asda", 2, 3), ("tesco", 1, 1)]  # and, azda, asdaa
    assert MS.tolerant_mentions(docs, "body", terms.where("false")).collect() == []
    assert MS.tolerant_mentions(docs.where("false"), "body", terms).collect() == []
