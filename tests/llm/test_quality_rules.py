import random
from collections import Counter

import brute
from conftest import EDGE

from reviewlake.llm import quality_rules as QR


def counts(t):
    t = t or ""
    w = brute.words(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    many = Counter(grams)
    covered = {p for i, g in enumerate(grams) if many[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in t.split("\n") if brute.words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_against_brute_force(spark):
    random.seed(3)
    parts = ["the", "cat", "sat", "on", "mat", "\n", "\t", "#x", "|", "a <b>", "é世", "!!", "the cat sat on the mat", "\x0b", " "]
    texts = [" ".join(random.choice(parts) for _ in range(random.randint(0, 80))) for _ in range(150)] + ["a b c d e " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = QR.quality_rules(df).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_verdict_keeps_prose_and_drops_junk(spark):
    prose = "The river ran past the old mill and on to the sea. Nobody in the village could say when it was built, or by whom."
    rows = [(0, prose), (1, " | ".join(prose.split())), (2, prose.upper().replace(" ", "!! ")), (3, " ".join(w + "%%%" for w in prose.split()))]
    kept = {r.doc_id: r.kept for r in QR.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}


def test_edges(edge, empty):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words) for r in QR.quality_rules(edge).collect())
    assert got == sorted((d is not None, d or 0, len(brute.words(t))) for d, t in EDGE)
    assert QR.quality_rules(empty).count() == 0


def test_one_projection_without_python_or_shuffle(edge):
    plan = QR.quality_rules(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
