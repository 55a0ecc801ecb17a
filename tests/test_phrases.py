import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from reviewlake.operators import phrases as PH


def plain(texts, phrases):
    known = {" ".join(re.findall(r"[a-z0-9]{2,}", p.lower())) for p in phrases if p}
    out = Counter()
    for k, t in enumerate(texts):
        w = re.findall(r"[a-z0-9]{2,}", (t or "").lower())
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 9) + 1):
                if " ".join(w[i:j]) in known:
                    out[(k, " ".join(w[i:j]))] += 1
    return dict(out)


def made(seed):
    rng, vocab = random.Random(seed), ["aa", "bb", "cc", "dd", "ee", "ff1"]
    phrases = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 4))) for _ in range(60)] + ["AA  bb", None, "", "!!", "zz unknown", "aa bb cc dd ee aa bb cc"]
    texts = [rng.choice([" ", ", "]).join(rng.choice([*vocab, "x", "aa bb cc dd ee aa bb cc"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    return phrases, texts + [None, "", "aa" * 500, "aa " * 5000, texts[0]]


@pytest.mark.parametrize("max_words", [PH.MAX_WORDS, 40])
def test_against_plain_search(spark, max_words):
    phrases, texts = made(1)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, body string, phrase string").repartition(3)
    table = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    got = {(r.id, r.phrase): r.n for r in PH.phrase_hits(docs, ["id"], "body", table, max_words=max_words).collect()}
    assert got == plain(texts, phrases)
    counts = {r.phrase: (r.n_docs, r.n_mentions) for r in PH.phrase_counts(docs, "body", table, max_words=max_words).collect()}
    assert counts["aa"] == (sum(p == "aa" for _, p in got), sum(n for (_, p), n in got.items() if p == "aa"))


def test_empty_dictionary_and_table(spark):
    docs = spark.createDataFrame([(1, "aa bb")], "id long, body string")
    none = spark.createDataFrame([], "phrase string")
    assert PH.phrase_hits(docs, ["id"], "body", none).collect() == []
    assert PH.phrase_hits(docs.where("false"), ["id"], "body", spark.createDataFrame([("aa",)], "phrase string")).collect() == []


def test_a_million_phrases_in_one_automaton():
    rng = np.random.default_rng(2)
    pick = rng.integers(0, 3000, size=(1_000_000, 3))
    phrases = [[f"w{a}", f"w{b}", f"w{c}"][:2 + (a + b) % 2] for a, b, c in pick.tolist()]
    phrases = [p.split(" ") for p in dict.fromkeys(" ".join(p) for p in phrases)]
    start = time.time()
    a = PH.Automaton(phrases, np.arange(len(phrases)))
    assert len(phrases) > 800_000 and time.time() - start < 120
    text = [w for p in phrases[:2000] for w in p]
    place, found = a.occurrences(a.numbers(np.array([PH.word_hash(w) for w in text], np.uint64)), np.array([0]))
    known = {" ".join(p): i for i, p in enumerate(phrases)}
    want = sorted((j - 1, known[g]) for j in range(2, len(text) + 1) for n in (2, 3) if j >= n for g in [" ".join(text[j - n:j])] if g in known)
    assert sorted(zip(place.tolist(), found.tolist())) == want
