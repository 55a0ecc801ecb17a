import math
import random
import string
import zlib
from collections import Counter

import pytest
from reviewlake.llm import toxicity as TX


def corpus(n=900):
    random.seed(5)
    clean = ["river", "garden", "letter", "window", "market", "summer", "paper", "teacher", "music", "bridge"]
    rude = ["idiot", "moron", "worthless", "pathetic"]
    docs, labels = [], []
    for d in range(n):
        w = [random.choice(clean) for _ in range(random.randint(20, 60))]
        toxic = d % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(random.randrange(len(w)), random.choice(["you ", ""]) + random.choice(rude + ["id1ot"]))
        docs.append((d, " ".join(w)))
        if d % 2 == 0 or toxic:
            labels.append((d, int(toxic)))
    return docs, labels


def test_finds_toxic_rows_that_it_has_not_seen(spark):
    docs, labels = corpus()
    out = TX.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    unseen = [r for r in out if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in unseen)
    assert right >= 0.97 * len(unseen)


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    one, two = (sorted((r.doc_id, r.score) for r in TX.toxicity(df, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
                for x in (labels, flipped))
    assert one == two


def test_obfuscated_spelling_meets_its_word():
    assert TX.stems("id1ot") == (["idiot$", "idio", "idiot"], True)
    assert TX.stems("plain,") == (["plain$", "plai", "plain"], False)
    assert TX.stems("12.50") == ([], False)


def test_kinds_count_the_strong_words_of_the_whole_text():
    lexicon = {"idiot$": 3.0, "moron$": 3.0}
    words = ["idiot"] * 10_050 + ["moron"] * 50
    kinds = TX.features(" ".join(words), lexicon, {})[TX.FEATURES.index("kinds")]
    assert kinds == 2 / len(words) ** 0.5


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert TX.toxicity(edge, labels).count() == edge.count()  # too few labels: the share of toxic rows
    assert TX.toxicity(empty, labels).count() == 0 and TX.toxicity(edge, labels.where("false")).count() == edge.count()
    assert TX.features("", {}, {}) == [0.0] * len(TX.FEATURES)


def plain_features(text, lexicon):
    """The features word by word and character by character."""
    words = text.lower().split()
    if not words:
        return [0.0] * len(TX.FEATURES)
    read = [TX.stems(w) for w in words]
    weight = [int(max((lexicon.get(g, 0.0) for g in found), default=0.0) * 1000) / 1000 for found, _ in read]
    odd = [o for _, o in read]
    you = [w.strip(string.punctuation + string.digits) in TX.SECOND_PERSON for w in words]
    strong = [k for k, w in enumerate(weight) if w >= 2.5]
    near = [any(you[max(0, k - 5):k + 6]) for k in strong]
    upper, lower = (sum(c in letters for c in text) for letters in (string.ascii_uppercase, string.ascii_lowercase))
    n, size = len(words), len(text.encode())
    return [sum(w > 0 for w in weight) / n, len(strong) / n, sum(weight) / n, max(weight), len({words[k] for k in strong}) / math.sqrt(n),
            math.log(1 + len(strong)), sum(near) / len(near) if near else 0.0, sum(you) / n, upper / max(1, upper + lower), float(upper > lower),
            text.count("!") / size, sum(c in string.punctuation for c in text) / size, sum(odd) / n,
            sum(o and w > 0 for o, w in zip(odd, weight)) / n, size / n, math.log(1 + n)]


def test_features_against_a_plain_version():
    random.seed(11)
    lexicon = {"idiot$": 3.1234567, "idio": 1.7, "moro": 2.5, "worth": 2.4999, "pathet": 4.0}
    parts = ["you", "You,", "TU", "idiot", "Id1ot!", "MORONS", "worthless", "p4thetic.", "river", "éclair", "世界", "12.50", "--", "a!b", "usted", "x_y"]
    memo = {}
    for _ in range(300):
        text = random.choice(["", " ", "\n"]).join(
            random.choice(parts) + random.choice([" ", "  ", "\n", "\t"]) for _ in range(random.choice([0, 1, 3, 12, 60, 400])))
        assert TX.features(text, lexicon, memo) == pytest.approx(plain_features(text, lexicon), abs=1e-12)


def test_lexicon_weights_against_a_plain_count(spark):
    docs, labels = corpus(200)
    toxic = dict(labels)
    rows = [(toxic[d], t) for d, t in docs if d in toxic]
    seen = [Counter(), Counter()]
    for y, t in rows:
        seen[y].update({g for w in set(t.lower().split()) for g in TX.stems(w)[0]})
    n = [sum(y == k for y, _ in rows) for k in (0, 1)]
    weight = {g: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][g] + 0.5) / (n[0] + 1)) for g, c in seen[1].items() if c >= 3}
    expected = {g: w for g, w in weight.items() if w >= 1.5}
    got = TX._learn_lexicon(spark.createDataFrame(rows, "toxic int, t string"), n[1], n[0], 6_000)
    assert got == pytest.approx(expected) and expected
    few = sorted(expected, key=lambda g: (-expected[g] * math.sqrt(seen[1][g]), g))[:3]
    assert list(TX._learn_lexicon(spark.createDataFrame(rows, "toxic int, t string"), n[1], n[0], 3)) == few
