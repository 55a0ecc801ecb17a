import itertools
import random
import re

import numpy as np
import pytest

from reviewlake.functions import masking as M
from reviewlake.operators import entities as EN
from reviewlake.operators import tagging as TG

KNOWN = {"PERSON": ["Anna Berg", "Tom", "Maria Lopez", "Peter", "Julia Stone", "Karl", "Emma", "Victor Hall"],
         "GPE": ["Leeds", "York", "Hamburg", "Porto", "New Haven", "Lyon", "Bristol", "Ghent"]}
UNSEEN = {"PERSON": ["Olga Petrov", "Hugo", "Nadia Frost", "Ines", "Walter Quist", "Amir"],
          "GPE": ["Dresden", "Oslo", "Port Ellen", "Malaga", "Utrecht"]}
FRAMES = ["I spoke to {P} at the {G} store.", "Many thanks to {P} who helped me in {G}.", "We drove from {G} to {G} and nobody called back.",
          "The manager {P} said that the parcel was in {G}.", "Delivery from {G} took 5 days!", "My driver was {P}, very polite.",
          "Ask for {P} when you are in {G}.", "The Food was cold and the Staff rude.", "Great Prices, I will come back on Monday.",
          "Order 12345 never came, Customer Service did not reply."]


def text(rng, names):
    out, spans, at = "", [], 0
    for frame in rng.sample(FRAMES, 3):
        for part in frame.replace("{", "|{").replace("}", "}|").split("|"):
            label = {"{P}": "PERSON", "{G}": "GPE"}.get(part)
            piece = rng.choice(names[label]) if label else part
            if label:
                spans.append((len(out), len(out) + len(piece), label))
            out += piece
        out += " "
    return out, spans


def gazetteer():
    return EN.D.Dictionary("t", "label string, term string", tuple((k, n.lower()) for k, ns in KNOWN.items() for n in ns))


@pytest.fixture(scope="module")
def weights(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, KNOWN)[0]) for i in range(400)] + [(900, None), (901, "")]
    return TG.fit_tagger(spark.createDataFrame(rows, "id int, body string").repartition(4), "body", gazetteer())


def f1(found, gold):
    hit = sum(len(set(a) & set(b)) for a, b in zip(found, gold))
    return 2 * hit / max(1, sum(map(len, found)) + sum(map(len, gold)))


def test_unseen_names_beat_the_rules(weights):
    rng = random.Random(2)
    made = [text(rng, UNSEEN) for _ in range(150)]
    rules, index = [], EN._gazetteer_index(gazetteer())
    by_rules = f1([EN.find_spans(t, rules, index) for t, _ in made], [s for _, s in made])
    tagger = TG.Tagger.load(weights)
    by_tagger = f1([tagger.spans(t) for t, _ in made], [s for _, s in made])
    assert by_tagger > 0.9 > by_rules + 0.5


def test_masking_uses_it(spark, weights):
    df = spark.createDataFrame([(1, "Many thanks to Nadia Frost who helped me in Oslo. Mail a@b.org"), (2, None), (3, ""), (4, "The Food was cold.")], "id int, body string")
    got = {r.id: r.m for r in df.select("id", TG.mask_names(df, "body", weights, gazetteer()).alias("m")).collect()}
    assert got == {1: "Many thanks to [PERSON] who helped me in [LOCATION]. Mail [EMAIL]", 2: None, 3: "", 4: "The Food was cold."}


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        s, follow = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        value = lambda p: sum(s[i, t] for i, t in enumerate(p)) + sum(follow[a, b] for a, b in zip(p, p[1:]))  # noqa: B023,E731
        assert tuple(TG.viterbi(s, follow)) == max(itertools.product(range(3), repeat=n), key=value)


def test_many_sentences_at_once_are_tagged_as_one_by_one(weights):
    tagger, rng = TG.Tagger.load(weights), random.Random(6)
    sentences = [[rng.choice(["Tom", "York", "the", "<", "Berg", "to", "é世", "Thanks"]) for _ in range(rng.choice([1, 2, 3, 30]))] for _ in range(700)]
    assert tagger.tag_many(sentences).tolist() == [t for s in sentences for t in tagger.tag(s)]


def test_average_is_that_of_all_steps():
    words, gold = ["to", "Anna", "Berg"], [0, 1, 2]
    plain, total, steps = TG.Tagger(["PERSON"]), 0, 0
    for k in range(3):
        rows = plain.read.rows(words, {1, 2} if k % 2 == 0 else ())
        s = plain.scores(rows)
        s[0] += plain.start
        guess = TG.viterbi(s, plain.follow + plain.banned)
        for j in range(3):
            if guess[j] != gold[j]:
                for r in rows[j]:
                    plain.weights[r, gold[j]] += 1
                    plain.weights[r, guess[j]] -= 1
            if j and (guess[j], guess[j - 1]) != (gold[j], gold[j - 1]):
                plain.follow[gold[j - 1], gold[j]] += 1
                plain.follow[guess[j - 1], guess[j]] -= 1
        total, steps = total + plain.weights, steps + 1
    made = TG.Tagger(["PERSON"]).fit([(words, gold)], passes=3)
    assert np.allclose(made.weights, (total + 0 * plain.weights) / (steps + 1))


def test_no_inside_without_a_beginning_and_spans_do_not_overlap(weights):
    tagger, rng = TG.Tagger.load(weights), random.Random(8)
    words = ["Tom", "York", "the", "in", "Xyz", "12", ",", "thanks", "to", "é世"]
    for _ in range(100):
        w = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        tags = [tagger.tags[t] for t in tagger.tag(w)]
        for a, b in zip(["O", *tags], tags):
            assert not b.startswith("I-") or a[2:] == b[2:]
        t = " ".join(w)
        spans = TG.with_names(EN.find_spans(t, [(x, re.compile(p)) for x, p in M.DETECTORS], EN._gazetteer_index(gazetteer())), tagger.spans(t))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_without_texts_or_names_nothing_is_tagged(spark):
    empty = spark.createDataFrame([], "body string")
    assert TG.Tagger.load(TG.fit_tagger(empty, "body")).spans("Tom is in York.") == []
    assert TG.Tagger.load(TG.fit_tagger(empty.sparkSession.createDataFrame([("no names",)], "body string"), "body")).spans("Tom.") == []


def test_ingest_takes_a_detector(spark, weights):
    import json

    from reviewlake.plans.ingest import ingest_pages
    review = {"id": "1", "title": "Thanks", "text": "Many thanks to Nadia Frost who helped me in Oslo.", "rating": 5,
              "dates": {"publishedDate": "2024-01-02T00:00:00.000Z"}, "labels": {"verification": {"isVerified": True}}}
    html = '<script type="application/json" id="__NEXT_DATA__">%s</script>' % json.dumps({"props": {"pageProps": {"reviews": [review]}}})
    pages = spark.createDataFrame([("c", 1, html)], "company string, page int, html string")
    plain = ingest_pages(spark, pages, gazetteer=gazetteer())[0].first().body
    tagged = ingest_pages(spark, pages, detector=TG.make_tagging_detector(spark, weights, gazetteer()))[0].first().body
    assert "Nadia" in plain and tagged == "Many thanks to [PERSON] who helped me in [LOCATION]."


def test_texts_are_tagged_in_blocks_with_the_same_spans(weights, monkeypatch):
    tagger = TG.Tagger.load(weights)
    texts = ["Ask Anna Berg in Oslo. It was late! Then Tom Hill came.\nGood", "", "no names here. At Paris again"] * 40
    whole, sizes = tagger.spans_of(texts, 10**9), []
    plain = TG.Tagger.tag_many
    monkeypatch.setattr(TG.Tagger, "tag_many", lambda self, sentences: sizes.append(sum(map(len, sentences))) or plain(self, sentences))
    monkeypatch.setattr(TG, "MEMO", 5)  # words are forgotten and learnt again
    assert tagger.spans_of(texts, 50) == whole and len(sizes) > 5 and max(sizes) < 70
    one = " ".join(texts)
    assert tagger.spans_of([one], 50) == tagger.spans_of([one], 10**9)
