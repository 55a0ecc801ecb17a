from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlake import dictionaries as D
from reviewlake.functions import text as T
from reviewlake.operators import lexicon as L
from reviewlake.operators import stats

LEX = D.Dictionary("lex", "term string, weight int", (("good", 1), ("bad", -1), ("great", 2)))


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "id string, company string, title string, body string")


def test_polarity_and_pct(spark):
    r = _reviews(spark, [("1", "a", "Good", "great stuff"), ("2", "a", "Bad", "bad bad good"),
                         ("3", "b", "Meh", "nothing"), ("4", "b", "", "")])
    p = L.polarity(spark, r, T.corpus_text("title", "body"), ["company", "id"], LEX)
    got = {x.id: (x.polarity, x.magnitude, x.hits) for x in p.collect()}
    assert got == {"1": (3, 3, 2), "2": (-2, 4, 4), "3": (0, 0, 0), "4": (0, 0, 0)}
    pct = L.sentiment_pct(p).first()
    assert (pct.pct_positive, pct.pct_negative, pct.total) == (25.0, 25.0, 4)
    by = {x.company: x.pct_positive for x in L.sentiment_pct(p, ["company"]).collect()}
    assert by == {"a": 50.0, "b": 0.0}


def test_pct_empty_input_is_null(spark):
    r = _reviews(spark, [])
    p = L.polarity(spark, r, T.corpus_text("title", "body"), ["id"], LEX)
    row = L.sentiment_pct(p).first()
    assert row.pct_positive is None and row.total == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.sampled_from(["good", "bad", "great", "meh"]), min_size=0, max_size=6), st.integers(1, 5))
def test_pct_bounds(spark, words, copies):
    rows = [(str(i), "c", "t", " ".join(words[: i % (len(words) + 1)])) for i in range(copies)]
    p = L.polarity(spark, _reviews(spark, rows), "body", ["id"], LEX)
    row = L.sentiment_pct(p).first()
    assert 0 <= row.pct_positive + row.pct_negative <= 100


def test_classify_topics_ties_and_unknown(spark):
    tax = D._taxonomy("t", ["x", "y"], {"x": ["apple"], "y": ["pear"]})
    r = _reviews(spark, [("1", "c", "", "apple pear"), ("2", "c", "", "pear pear apple"), ("3", "c", "", "none")])
    got = {x.id: x.topic for x in L.classify_topics(spark, r, "body", ["id"], tax).collect()}
    assert got == {"1": "x", "2": "y", "3": "unknown"}


def test_mention_counts_multiword(spark):
    ph = D.Dictionary("p", "category string, phrase string",
                      (("inflation", "cost of living"), ("comp", "aldi")))
    r = _reviews(spark, [("1", "c", "", "The cost of living, and Aldi and aldi"), ("2", "c", "", "cost living")])
    got = {x.category: (x.mentions, x.reviews_mentioning) for x in L.mention_counts(spark, r, "body", ["id"], ph).collect()}
    assert got == {"inflation": (1, 1), "comp": (2, 1)}


def test_rating_topic_freq_drops_null_keys(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "a"), (None, "a"), ("2", None)], "rating string, topic string")
    got = {(r.rating, r.topic): r.frequency for r in stats.rating_topic_freq(df).collect()}
    assert got == {("1", "a"): 2}


def test_value_counts_all(spark):
    df = spark.createDataFrame([("1", True), ("1", False), (None, True)], "rating string, verified boolean")
    got = {(r.column_name, r.value): r.frequency for r in stats.value_counts_all(df, ["rating", "verified"]).collect()}
    assert got == {("rating", "1"): 2, ("verified", "true"): 2, ("verified", "false"): 1}


def test_gather_text_order_across_blocks(spark):
    rows = [(1, t, f"w{t}") for t in range(150)][::-1]
    df = spark.createDataFrame(rows, "k int, turn int, text string")
    out = stats.gather_text(df, "k", "turn", "text", block=16).first()
    assert out.joined == " ".join(f"w{t}" for t in range(150)) and out.n_parts == 150


def test_value_counts_top_exact_and_approx(spark):
    rows = [("a", "x")] * 5 + [("b", "x")] * 3 + [("c", "y")] * 2 + [("d", "y")]
    df = spark.createDataFrame(rows, "v string, w string")
    ex = {(r.column_name, r.rank): (r.value, r.frequency) for r in stats.value_counts_top(df, ["v", "w"], k=2).collect()}
    assert ex == {("v", 1): ("a", 5), ("v", 2): ("b", 3), ("w", 1): ("x", 8), ("w", 2): ("y", 3)}
    ap = {(r.column_name, r.rank): (r.value, r.frequency)
          for r in stats.value_counts_top(df, ["v", "w"], k=2, approx=True).collect()}
    assert ap == ex  # small inputs are counted exactly by the sketch


def test_questions_table():
    t = D.questions_table()
    assert len(t) == 7 and t.rows[0][0] == 0
    assert len(D.questions_table(D.REPORT_QUESTIONS_OLD)) == 7


def test_gather_text_skips_nulls(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c")], "k int, turn int, text string")
    out = stats.gather_text(df, "k", "turn", "text").first()
    assert out.joined == "a c" and out.n_parts == 3


def test_repeated_ids_are_not_merged(spark):
    r = _reviews(spark, [("1", "a", "", "good"), ("1", "b", "", "bad"), ("1", "a", "", "good")])
    got = sorted((x.company, x.polarity) for x in L.polarity(spark, r, "body", ["id", "company"], LEX).collect())
    assert got == [("a", 1), ("a", 1), ("b", -1)]
    assert L.sentiment_pct(L.polarity(spark, r, "body", ["id"], LEX)).first().total == 3


def test_dictionaries_may_be_tables(spark):
    lex = spark.createDataFrame([("good", 2), ("good", 1), ("bad", -1)], "term string, weight int")
    tax = spark.createDataFrame([("x", 0, "apple", 1), ("y", 1, "pear", 2)], "topic string, topic_order int, keyword string, weight int")
    r = _reviews(spark, [("1", "c", "", "good bad apple pear"), ("2", "c", "", None)])
    out = {x.id: (x.polarity, x.magnitude, x.hits, x.topic) for x in L.with_scores(r, "body", lex, tax).collect()}
    assert out == {"1": (2, 4, 3, "y"), "2": (0, 0, 0, "unknown")}


def test_a_table_beyond_the_bound_is_refused(spark, monkeypatch):
    import pytest
    monkeypatch.setattr(D, "MAX_DICTIONARY_ROWS", 2)
    with pytest.raises(ValueError):
        D.as_dictionary(spark.range(3))
