import json

from pyspark.sql import functions as F

from reviewlake.sources import pages as PG

SCRIPT = '<html><body><script type="application/json" id="__NEXT_DATA__">{}</script></body></html>'


def page(reviews):
    return SCRIPT.format(json.dumps({"props": {"pageProps": {"reviews": reviews}}}))


def test_parse_payload_cases(spark):
    full = {"id": "r/abc1", "title": "Late again", "text": "Order came late.", "rating": 1,
            "labels": {"verification": {"isVerified": False}},
            "dates": {"publishedDate": "2024-02-01T10:00:00.000Z"}}
    bare = {"id": "", "rating": 5, "labels": {"verification": {"isVerified": True}}, "dates": {}}
    null_title = {"id": "x/y/", "title": None, "text": "t", "rating": None,
                  "labels": {"verification": {}}, "dates": {"publishedDate": None}}
    bad_rating = {"id": "q", "title": "a", "text": "b", "rating": "x",
                  "labels": {"verification": {"isVerified": True}}, "dates": {"publishedDate": "p"}}
    no_dates = {"id": "nd", "labels": {"verification": {"isVerified": True}}}
    no_verif = {"id": "nv", "labels": {}, "dates": {}}
    rows = [("c", 1, page([full, bare, null_title, bad_rating, no_dates, no_verif])),
            ("c", 2, page([])),
            ("c", 3, SCRIPT.format("{not json")),
            ("c", 4, "<html>no script</html>")]
    df = spark.createDataFrame(rows, "company string, page int, html string")
    reviews, rejects = PG.parse_reviews(df, ["company", "page"])
    got = {r.pos: r for r in reviews.collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0].id == "abc1" and got[0].rating_raw == "1" and got[0].verified is False
    assert got[0].published == "2024-02-01T10:00:00.000Z"
    assert len(got[1].id) == 64  # empty id -> deterministic content hash
    assert (got[1].title, got[1].body, got[1].published) == (
        "No Title", "No Review Body", "2000-01-24T14:37:07.000Z")
    assert got[1].verified is True
    # explicit nulls take the defaults too; id ending in '/' falls back to the hash
    assert got[2].title == "No Title" and got[2].rating_raw == "unknown" and len(got[2].id) == 64
    assert got[2].verified is False
    assert got[3].rating_raw == "x"
    rej = sorted((r.pos, r.reason) for r in rejects.collect())
    assert rej == [(4, "missing dates"), (5, "missing labels.verification")]


def test_extract_next_data_attribute_order(spark):
    html = '<script id="__NEXT_DATA__" type="application/json">{"a":1}</script>'
    other = '<script type="text/javascript">var x</script><script type="application/json" id="__NEXT_DATA__">{"b":2}</script>'
    df = spark.createDataFrame([(html,), (other,), ("<p>none</p>",)], "h string")
    assert [r[0] for r in df.select(PG.extract_next_data("h")).collect()] == ['{"a":1}', '{"b":2}', None]


def test_take_while_gap_bad_and_limit(spark):
    rows = [("a", p, True) for p in (1, 2, 4)]                      # gap at 3
    rows += [("b", p, p != 3) for p in (1, 2, 3, 4)]                # bad at 3
    rows += [("c", p, True) for p in range(1, 102)]                 # stops at 100
    rows += [("d", p, True) for p in (2, 3)]                        # page 1 missing
    df = spark.createDataFrame(rows, "company string, page int, ok boolean")
    kept = PG.take_while_pages(df, ~F.col("ok"))
    got = {}
    for r in kept.collect():
        got.setdefault(r.company, []).append(r.page)
    assert sorted(got["a"]) == [1, 2]
    assert sorted(got["b"]) == [1, 2]
    assert sorted(got["c"]) == list(range(1, 100))
    assert "d" not in got


def test_dedupe_captures(spark):
    rows = [("a", 1, "old", 1), ("a", 1, "new", 2), ("a", 2, "x", 1)]
    df = spark.createDataFrame(rows, "company string, page int, html string, captured int")
    out = {(r.company, r.page): r.html for r in PG.dedupe_captures(df, prefer="captured").collect()}
    assert out == {("a", 1): "new", ("a", 2): "x"}


def test_old_rating_default(spark):
    html = page([{"id": "a", "labels": {"verification": {}}, "dates": {}}])
    df = spark.createDataFrame([("c", 1, html)], "company string, page int, html string")
    from reviewlake.functions import text as T
    reviews, _ = PG.parse_reviews(df, ["company", "page"], rating_default=T.DEFAULT_RATING_OLD)
    assert reviews.first().rating_raw == "No Rating"


def test_a_failed_newer_capture_does_not_win(spark):
    rows = [("a", 1, 200, 1, "ok"), ("a", 1, 503, 2, "down"), ("b", 1, 200, 5, "x"), ("b", 1, 200, 5, "y")]
    df = spark.createDataFrame(rows, "company string, page int, status int, captured int, html string")
    prefer = [F.col("status") == 200, "captured"]
    out = {r.company: r.html for r in PG.dedupe_captures(df, prefer=prefer).collect()}
    again = {r.company: r.html for r in PG.dedupe_captures(df.orderBy(F.desc("html")), prefer=prefer).collect()}
    assert out["a"] == "ok" and out == again  # ties do not depend on the order of rows
    kept = PG.take_while_pages(PG.dedupe_captures(df, prefer=prefer), F.col("status") != 200)
    assert {r.company for r in kept.collect()} == {"a", "b"}
