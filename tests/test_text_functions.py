from pyspark.sql import functions as F

from reviewlake.functions import text as T


def _one(spark, expr, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(expr(F.col("v")).alias("o")).first()["o"]


def test_guarded_double(spark):
    assert _one(spark, T.guarded_double, " 3 ") == 3.0
    assert _one(spark, T.guarded_double, "2.5e1") == 25.0
    for bad in ["4d", "1_0", "nan", "inf", "unknown", "", None]:
        assert _one(spark, T.guarded_double, bad) is None, bad


def test_strict_double_raises_under_ansi(spark):
    import pytest
    df = spark.createDataFrame([("x",)], "v string").select(T.strict_double("v"))
    with pytest.raises(Exception):
        df.collect()


def test_url_last_segment_and_review_id(spark):
    assert _one(spark, T.url_last_segment, "r/abc1") == "abc1"
    assert _one(spark, T.url_last_segment, "plain") == "plain"
    assert _one(spark, T.url_last_segment, "") is None
    assert _one(spark, T.url_last_segment, "ends/") is None
    assert _one(spark, T.url_last_segment, None) is None
    df = spark.createDataFrame([("", "t", "b"), (None, "t", "b"), ("x/y", "t", "b")], "id string, t string, b string")
    ids = [r[0] for r in df.select(T.review_id("id", "t", "b")).collect()]
    assert ids[0] == ids[1] and len(ids[0]) == 64  # content hash, stable
    assert ids[2] == "y"


def test_normalise_label_and_off_list(spark):
    df = spark.createDataFrame([(" Positive\n",), ("ERROR",), ("",), (None,), ("weird",)], "v string")
    out = df.select(T.normalise_label("v").alias("l")).select(
        "l", T.off_list(F.col("l"), ["positive", "negative", "neutral"]).alias("off")).collect()
    assert [r.l for r in out] == ["positive", "unknown", "unknown", "unknown", "weird"]
    assert [r.off for r in out] == [False, False, False, False, True]


def test_age_band_edges(spark):
    df = spark.createDataFrame([(17,), (18,), (34,), (35,), (59,), (60,), (None,)], "v int")
    assert [r[0] for r in df.select(T.age_band("v")).collect()] == [
        None, "18-35", "18-35", "35-60", "35-60", "60+", None]


def test_page_from_url_and_title(spark):
    assert _one(spark, T.page_from_url, "https://x/r?page=12&a=1") == 12
    assert _one(spark, T.page_from_url, "https://x/r?a=1&page=3") == 3
    assert _one(spark, T.page_from_url, "https://x/r") is None
    assert _one(spark, T.html_title, "<html><TITLE x=1>Hi\nthere</title>") == "Hi\nthere"


def test_discrepancy_cases(spark):
    rows = [("1", "1.250"), ("5", "unknown"), ("unknown", "3.000"), (None, "3.000")]
    df = spark.createDataFrame(rows, "r string, t string")
    assert [x[0] for x in df.select(T.discrepancy("t", "r")).collect()] == [0.25, None, None, None]


def test_tokens_unicode(spark):
    df = spark.createDataFrame([("Éé déjà-vu, l'été 42 a",)], "v string")
    assert df.select(T.tokens("v")).first()[0] == ["éé", "déjà", "vu", "l'été", "42"]


def test_normalise_label_legacy(spark):
    df = spark.createDataFrame([(" Error ",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(T.normalise_label("v", legacy=True)).collect()] == ["error", "", "unknown"]
