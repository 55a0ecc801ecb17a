import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reviewlake.operators import dedupe as DD
from reviewlake.operators import scoring as SC
from reviewlake.session import scratch_dir
from reviewlake.sources import review_files as RF
from reviewlake.streaming import incremental as ST


def _factory_failing_on(bad):
    calls = []

    def factory():
        def score(texts):
            calls.append(len(texts))
            if any(t in bad for t in texts):
                raise RuntimeError("boom")
            return [t.upper() for t in texts]
        return score
    return factory


def test_score_with_isolates_errors_and_dedupes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad")], "id int, t string")
    out = {r.id: (r.value, r.error) for r in
           SC.score_with(df, "t", _factory_failing_on({"bad"}), backoff_s=0.0).collect()}
    assert out[1] == ("A", None) and out[3] == ("A", None) and out[2] == ("B", None)
    assert out[4][0] is None and "boom" in out[4][1]


def test_score_with_resume(spark):
    path = scratch_dir(spark, "score_resume")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    SC.score_with(df, "t", _factory_failing_on(set()), results_path=path).collect()
    n_first = spark.read.parquet(path).count()
    df2 = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    out = SC.score_with(df2, "t", _factory_failing_on(set()), results_path=path)
    assert sorted(r.value for r in out.collect()) == ["A", "B", "C"]
    assert n_first == 2 and spark.read.parquet(path).count() == 3  # only 'c' was scored again


def test_failed_texts_are_scored_again_and_the_newest_result_counts(spark):
    path = scratch_dir(spark, "score_retry")
    df = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, t string")
    first = {r.id: r.error for r in SC.score_with(df, "t", _factory_failing_on({"bad"}), backoff_s=0.0, results_path=path).collect()}
    assert first[1] is None and "boom" in first[2]
    again = SC.score_with(df, "t", _factory_failing_on(set()), results_path=path, keep=["id"])
    assert again.columns == ["id", "value", "error"]
    assert {r.id: (r.value, r.error) for r in again.collect()} == {1: ("A", None), 2: ("BAD", None)}
    assert spark.read.parquet(path).count() == 3  # only the failed text was scored again
    assert SC.coverage(again).first()[:] == (2, 0, 2)


def test_unreadable_results_are_an_error_not_a_rescore(spark):
    path = scratch_dir(spark, "score_broken")
    spark.range(3).write.parquet(path)  # no result table
    with pytest.raises(AnalysisException):
        SC.score_with(spark.createDataFrame([(1, "a")], "id int, t string"), "t", _factory_failing_on(set()), results_path=path)


def test_a_scorer_with_too_few_answers_is_isolated(spark):
    def factory():
        return lambda texts: [t.upper() for t in texts if t != "lost"]
    df = spark.createDataFrame([(1, "a"), (2, "lost"), (3, "c")], "id int, t string").coalesce(1)
    out = {r.id: (r.value, r.error) for r in SC.score_with(df, "t", factory, backoff_s=0.0).collect()}
    assert out[1] == ("A", None) and out[3] == ("C", None) and "0 answers to 1 texts" in out[2][1]


def test_an_embedder_comes_through_the_scoring_job(spark):
    def factory():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]
    df = spark.createDataFrame([(1, "a"), (2, "bcd")], "id int, t string")
    out = SC.score_with(df, "t", factory, value_type="array<double>", keep=["id"]).collect()
    assert {r.id: r.value for r in out} == {1: [1.0, 1.0], 2: [3.0, 1.0]}


def test_report_order_with_a_large_question_id_and_coverage(spark):
    from reviewlake.plans.reporting import report_sections
    reviews = spark.createDataFrame([("1", "a", "good", "good", 4.0), ("1", "a", "good", "good", 4.0)],
                                    "id string, company string, title string, body string, text_rating double")
    summ = spark.createDataFrame([(2000, "Q2000", "x", 3, 2), (1, "Q1", "y", 3, 3)],
                                 "question_id long, question string, summary string, n_batches long, n_answered long")
    out = report_sections(spark, reviews, summ).orderBy("part", "section_order").collect()
    assert [r.heading for r in out] == ["Analytical Report", "Executive Summary", "Sentiment Analysis", "Q1", "Q2000",
                                        "Overall Rating", "Charts"]
    assert "evaluates 2 customer reviews" in out[1].text  # a repeated id counts as often as it occurs
    assert out[4].text == "x (answered in 2 of 3 batches)" and out[3].text == "y"


def test_dedupe_latest_hot_key(spark):
    rows = [("c", "1", f"v{i}", i) for i in range(500)] + [("c", "2", "only", 5)]
    df = spark.createDataFrame(rows, "company string, id string, title string, ts int")
    got = {r.id: r.title for r in DD.dedupe_latest(df, ["company", "id"], "ts").collect()}
    assert got == {"1": "v499", "2": "only"}


def test_missing_input_fails_fast(spark):
    with pytest.raises(FileNotFoundError):
        RF.read_json_lines(spark, "/nonexistent/reviewlake/x")


def test_legacy_json_reader(spark):
    d = tempfile.mkdtemp(prefix="rl-legacy-")
    p = os.path.join(d, "asda.json")
    with open(p, "w") as f:
        f.write('[{"id": "a", "title": "t", "body": "b", "timestamp": "2024-01-01T00:00:00.000Z",'
                ' "rating": 5, "text-rating": "4.500", "discrepancy": 0.5, "page": 1,'
                ' "sentiment": "positive", "topic": "price", "verified": true},\n'
                ' {"id": "b", "title": "t", "body": "b", "timestamp": "2024-01-01T00:00:00.000Z",'
                ' "rating": "unknown", "text-rating": "unknown", "discrepancy": "N/A", "page": 2,'
                ' "sentiment": "unknown", "topic": "unknown", "verified": false}]')
    df = RF.read_legacy_json(spark, p, company="ASDA")
    got = {r.id: (r.rating, r.text_rating, r.discrepancy, r.company) for r in df.collect()}
    assert got == {"a": ("5", "4.500", 0.5, "ASDA"), "b": ("unknown", "unknown", None, "ASDA")}


def test_stream_dedupe_restart_no_duplicates(spark):
    src = tempfile.mkdtemp(prefix="rl-src-")
    out, ck = scratch_dir(spark, "s_out"), scratch_dir(spark, "s_ck")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "a", 1.0, "{}"), (2, "2024-01-01 00:10:00", 1, "a", 1.0, "{}")],
                          "event_id long, ts string, user_id long, event_type string, value double, props string") \
        .withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    st = schema
    ST.run_available_now(ST.dedupe_stream(ST.file_stream(spark, src, st), "user_id", "ts", "1 hour"), out, ck)
    ST.run_available_now(ST.dedupe_stream(ST.file_stream(spark, src, st), "user_id", "ts", "1 hour"), out, ck)
    assert spark.read.parquet(out).count() == 1


def test_ingest_pipeline_masks_after_scoring(spark):
    import json
    from reviewlake import dictionaries as D
    from reviewlake.plans.ingest import RECORD_COLUMNS, ingest_pages
    reviews = [{"id": "r/1", "title": "Great", "text": "great service, mail me at a.b@x.co",
                "rating": 4, "labels": {"verification": {"isVerified": True}},
                "dates": {"publishedDate": "2024-02-01T10:00:00.000Z"}},
               {"id": "r/2", "title": "Bad", "text": "bad and late", "rating": "x",
                "labels": {"verification": {}}, "dates": {}},
               {"id": "r/3", "labels": {}}]
    html = ('<script id="__NEXT_DATA__" type="application/json">'
            + json.dumps({"props": {"pageProps": {"reviews": reviews}}}) + "</script>")
    pages = spark.createDataFrame([("acme", 1, html)], "company string, page int, html string")
    rec, rej = ingest_pages(spark, pages, D.LEXICON_EN, D.TAXONOMY_FIVE_EN)
    assert rec.columns == RECORD_COLUMNS
    got = {r.id: r for r in rec.collect()}
    assert got["1"].sentiment == "positive" and got["1"].body == "great service, mail me at [EMAIL]"
    assert got["1"].topic == "customer service" and got["1"].rating == 4.0
    assert got["1"].discrepancy == abs(got["1"].text_rating - 4.0)
    assert got["2"].sentiment == "negative" and got["2"].rating is None and got["2"].discrepancy is None
    assert [r.reason for r in rej.collect()] == ["missing dates"]


def _page(company, number, *texts):
    import json
    reviews = [{"id": f"r/{k}", "title": "T", "text": t, "rating": 3, "labels": {"verification": {}}, "dates": {}} for k, t in enumerate(texts)]
    return (company, number, '<script id="__NEXT_DATA__" type="application/json">'
            + json.dumps({"props": {"pageProps": {"reviews": reviews}}}) + "</script>")


def test_ingest_keeps_pages_without_a_number_and_repeated_captures_apart(spark):
    from reviewlake.plans.ingest import ingest_pages
    pages = spark.createDataFrame([_page("a", None, "good good good"), _page("a", 1, "good bad bad"), _page("a", 1, "good good good")],
                                  "company string, page int, html string")
    records, rejects = ingest_pages(spark, pages)
    got = sorted((r.page is not None, r.sentiment, r.text_rating) for r in records.collect())
    assert got == [(False, "positive", 5.0), (True, "negative", round(3 - 2 / 3, 3)), (True, "positive", 5.0)]
    assert rejects.count() == 0


def test_ingest_stores_no_gazetteer_name(spark):
    from reviewlake import dictionaries as D
    from reviewlake.plans.ingest import ingest_pages
    names = [r[1] for r in D.GAZETTEER_EN.rows]
    text = "John from London helped Sarah on 3 March. " + ", ".join(n.title() for n in names) + " on 12/05/2024 and March 4th, 2023."
    pages = spark.createDataFrame([_page("a", 1, text)], "company string, page int, html string")
    body = ingest_pages(spark, pages)[0].first().body
    assert body.startswith("[PERSON] from [LOCATION] helped [PERSON] on [DATE].")
    assert not any(n in body.lower() for n in names) and "2024" not in body and "2023" not in body


def test_write_report_and_csv_roundtrip(spark):
    path = scratch_dir(spark, "report")
    df = spark.createDataFrame([(2, 1, "b", "x"), (1, 0, "a", "")], "section_order int, level int, heading string, text string")
    RF.write_report(df, path)
    back = spark.read.schema("section_order int, level int, heading string, text string").json(path)
    assert [r.heading for r in back.collect()] == ["a", "b"]
    csvp = scratch_dir(spark, "csv")
    data = spark.createDataFrame([("1", "c", "t", 'multi\nline "q"'), ("2", "c", None, "")],
                                 "id string, company string, title string, body string")
    RF.write_csv(data, csvp)
    back = RF.read_csv(spark, csvp, "id string, company string, title string, body string")
    assert sorted(back.collect()) == sorted(data.collect())


def test_stream_daily_counts_two_batches_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="rl-src2-")
    out, ck = scratch_dir(spark, "d_out"), scratch_dir(spark, "d_ck")
    ddl = "event_id long, ts string, user_id long, event_type string, value double, props string"
    schema = ddl.replace("ts string", "ts timestamp")

    def add(rows):
        spark.createDataFrame(rows, ddl).withColumn("ts", F.to_timestamp("ts")) \
            .write.mode("append").parquet(src)

    def run():
        s = ST.daily_counts_stream(ST.file_stream(spark, src, schema), "ts", "event_type")
        ST.run_available_now(s, out, ck, output_mode="update")

    add([(1, "2024-01-01 01:00:00", 1, "a", 1.0, "{}"), (2, "2024-01-01 05:00:00", 2, "a", 2.0, "{}"),
         (3, "2024-01-02 01:00:00", 1, "b", 4.0, "{}")])
    run()
    add([(4, "2024-01-02 02:00:00", 3, "b", 8.0, "{}"), (5, "2024-01-02 03:00:00", 3, "a", 16.0, "{}")])
    run()
    snap = spark.read.parquet(out)
    last = (snap.groupBy("day", "event_type")
            .agg(F.max_by(F.struct("n", "total_value"), "_epoch").alias("v"))
            .select(F.date_format("day", "yyyy-MM-dd").alias("d"), "event_type", "v.n", "v.total_value"))
    got = {(r.d, r.event_type): (r.n, r.total_value) for r in last.collect()}
    assert got == {("2024-01-01", "a"): (2, 3.0), ("2024-01-02", "b"): (2, 12.0), ("2024-01-02", "a"): (1, 16.0)}
    assert snap.select("_epoch").distinct().count() == 2


def test_texts_that_fail_wait_together(spark):
    import time

    def factory():
        def score(texts):
            raise RuntimeError("down")
        return score

    df = spark.createDataFrame([(f"t{i}",) for i in range(200)], "t string")
    began = time.time()
    got = SC.score_with(df, "t", factory, batch_size=16, backoff_s=0.1, tasks=1).collect()
    assert len(got) == 200 and all(r.value is None and r.error == "RuntimeError: down" for r in got)
    assert time.time() - began < 30  # one after the other: 60 s
