"""Plan-shape checks: the scale properties the design relies on, read from explain()."""
import contextlib
import io

from reviewlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_no_cross_or_nested_loop_joins_anywhere(spark):
    for name, fn in catalog.QUERIES.items():
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_top_terms_plan(spark):
    p = plan(catalog.QUERIES["top_terms"](spark, SF))
    assert "labels.parquet" not in p            # unused outer join pruned
    assert "LeftAnti" in p and "BroadcastHashJoin" in p
    assert "partial_count" in p                 # map-side combine before the shuffle
    assert "TakeOrderedAndProject" in p
    assert "lang" not in p.split("ReadSchema:")[1].split("\n")[0]   # column pruning


def test_global_top_k_is_limited_before_the_shuffle(spark):
    p = plan(catalog.QUERIES["knn_global"](spark, SF))
    assert "WindowGroupLimit" in p and "Partial" in p and "Final" in p


def test_flagship_aggregates_are_partial(spark):
    p = plan(catalog.QUERIES["company_summary"](spark, SF))
    assert p.count("partial_") >= 3
    assert "SortMergeJoin" not in p


def test_dedupe_is_an_aggregate_not_a_window(spark):
    p = plan(catalog.QUERIES["dedupe_latest"](spark, SF))
    assert "max_by" in p and "Window " not in p


def test_ingest_scans_once_and_joins_nothing(spark):
    from reviewlake import dictionaries as D
    from reviewlake.plans.catalog import _rendered_pages
    from reviewlake.plans.ingest import ingest_pages
    from reviewlake.session import scratch_dir
    path = scratch_dir(spark, "pages")
    _rendered_pages(spark, SF).write.parquet(path)
    records, _ = ingest_pages(spark, spark.read.parquet(path), D.LEXICON_FIXTURE, D.TAXONOMY_FIVE_FIXTURE)
    p = plan(records)
    assert p.count("FileScan") == 1 and p.count("from_json") == 1
    assert "Join" not in p and "Exchange" not in p


def test_head_sections_come_from_one_scan(spark):
    from reviewlake.plans.reporting import report_sections
    from reviewlake.plans.reviews import enrich, fixture_reviews
    p = plan(report_sections(spark, enrich(fixture_reviews(spark, SF)), None))
    assert p.count("FileScan") == 1 and "Union" not in p


def test_labels_never_become_rows_before_the_last_aggregate(spark):
    for name in ("sentiment_pct", "sentiment_label", "topic_five_class", "company_summary", "text_rating_lexicon"):
        p = plan(catalog.QUERIES[name](spark, SF))
        assert "Generate" not in p and "Join" not in p, name
