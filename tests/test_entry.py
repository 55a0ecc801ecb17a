import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["company", "total", "pct_positive", "pct_negative", "avg_text_rating",
                          "avg_discrepancy", "top_topic"]


def test_oracles_are_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_every_query_runs_on_smoke_data(spark):
    for name, fn in E.queries().items():
        df = fn(spark, SMOKE)
        assert df.count() > 0, name
