import random

import brute
from conftest import EDGE

from reviewlake.llm import line_dedup as LD
from pyspark.sql import functions as F


def run(df, **kw):
    out = LD.line_dedup(df, **kw)
    return sorted(map(tuple, out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=str)


def test_against_brute_force(spark):
    random.seed(1)
    lines = ["shared line %d of the corpus" % k for k in range(6)] + ["Short", "", "  SHARED line 1 of the corpus\t", "ÉCOLE ancienne", "école ancienne"]
    rows = [(d, "\n".join(random.choice(lines + ["own %d" % d]) for _ in range(random.randint(0, 9)))) for d in range(60)] + [(None, lines[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == sorted(brute.line_dedup(rows), key=str)


def test_edges(edge, empty):
    assert run(edge) == sorted(brute.line_dedup(EDGE), key=str)
    assert run(empty) == []


def test_carry_keeps_every_column(edge):
    out = LD.line_dedup(edge, carry=True)
    assert out.columns == edge.columns and out.count() == edge.count()


def test_threshold_on_documents(spark):
    rows = [(d, "a line long enough") for d in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r[2] for r in run(df, min_docs=3)) == 2 and sum(r[2] for r in run(df, min_docs=4)) == 0


def test_hot_line_is_aggregated_before_the_shuffle(spark):
    df = spark.createDataFrame([(d, d, "x") for d in range(3)], "_d long, _r long, _t string")
    keys = LD.shared_keys(LD._lines(df, 1), 2)._jdf.queryExecution().toString()
    assert "partial_min" in keys
    docs = df.select(F.col("_d").alias("doc_id"), F.col("_t").alias("text"))
    for plan in (keys, LD.line_dedup(docs)._jdf.queryExecution().toString()):
        assert "Python" not in plan and "CartesianProduct" not in plan
