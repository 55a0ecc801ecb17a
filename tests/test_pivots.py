import numpy as np
import pytest

from reviewlake.operators import pivots as PV
from reviewlake.operators import retrieval as RT


def frames(spark, items, qs):
    idf = spark.createDataFrame([(int(i), None if x is None else [float(v) for v in x]) for i, x in items], "item long, v array<double>").repartition(3)
    return idf, spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(qs)], "question_id long, embedding array<double>")


def both(spark, items, qs, k=4, **how):
    idf, qdf = frames(spark, items, qs)
    counter = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, PV.knn_pruned(spark, idf, qdf, "item", "v", k, counter=counter, **how).collect()))
    assert got == sorted(map(tuple, RT.knn(spark, idf, qdf, "item", "v", k=k).select("question_id", "rank", "item", "distance").collect()))
    return got, counter.value


def test_clustered_items_need_few_distances(spark):
    rng = np.random.default_rng(1)
    mid = rng.normal(size=(30, 8)) * 10
    items = list(enumerate(mid[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 8)) * 0.3)) + [(9000, None)]
    qs = mid[:12] + rng.normal(size=(12, 8)) * 0.3
    got, compared = both(spark, items, qs)
    assert len(got) == 48 and compared < 0.2 * 4000 * 12


@pytest.mark.parametrize("how", [{}, {"pivots": 1}, {"broadcast_bytes": 100}])
def test_ties_copies_and_far_questions(spark, how):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[::3] = x[0]  # a third of the rows is one vector
    got, _ = both(spark, list(enumerate(x)), np.concatenate([rng.normal(size=(5, 3)), [[100.0, 0, 0]], x[:1]]), **how)
    assert len(got) == 7 * 4


def test_fewer_items_than_k_and_empty_tables(spark):
    got, _ = both(spark, [(1, [0.0, 1.0]), (2, [0.0, 1.0])], [[0.0, 0.0]], k=5)
    assert [r[2] for r in got] == [1, 2]
    idf, qdf = frames(spark, [(1, [0.0])], [[0.0]])
    assert PV.knn_pruned(spark, idf.where("false"), qdf, "item", "v").collect() == []
    assert PV.knn_pruned(spark, idf, qdf.where("false"), "item", "v").collect() == []
