import math
import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import hard_negatives as HN

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, rank int"


def plain(rows, every=10, positives=5, negatives=5, share=80):
    kept = {}
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, r), r)
    out = []
    for a, (label, v) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, lab) for i, (lab, w) in kept.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and share * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(near)]
    return sorted(out)


def run(spark, rows, parts=3, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(map(tuple, HN.hard_negatives(df, "id % 10 = 0", **how).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def made(n, dims, seed, clusters=4):
    rng = random.Random(seed)
    mid = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = []
    for i in range(n):
        c = rng.randrange(clusters)
        rows.append((i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in mid[c]], rng.choice([c, c, rng.randrange(clusters)]), "x", 1, 2))
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, block_bytes):
    rows = made(300, 6, 1) + [(None, [1.0] * 6, 1, "x", 1, 2), (7, None, 1, "x", 1, 2), (8, [1.0] * 5 + [None], 1, "x", 1, 2),
                              (-20, [float("nan")] * 6, 0, "x", 1, 2), (-30, [float("inf")] * 6, 0, "x", 1, 2), (-10, [0.5, -0.25], 2, "x", 1, 2),
                              (-40, [], 0, "x", 1, 2), (-50, [1.0] * 6, None, "x", 1, 2)]
    want = plain(rows)
    assert len(want) > 200 and run(spark, rows, block_bytes=block_bytes) == want


def test_one_vector_in_a_third_of_the_rows_and_ties_by_id(spark):
    rows = made(200, 4, 2)
    rows += [(1000 + i, [1.0, 0.5, -0.5, 2.0], i % 3, "x", 1, 2) for i in range(150)]
    rows += rows[:20] + [(30, [0.0] * 4, 0, "x", 1, 2)]
    assert run(spark, rows) == plain(rows)


def test_labels_that_stand_alone_and_empty_tables(spark):
    assert run(spark, [(0, [1.0], 0, "x", 1, 2), (1, [1.0], 1, "x", 1, 2)]) == []
    assert run(spark, []) == [] and run(spark, [(10, [], 0, "x", 1, 2)]) == []


def test_other_numbers_of_rows(spark):
    rows = made(120, 3, 5)
    assert run(spark, rows, positives=2, negatives=3, share=95) == plain(rows, positives=2, negatives=3, share=95)


def test_large_components_stay_exact_or_are_refused(spark):
    rows = [(i, [float(2**20 + i), -float(2**20)], i % 2, "x", 1, 2) for i in range(40)]
    assert run(spark, rows) == plain(rows)
    with pytest.raises(ValueError):
        run(spark, [(i, [2.0**30], 0, "x", 1, 2) for i in range(11)])


def test_boxes_outside_are_not_visited():
    v = np.array([r[1] for r in made(4000, 3, 9, 12)]) * 256 // 1
    leaves = HN.str_leaves(v, 50)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(4000)) and max(map(len, leaves)) <= 50
    batch = pa.RecordBatch.from_arrays(
        [pa.array([x for x in leaves]), pa.array([x % 2 for x in leaves]), pa.array([v[x].min(axis=0) for x in leaves]),
         pa.array([v[x].max(axis=0) for x in leaves]), pa.array([v[x].astype("<i8").tobytes() for x in leaves])], HN.LEAVES.names)
    boxes = HN._Boxes(batch, 3, "f8")
    found = [[]]
    boxes.search(v[0], 0, 0, True, [(-math.inf, math.inf)], found, 5)
    scores = v @ v[0]
    assert found[0] == sorted((-scores[i], i) for i in range(2, 4000, 2))[:5]
    assert boxes.visited < len(leaves) / 4
