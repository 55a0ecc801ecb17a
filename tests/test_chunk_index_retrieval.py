import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlake.operators import chunking as CH
from reviewlake.operators import indexing as IX
from reviewlake.operators import retrieval as RT


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab \nc.é😀", min_size=0, max_size=3000))
def test_chunk_fixed_rebuilds_text(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    chunks = [r.text for r in sorted(CH.chunk_fixed(df, ["id"], "t", 100, 20).collect(), key=lambda r: r.chunk_pos)]
    rebuilt = chunks[0] + "".join(c[20:] for c in chunks[1:])
    assert rebuilt == text
    assert all(len(c) <= 100 for c in chunks)


def test_split_recursive_golden():
    # a long part's chunks stand on their own; edges are stripped
    assert CH.split_recursive("aa bb cc dd ee\n\nff", 8, 0) == ["aa bb cc", "dd ee", "ff"]
    assert CH.split_recursive("one\n\ntwo\n\nthree", 9, 0) == ["one\n\ntwo", "three"]
    assert CH.split_recursive("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    assert CH.split_recursive("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert CH.split_recursive("  padded  ", 20, 5) == ["padded"] and CH.split_recursive(" \n ", 20, 5) == []


def test_split_recursive_properties():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta\n", "eps.\n\n"]
    text = " ".join(rng.choice(words) for _ in range(2000))
    chunks = CH.split_recursive(text, 200, 40)
    assert chunks and all(len(c) <= 200 for c in chunks)
    assert all(c in text for c in chunks)
    # every word of the text appears in some chunk, in order
    joined = "".join(chunks)
    assert joined.count("gamma") >= text.count("gamma")
    long_word = "x" * 450
    assert all(len(c) <= 200 for c in CH.split_recursive(long_word, 200, 40))


def test_chunk_recursive_per_review(spark):
    df = spark.createDataFrame([(1, "a " * 700), (2, "short"), (3, "")], "id long, t string")
    out = CH.chunk_recursive(df, "id", "t", 500, 100).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append(r)
    assert len(by[1]) >= 3 and [r.text for r in by[2]] == ["short"] and 3 not in by


def test_dense_index_matches_row_number_with_hot_group(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rng.randint(0, 20)}"   # one group holds a third
        rows.append((g, i, rng.randint(0, 3)))
    df = spark.createDataFrame(rows, "grp string, k int, sub int")
    out = IX.dense_index(df, ["k", "sub"], group_by=["grp"], num_partitions=7).collect()
    got = {(r.grp, r.k, r.sub): r.idx for r in out}
    expect = {}
    for g in {r[0] for r in rows}:
        for n, (gg, k, s) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))):
            expect[(gg, k, s)] = n
    assert got == expect
    glob = {r.k: r.idx for r in IX.dense_index(df, ["k"], num_partitions=5).collect()}
    assert glob == {k: k for k in range(3000)}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    items = rng.normal(size=(300, 8))
    qs = rng.normal(size=(5, 8))
    idf = spark.createDataFrame([(i, int(i // 100), items[i].tolist()) for i in range(300)],
                                "item long, batch long, v array<double>")
    qdf = spark.createDataFrame([(q, qs[q].tolist()) for q in range(5)], "question_id long, embedding array<double>")
    out = RT.knn(spark, idf, qdf, "item", "v", ["batch"], k=4).collect()
    got = {(r.batch, r.question_id, r.rank): r.item for r in out}
    for b in range(3):
        for q in range(5):
            d = ((items[b * 100:(b + 1) * 100] - qs[q]) ** 2).sum(axis=1)
            order = np.lexsort((np.arange(100), d))[:4] + b * 100
            assert [got[(b, q, k)] for k in range(1, 5)] == order.tolist()


def test_centroids(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 5.0])], "label int, v array<float>")
    got = {r.question_id: r.embedding for r in RT.centroids(df, "label", "v").collect()}
    assert got == {0: [2.0, 3.0], 1: [5.0, 5.0]}


def test_knn_blocks_give_one_answer_whatever_their_size(spark):
    rng = np.random.default_rng(5)
    items = np.round(rng.normal(size=(500, 16)), 1)
    items[::7] = items[0]  # ties
    qs = rng.normal(size=(7, 16))
    idf = spark.createDataFrame([(i, int(i // 100), items[i].tolist()) for i in range(500)],
                                "item long, batch long, v array<double>").repartition(3)
    qdf = spark.createDataFrame([(q, qs[q].tolist()) for q in range(7)], "question_id long, embedding array<double>")
    for part in ([], ["batch"]):
        rows = [sorted(map(tuple, RT.knn(spark, idf, qdf, "item", "v", part, **kw).collect()))
                for kw in ({}, {"broadcast_bytes": 300, "block_bytes": 20_000, "block_rows": 32})]
        assert rows[0] == rows[1] and len(rows[0]) == 7 * 4 * (5 if part else 1)


def test_knn_hands_on_a_block_share_not_all_pairs(spark):
    idf = spark.createDataFrame([(i, [float(i % 97), 1.0]) for i in range(4000)], "item long, v array<double>").coalesce(1)
    qdf = spark.createDataFrame([(q, [float(q), 0.0]) for q in range(20)], "question_id long, embedding array<double>")
    out = RT.knn(spark, idf, qdf, "item", "v", k=4, block_rows=500)
    out.collect()
    made = [int(n) for n in _rows_made(out)]
    assert made and max(made) <= 4 * 20 * (4000 // 500 + 1)


def _rows_made(df):
    """Output rows of the Python operators of an executed plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "MapInPandas" in name or "MapInArrow" in name:
            found.append(node.metrics().apply("pythonNumRowsReceived").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_lsh_fills_every_question_and_finds_most(spark):
    rng = np.random.default_rng(11)
    items, qs = rng.normal(size=(400, 8)), rng.normal(size=(12, 8))
    qs[0] += 50  # far from everything: answered exactly
    idf = spark.createDataFrame([(i, items[i].tolist()) for i in range(400)], "item long, v array<double>")
    qdf = spark.createDataFrame([(q, qs[q].tolist()) for q in range(12)], "question_id long, embedding array<double>")
    found = RT.knn_lsh(spark, idf, qdf, "item", "v")
    assert found.count() == 48
    rates = [r.recall for r in RT.recall(found, RT.knn(spark, idf, qdf, "item", "v"), "item").collect()]
    assert len(rates) == 12 and sum(rates) / 12 >= 0.9


def test_knn_many_question_blocks(spark):
    rng = np.random.default_rng(9)
    items = rng.normal(size=(200, 6))
    qs = rng.normal(size=(150, 6))
    idf = spark.createDataFrame([(i, int(i // 50), items[i].tolist()) for i in range(200)],
                                "item long, batch long, v array<double>")
    qdf = spark.createDataFrame([(q, qs[q].tolist()) for q in range(150)], "question_id long, embedding array<double>")
    out = RT.knn(spark, idf, qdf, "item", "v", ["batch"], k=3, broadcast_bytes=800).collect()   # ~9 blocks
    got = {(r.batch, r.question_id, r.rank): r.item for r in out}
    assert len(got) == 4 * 150 * 3
    for b in range(4):
        for q in (0, 77, 149):
            d = ((items[b * 50:(b + 1) * 50] - qs[q]) ** 2).sum(axis=1)
            order = np.lexsort((np.arange(50), d))[:3] + b * 50
            assert [got[(b, q, r)] for r in range(1, 4)] == order.tolist()


def test_chunk_recursive_on_whole_documents(spark):
    from pyspark.sql import functions as F
    from reviewlake.plans.reviews import read_table
    d = read_table(spark, "/root/testdata/sf0.001", "documents")
    ch = CH.chunk_recursive(d, "doc_id", "text")
    assert ch.where(F.length("text") > CH.CHUNK_SIZE).count() == 0
    # every non-blank document yields at least one chunk
    assert ch.select("doc_id").distinct().count() == d.where(F.length(F.trim("text")) > 0).count()


def test_knn_of_many_small_groups_takes_them_together(spark):
    import time

    n = 12_000
    items = spark.range(n, numPartitions=1).selectExpr("id", "id div 2 AS g", "array(double(id % 7), double(id % 3)) AS v")
    questions = spark.createDataFrame([(1, [0.0, 0.0]), (2, [6.0, 2.0])], "question_id int, embedding array<double>")
    RT.knn(spark, items.limit(10), questions, "id", "v", ["g"], k=1).count()  # workers are up
    began = time.time()
    got = {(r.g, r.question_id): (r.id, r.distance) for r in RT.knn(spark, items, questions, "id", "v", ["g"], k=1).collect()}
    assert time.time() - began < 8  # a frame for each group took three times as long
    for g in range(0, n // 2, 97):
        for q, (x, y) in ((1, (0, 0)), (2, (6, 2))):
            assert got[g, q] == min((((i % 7 - x) ** 2 + (i % 3 - y) ** 2), i) for i in (2 * g, 2 * g + 1))[::-1]
    assert len(got) == n
