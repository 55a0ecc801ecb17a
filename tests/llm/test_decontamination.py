import random

import brute
from conftest import EDGE

from reviewlake.llm import decontamination as DC


def run(docs, items):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word) for r in DC.decontamination(docs, items).collect()}


def test_against_brute_force(spark):
    random.seed(2)
    vocabulary = ["w%d" % k for k in range(30)]
    base = [[random.choice(vocabulary) for _ in range(random.choice([3, 5, 9, 30, 50]))] for _ in range(12)] + [["a"] * 12, ["x", "y"] * 10]
    items = [(k, " ".join(b)) for k, b in enumerate(base)] + [(100, None), (101, ""), (102, " ".join(base[0]).upper())]
    docs = list(EDGE)
    for d in range(10, 130):
        w = [random.choice(vocabulary) for _ in range(random.randint(0, 50))]
        b = list(random.choice(base))
        for _ in range(random.randint(0, 2)):
            at = random.randrange(len(b))
            b[at:at + random.randint(0, 1)] = random.choice([["zz"], []]) or ["ins"]
        if random.random() < 0.1:
            b = b[len(b) // 2:] + b[:len(b) // 2]
        at = random.randint(0, len(w))
        docs.append((d, " ".join(w[:at] + b + w[at:])))
    got = run(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
              spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute.contaminated(docs, items)


def test_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "repeated row of text with two lines"), (None, "one")], "item_id long, text string")
    assert run(edge, items) == {(4, 1): (1.0, 0), (3, None): (1.0, 0)}
    assert run(empty, items) == {} and run(edge, items.where("false")) == {}


def test_native(spark, edge):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = DC.decontamination(edge, items)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_the_index_finds_the_item(spark, monkeypatch):
    # what the text is searched for names sizes only; two items of one size are told apart by the fingerprints
    tables = {}
    monkeypatch.setattr(DC, "written", lambda df, name, write=DC.written: tables.setdefault(name, write(df, name)))
    a, b = ([f"{x}{k}" for k in range(20)] for x in "ab")
    items = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(["z", *a])), (2, " ".join([*b, "z"])), (3, " ".join(a[:10] + b[10:]))], "doc_id long, text string")
    assert run(docs, items) == {(1, 1): (1.0, 1), (2, 2): (1.0, 0)}
    assert "item" not in tables["windows"].schema["todo"].dataType.elementType.names
    # without the index nothing is found
    monkeypatch.setattr(DC, "_blocks", lambda fp, radius, blocks=DC._blocks: DC.F.filter(blocks(fp, radius), lambda x: x["block"] < 0))
    assert run(docs, items) == {}
