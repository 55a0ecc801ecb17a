import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import chunking as CH
from reviewlake.operators import corpus_chunks as CC


def texts(rng, n, alphabet, longest):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def in_blocks(text, size, overlap, block):
    """The operator's steps on one machine: every block by its own stretch, entries handed on."""
    left, right = CC._margins(size)
    out, entry = [], 0
    for lo in range(0, len(text), block):
        a, z = max(0, lo - left), min(len(text), lo + block + right)
        odd = (a - len(text[:a].rstrip("\n"))) % 2 == 1
        p = CC.Pieces(text[a:z], size, overlap, odd, a == 0, lo + block + right > len(text))
        out += [c for _, c in p.chunks(entry - a, lo + block - a)]
        entries, leave = p.exits(lo - a, lo + block - a)
        entry = dict(zip((entries + a).tolist(), (leave + a).tolist())).get(entry, entry)
        assert entry >= min(lo + block, len(text))
    return out


@pytest.mark.parametrize("alphabet", ["ab \n", "abcdef  \n\n\n", "\n", "\n\n\n\n\nx", "x", "xé€😀 ", "word word. \n", "a" * 40 + " \n", "a" * 60 + "\n\n "])
def test_pieces_equal_the_sequential_splitter(alphabet):
    rng = random.Random(alphabet)
    for _ in range(150):
        size = rng.choice([2, 3, 7, 20, 60])
        overlap = rng.randint(0, size - 1)
        text = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randint(0, 300)))
        want = CH.split_recursive(text, size, overlap)
        whole = CC.Pieces(text, size, overlap)
        assert [c for _, c in whole.chunks(0, len(text))] == want
        assert in_blocks(text, size, overlap, rng.choice([size, size + 1, 3 * size])) == want


@pytest.mark.parametrize("seed,alphabet", [(1, "abc  \n"), (2, "\n"), (3, "ab" * 20 + " \n\n")])
def test_chunk_corpus_spans_rows_partitions_and_blocks(spark, seed, alphabet):
    rng = random.Random(seed)
    rows = [(i, t if t else None) for i, t in enumerate(texts(rng, 120, alphabet, 40))]
    rows[7] = (7, "long " * 300)  # a row longer than several blocks
    whole = "".join(t or "" for _, t in rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = [r.text for r in CC.chunk_corpus(df, ["id"], "text", 30, 12, block=64, partitions=6).orderBy("start").collect()]
    assert got == CH.split_recursive(whole, 30, 12)


def test_chains_of_blocks_that_remember_their_entry(spark):
    # single characters without overlap never fall into step: every block is left where its entry says
    rows = [(i, "x" * 50) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = CC.chunk_corpus(df, ["id"], "text", 30, 0, block=64, partitions=3).orderBy("start").collect()
    assert [r.text for r in got] == CH.split_recursive("x" * 2000, 30, 0)
    assert [r.start for r in got] == list(range(0, 2000, 30))


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert CC.chunk_corpus(empty, ["id"], "text").count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, " \n")], "id long, text string")
    assert CC.chunk_corpus(nothing, ["id"], "text").count() == 0
    clash = spark.createDataFrame([(2, "b ", "x"), (1, "a ", "y"), (2, "b ", "x")], "pid long, t string, start string")
    assert [r.text for r in CC.chunk_corpus(clash, ["pid"], "t").collect()] == ["a b b"]
    with pytest.raises(ValueError):
        CC.chunk_corpus(empty, ["id"], "text", size=10, overlap=10)


def test_whole_corpus_of_documents(spark):
    from reviewlake.plans.reviews import read_table
    d = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("t"))
    whole = "".join(r.t for r in d.orderBy("doc_id", "t").collect())
    got = [r.text for r in CC.chunk_corpus(d, ["doc_id"], "t", block=5000).orderBy("start").collect()]
    assert got == CH.split_recursive(whole)
