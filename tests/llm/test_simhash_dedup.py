import random

import brute
import numpy as np
import pyarrow as pa
from conftest import EDGE

from reviewlake.llm import simhash_dedup as SH
from reviewlake.llm.components import components


def test_trie_join_connects_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    for trial in range(25):
        base = rng.integers(0, 1 << 63, int(rng.integers(1, 15)), dtype=np.uint64) * np.uint64(2)
        x = base[rng.integers(0, len(base), 300)]
        for _ in range(int(rng.integers(0, 5))):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
        x = np.unique(x)
        depth = [0, 16][trial % 2]
        near = [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 3
                and (not depth or int(x[i]) >> 48 == int(x[j]) >> 48)]
        links = SH.trie_links(x, depth, 3, step=[40, 1 << 13][trial % 3 == 0])
        assert set(links) <= {p for a, b in near for p in ((a, b), (b, a))}
        assert brute.components(len(x), links) == brute.components(len(x), near)
        assert len(links) < len(x)


def corpus():
    random.seed(2)
    rows = list(EDGE)
    texts = [" ".join("w%d" % random.randint(0, 300) for _ in range(120)) for _ in range(12)]
    for d in range(10, 90):
        w = random.choice(texts).split()
        for _ in range(random.choice([0, 0, 1, 3])):
            w[random.randrange(len(w))] = "edit"
        rows.append((d, " ".join(w).upper() if d % 3 else "\t".join(w)))
    return rows


def expected(rows):
    fps = [brute.simhash(t) for _, t in rows]
    group = brute.components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    key = [d if d is not None else -(1 << 63) for d, _ in rows]
    return sorted((d, f - (1 << 64) if f >> 63 else f, min(k for k, h in zip(key, group) if h == g))
                  for (d, _), f, g in zip(rows, fps, group) if d is not None)


def test_against_brute_force_with_and_without_split_subtrees(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bound in (SH.MAX_SUBTREE, 3):
        got = SH.simhash_dedup(df, max_subtree=bound).where("doc_id is not null").collect()
        assert sorted((r.doc_id, r.fp, r.component_id) for r in got) == expected(rows)


def test_crowded_subtrees_are_split_down_to_the_bound(spark, monkeypatch):
    """Fingerprints that share 40 bits: the bits next to the first block do not part them."""
    rng = np.random.default_rng(4)
    x = np.unique(rng.integers(0, 1 << 24, 900, dtype=np.uint64) | np.uint64(0x1234567890 << 24))
    x = np.unique(np.r_[x, x[:200] ^ np.uint64(5)])
    fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    found = [tuple(r) for r in SH.links(fps, max_subtree=100).collect()]
    at = {int(v): k for k, v in enumerate(x)}
    near = [(i, j) for i in range(len(x)) for j in range(i) if int(x[i] ^ x[j]).bit_count() <= 3]
    assert brute.components(len(x), [(at[u], at[v]) for u, v in found]) == brute.components(len(x), near)

    def sizes(max_bits, starts, widths):
        def run(batches):
            got = [b for b in batches if b.num_rows]
            if not got:
                return
            t = pa.Table.from_batches(got)
            top = t.column("x").to_numpy().view(np.uint64) >> np.uint64(48)
            n = np.unique(np.stack([t.column("block").to_numpy(), t.column("node").to_numpy(), top.astype(np.int64)]), axis=1, return_counts=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(n, pa.int64())], ["u", "v"])
        return run

    monkeypatch.setattr(SH, "_task", sizes)
    largest = max(r.u for r in SH.links(fps, max_subtree=100).collect())
    assert largest <= 100


def test_edges(edge, empty):
    got = SH.simhash_dedup(edge).collect()
    assert len(got) == len(EDGE)
    assert len({r.component_id for r in got if r.doc_id in (0, 1, 2)}) == 1  # no words: fingerprint zero
    assert SH.simhash_dedup(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert set(got[k] for k in range(61)) == {0} and set(got[k] for k in range(100, 140)) == {100}
