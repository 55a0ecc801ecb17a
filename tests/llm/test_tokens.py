"""Operators on token ids: encoder, blocks, counts, packing."""
import random
import zlib

import numpy as np
import pytest
from conftest import EDGE
from tokenizers import Tokenizer

from reviewlake.llm import packing as PK
from reviewlake.llm import token_blocks as TB
from reviewlake.llm import token_counts as TC
from reviewlake.llm.tokens import Encoder
from reviewlake.session import scratch_dir

PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "re", "é", "世", "1", "23", "!", " ", "<|endoftext|>", " the", "\r\n", "\x85", "\x1c",
         "ñ", "'ll", "A", "_", "''", "'x", "'S", "　", "​", "²", "½", "word,", "x%%%"]


@pytest.fixture(scope="module")
def library(vocabulary):
    return Tokenizer.from_file(vocabulary)


def fuzz(n, seed):
    random.seed(seed)
    return ["".join(random.choice(PARTS) for _ in range(random.randint(0, 30))) for _ in range(n)]


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4")


def test_encoder_gives_the_library_ids(vocabulary, library):
    texts = fuzz(4000, 1)
    for memo in (30, 100_000):
        e = Encoder(vocabulary, memo)
        assert all(e.encode(t) == ids(library, t).tobytes() for t in texts)


def test_marks_after_a_remembered_word_stay_one_word(vocabulary, library):
    """'word),' after 'word)': the marks are one word for the tokenizer, whatever the memory holds."""
    words = [w + m for w in ("word", "etc", "Ünder", "x") for m in ("", ",", ".", ")", '"', "),", ".,", "..", '".', '",', ".)", "...", ").,")]
    random.seed(9)
    e = Encoder(vocabulary)
    for _ in range(1500):
        t = random.choice([" ", "", "\n"]) + " ".join(random.choice(words) for _ in range(random.randint(1, 8)))
        assert e.encode(t) == ids(library, t).tobytes(), t


def test_counter_gives_the_library_counts(vocabulary, library):
    texts = fuzz(4000, 2) + ["word " * 5000, ""]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert TC.Counter(vocabulary).counts(texts) == expected
    assert TC.Counter(vocabulary, memo=40).counts(texts[:500]) == expected[:500]


def test_counts_edges(edge, empty, vocabulary, library):
    got = TC.token_counts(edge, vocabulary).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted(
        (d is not None, d or 0, len((t or "").encode()), len(ids(library, t or "")), len(ids(library, t or "")) > 1024) for d, t in EDGE)
    assert TC.token_counts(empty, vocabulary).count() == 0


def test_segments_round_trip():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        docs = [rng.integers(0, [2, 300, 60_000, 1 << 32][seed % 4], [0, 1, 5, 256, 257, 3000][int(rng.integers(6))]).astype("<u4")
                for _ in range(int(rng.integers(0, 6)))]
        names = [[None, 5, -3, 1 << 60][int(rng.integers(4))] for _ in docs]
        s = TB.Segment(TB.encode_segment(names, [d.tobytes() for d in docs], percentile=[50.0, 90.0, 100.0][seed % 3]))
        flat = np.concatenate(docs) if docs else np.zeros(0, "<u4")
        assert s.doc_ids == names and (s.ids() == flat).all()
        for _ in range(5):
            lo, hi = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
            assert (s.ids(lo, hi) == flat[lo:hi]).all()


def test_blocks_are_read_back_in_order(spark, edge, empty, vocabulary, library):
    rows = EDGE + [(d, t) for d, t in zip(range(7, 90), fuzz(83, 5))]
    random.shuffle(rows)
    path = scratch_dir(spark, "test-blocks")
    TB.write_blocks(spark.createDataFrame(rows, "doc_id long, text string"), path, vocabulary, segment_ids=200)
    got = sorted(TB.read_blocks(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")), strict=True):
        expected = np.append(ids(library, t or ""), 0).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (d, at, len(expected), expected.tobytes())
        at += len(expected)
    path = scratch_dir(spark, "test-blocks")
    TB.write_blocks(empty, path, vocabulary)
    assert TB.read_blocks(spark, path).count() == 0


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
            gaps.append((min(fits) if fits else capacity) - n)
    return len(gaps)


def test_rounds_fill_bins_without_gaps_and_as_well_as_best_fit(spark):
    random.seed(6)
    cases = [(capacity, {random.randint(1, capacity): random.randint(1, 40) for _ in range(kinds)})
             for capacity, kinds in ((10, 6), (64, 20), (1024, 30), (1024, 4))]
    cases.append((64, {1: 5000, 33: 100, 64: 3}))  # far more short pieces than bins
    for capacity, counts in cases:
        bins, seen = {}, set()
        given = spark.createDataFrame(list(counts.items()), "length long, n long")
        for n, lo, hi, first, per, at in map(tuple, PK.match(given, capacity).collect()):
            for r in range(lo, hi):
                assert (n, r) not in seen
                seen.add((n, r))
                bins.setdefault(first + (r - lo) // per, []).append((at + (r - lo) % per * n, n))
        assert seen == {(n, r) for n in counts for r in range(counts[n])}
        for held in bins.values():
            end = 0
            for at, n in sorted(held):
                assert at == end
                end += n
            assert end <= capacity
        # rounds see the gaps of the round before, so a few bins more than piece after piece are allowed
        assert len(bins) <= best_fit_decreasing(counts, capacity) * 1.01 + 1


def test_packing(spark, edge, empty, vocabulary, library):
    out = PK.pack(edge, vocabulary, capacity=64).collect()
    by_doc = {}
    for r in out:
        assert len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in EDGE:
        if d not in (3, 4):  # ids that repeat
            parts = sorted(by_doc[d], key=lambda r: r.piece)
            expected = np.append(ids(library, t or ""), 2).astype("<u4")
            assert b"".join(bytes(p.ids) for p in parts) == expected.tobytes()
            assert all(p.length == 64 for p in parts[1:]) and [p.start for p in parts][0] == 0
    assert len(by_doc[4]) == 2
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= 64
    assert PK.pack(empty, vocabulary).count() == 0


def test_shuffle_path_of_the_ranks(edge, vocabulary, monkeypatch):
    monkeypatch.setattr(PK, "MAX_BROADCAST_ROWS", 0)
    out = PK.pack(edge, vocabulary).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)


def test_crc_of_ids_is_the_contract(spark, edge, vocabulary, library):
    from reviewlake.llm.queries import _crc32_of_ids
    got = PK.pack(edge.where("doc_id = 5"), vocabulary).select(_crc32_of_ids()).first()[0]
    assert got == zlib.crc32(np.append(ids(library, EDGE[8][1]), 2).astype("<u4").tobytes())


def test_packing_rounds_run_under_their_own_settings(spark, monkeypatch):
    from reviewlake.llm import packing as PK

    seen, plain = [], PK._match
    monkeypatch.setattr(PK, "_match", lambda counts, capacity: seen.append({k: spark.conf.get(k) for k in PK.ROUND_CONF}) or plain(counts, capacity))
    before = {k: spark.conf.get(k) for k in PK.ROUND_CONF}
    places = PK.match(spark.createDataFrame([(7, 3), (3, 3)], "length long, n long"), 10)
    assert sorted((r.length, r.lo, r.hi) for r in places.collect())[-1][0] == 7
    assert seen == [PK.ROUND_CONF] and {k: spark.conf.get(k) for k in PK.ROUND_CONF} == before
