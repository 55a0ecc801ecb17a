"""The pipeline on the smallest tables, stage against stage in plain Python where that is possible."""
import brute
import corpus_pipeline as CP
import numpy as np
from tokenizers import Tokenizer

SMOKE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, vocabulary):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in CP.STAGES:
        out = stage(spark, docs, SMOKE)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}"
        out.write.mode("overwrite").parquet(path)
        after = spark.read.parquet(path)
        if name == "packing":
            break
        assert after.columns == columns
        new = {r.doc_id: r for r in after.collect()}
        assert set(new) <= set(rows)
        if name == "line_dedup":
            expected = {d: h for d, _, _, h in brute.line_dedup([(r.doc_id, r.text) for r in rows.values()])}
            assert {d: brute.sha(r.text) for d, r in new.items()} == expected
            assert all(r.n_chars == len(r.text) for r in new.values())
        if name == "simhash_dedup":
            ids = sorted(rows)
            fps = [brute.simhash(rows[d].text) for d in ids]
            group = brute.components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
            assert set(new) == {d for k, d in enumerate(ids) if group[k] == k}
        if name == "decontamination":
            bad = {d for d, _ in brute.contaminated([(r.doc_id, r.text) for r in rows.values()], items)}
            assert set(new) == set(rows) - bad
        docs, rows = after, new
    library = Tokenizer.from_file(vocabulary)
    got = {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append((r.piece, bytes(r.ids)))
    assert set(got) == set(rows)
    for d, parts in got.items():
        expected = np.array(library.encode(rows[d].text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(parts)) == expected


def test_dropping_rows_keeps_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (None, None, 1), (2, "a", 2)], "doc_id long, text string, _d int")
    from reviewlake.llm.common import id_key, whole_text
    from pyspark.sql import functions as F
    keyed = docs.where("_d = 1 or text = 'b'").select(id_key().alias("_d"), F.xxhash64(whole_text()).alias("_r"))
    assert sorted(map(tuple, CP._without(docs, keyed).collect())) == [(1, "a", 0), (2, "a", 2)]


def test_one_document_of_a_group_stays_where_ids_are_null_or_repeat(spark):
    base = " ".join(f"word{k}" for k in range(400))
    near = [base + end for end in ("", " !", " ?", " .")]
    other = " ".join(f"other{k}" for k in range(400))
    rows = [(None, near[0]), (None, near[1]), (None, near[2]), (7, near[3]), (8, near[0]), (3, other), (3, other + " !"), (4, other)]
    from reviewlake.llm import simhash_dedup as SH
    assert all((SH.fingerprint(a) ^ SH.fingerprint(b)).bit_count() <= 3 for a, b in ((base, n) for n in near))
    assert (SH.fingerprint(other) ^ SH.fingerprint(other + " !")).bit_count() <= 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = CP.drop_near_copies(spark, docs, SMOKE).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 3)]
    # a null id and one text, repeated: one document, which keeps its rows
    twice = spark.createDataFrame([(None, base), (None, base), (None, near[1]), (9, base)], "doc_id long, text string")
    kept = CP.drop_near_copies(spark, twice, SMOKE).collect()
    assert {r.doc_id for r in kept} == {None} and len({r.text for r in kept}) == 1
