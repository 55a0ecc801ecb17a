from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from reviewlake.functions import masking as M
from reviewlake.operators import entities as EN

SPAN_DDL = "t string, s array<struct<start:int,end:int,label:string>>"


def _mask(spark, text, spans):
    df = spark.createDataFrame([(text, spans)], SPAN_DDL)
    return df.select(M.mask_spans("t", "s")).first()[0]


def test_fixture_sample(spark):
    spans = [(0, 3, "PERSON"), (8, 11, "PERSON"), (15, 20, "GPE")]
    assert _mask(spark, "Ann met Bob in Leeds", spans) == "[PERSON] met [PERSON] in [LOCATION]"


def test_org_kept_other_anonymized_and_no_spans(spark):
    assert _mask(spark, "Call Acme now", [(5, 9, "ORG")]) == "Call Acme now"
    assert _mask(spark, "I bought 12 eggs", [(9, 11, "CARDINAL")]) == "I bought [ANONYMIZED] eggs"
    assert _mask(spark, "nothing here", []) == "nothing here"
    assert _mask(spark, "nothing here", None) == "nothing here"


def test_unsorted_and_overlapping_spans(spark):
    # earliest start wins, then the longest; a span inside a taken one is skipped
    spans = [(4, 10, "DATE"), (0, 3, "PERSON"), (4, 7, "PERSON")]
    assert _mask(spark, "Ann 12 May ok", spans) == "[PERSON] [DATE] ok"


def test_emoji_and_accents_offsets(spark):
    text = "😀 Zoë in Paris"
    spans = [(2, 5, "PERSON"), (9, 14, "GPE")]
    assert _mask(spark, text, spans) == "😀 [PERSON] in [LOCATION]"


@settings(max_examples=12, deadline=None)
@given(st.text(alphabet="abcdé xyz😀", min_size=0, max_size=40), st.data())
def test_outside_spans_unchanged(spark, text, data):
    n = len(text)
    cuts = sorted(data.draw(st.lists(st.integers(0, n), max_size=6, unique=True)))
    spans = [(cuts[i], cuts[i + 1], "PERSON") for i in range(0, len(cuts) - 1, 2) if cuts[i] < cuts[i + 1]]
    expect, pos = [], 0
    for s, e, _ in spans:
        expect.append(text[pos:s])
        expect.append("[PERSON]")
        pos = e
    expect.append(text[pos:])
    assert _mask(spark, text, spans) == "".join(expect)


def test_mask_pii_card_before_phone(spark):
    df = spark.createDataFrame([("pay 4785 3805 9239 1139 or call +1 (743) 555-3824, mail a.b@x.co, ip 10.0.0.1 on 2024-01-02",)], "t string")
    out = df.select(M.mask_pii("t")).first()[0]
    assert out == "pay [ANONYMIZED] or call [ANONYMIZED], mail [EMAIL], ip [ANONYMIZED] on [DATE]"


def test_detect_spans_then_mask(spark):
    detect = EN.make_span_detector()
    df = spark.createDataFrame([("John from London wrote to j@x.org",)], "t string")
    out = df.select(M.mask_spans("t", detect("t"))).first()[0]
    assert out == "[PERSON] from [LOCATION] wrote to [EMAIL]"


def test_entity_counts(spark):
    df = spark.createDataFrame([("a@b.co 4111111111111111",), ("nothing",)], "text string")
    got = {r.label: (r.n_docs, r.n_mentions) for r in EN.entity_counts(df, "text").collect()}
    assert got["EMAIL"] == (1, 1) and got["CARD"] == (1, 1) and got["PHONE"] == (0, 0)


def test_both_maskers_agree(spark):
    texts = ["on 2024-01-02 10 boxes", "4785 3805 9239 1139 2024-01-02", "a.b@x.co 10.0.0.1 3 March 2024 +1 (743) 555-3824", "12/05/24 9"]
    none = EN.make_span_detector(EN.D.Dictionary("none", "label string, term string", ()))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(M.mask_pii("t").alias("a"), M.mask_spans("t", none("t")).alias("b")).collect():
        assert r.a == r.b


def test_gazetteer_as_a_table_with_longest_match(spark):
    gaz = spark.createDataFrame([("GPE", "new york"), ("PERSON", "york"), ("PERSON", "new york smith")], "label string, term string")
    detect = EN.make_span_detector(gaz)
    df = spark.createDataFrame([("New York, York and New York Smith; newyork",)], "t string")
    assert df.select(M.mask_spans("t", detect("t"))).first()[0] == "[LOCATION], [PERSON] and [PERSON]; newyork"


def test_many_spans_and_chunks_of_a_long_text(spark):
    from reviewlake.operators import chunking as CH
    n = 4000
    text = "é" + "ab𝒳d " * (n * 2)
    spans = [(1 + 10 * i, 3 + 10 * i, ["PERSON", "ORG", "X"][i % 3]) for i in range(n)] + [(1, 2, "DATE"), (5, 5, "GPE")]
    df = spark.createDataFrame([(1, text, spans), (2, "", []), (3, None, [])], "id int, t string, s array<struct<start:int,end:int,label:string>>")
    want, at = "", 0
    for s, e, label in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            want += text[at:s] + (text[s:e] if label == "ORG" else M.PLACEHOLDERS.get(label, M.OTHER_PLACEHOLDER))
            at = e
    assert {r.id: r.m for r in df.select("id", M.mask_spans("t", "s").alias("m")).collect()} == {1: want + text[at:], 2: "", 3: None}
    for size, overlap in ((1000, 200), (50, 40), (7, 0)):
        got = {(r.id, r.chunk_pos): r.text for r in CH.chunk_fixed(df, ["id"], "t", size, overlap).collect()}
        step = size - overlap
        count = max(1, -(-(len(text) - overlap) // step))
        assert got == {**{(1, i): text[i * step:i * step + size] for i in range(count)}, (2, 0): "", (3, 0): None}


def test_detector_counts_look_at_other_texts_once(spark):
    df = spark.createDataFrame([("no such thing",), ("mail a@b.de on 2024-01-02",), ("",), (None,)], "t string")
    counts = M.detector_counts("t")
    assert all(M.NEEDED in str(c) for c in counts)
    got = [tuple(r) for r in df.select(*counts).collect()]
    assert got[0] == got[2] == (0,) * 5 and got[1] == (1, 0, 0, 1, 0)
    assert got[3] == tuple(df.where("t is null").select(*[F.size(F.regexp_extract_all("t", F.lit(p), 0)) for _, p in M.DETECTORS]).first())
