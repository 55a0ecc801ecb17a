"""Entity detection: rule counts (JVM) and span extraction (Arrow-batched Python).

``entity_counts`` stays in Catalyst.  ``detect_spans`` is the one place that
needs match *positions*, which Spark SQL does not expose for all matches; it is
a vectorised pandas UDF over Arrow batches, the same slot a user-supplied NER
model would fill.  Its output feeds ``functions.masking.mask_spans``.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from reviewlake import dictionaries as D
from reviewlake.functions import masking as M
from reviewlake.operators import lexicon as L
from reviewlake.session import bound_batches

SPAN_TYPE = Ty.ArrayType(Ty.StructType([
    Ty.StructField("start", Ty.IntegerType()),
    Ty.StructField("end", Ty.IntegerType()),
    Ty.StructField("label", Ty.StringType()),
]))


def entity_counts(docs: DataFrame, text_col: str, gazetteer=None) -> DataFrame:
    """Per detector label, and per gazetteer label if one is given: documents with at least one
    match, and total matches.  Gazetteer terms count in what the detectors leave."""
    counts = M.detector_counts(text_col)
    labels = [label for label, _ in M.DETECTORS]
    if gazetteer is None:
        per_doc = docs.select(F.struct(*counts).alias("c")).select("c.*")
    else:
        terms: dict[str, list[str]] = {}
        for label, term in D.as_dictionary(gazetteer).rows:
            terms.setdefault(label, []).append(term.lower())
        words = F.regexp_extract_all(F.lower(M.mask_pii(text_col)), F.lit(r"[\p{L}\p{N}_]+"), 0)
        staged = docs.select(F.struct(*counts).alias("c"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
        more = [F.size(L.phrase_hits(F.col("w"), ts)).alias(label) for label, ts in sorted(terms.items())]
        per_doc = staged.select("c.*", *more)
        labels += sorted(terms)
    long = per_doc.unpivot([], labels, "label", "n")
    return long.groupBy("label").agg(F.count_if(F.col("n") > 0).alias("n_docs"),
                                     F.sum("n").cast("bigint").alias("n_mentions"))


_WORD = re.compile(r"\w+")
_NEEDED = re.compile(M.NEEDED)


def _gazetteer_index(gazetteer) -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """Terms by their first word, longest first: one lookup per word of a text."""
    index: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for label, term in D.as_dictionary(gazetteer).rows:
        words = tuple(w.lower() for w in _WORD.findall(term))
        if words:
            index.setdefault(words[0], []).append((words, label))
    for terms in index.values():
        terms.sort(key=lambda t: (-len(t[0]), t))
    return index


def find_spans(text: str, rules, index) -> list[tuple[int, int, str]]:
    """Spans in order of place.  Detectors claim their matches in the order of ``rules`` (the order
    of ``masking.mask_pii``), gazetteer terms what is left; later ones never see a claimed part."""
    spans: list[tuple[int, int, str]] = []
    rest = text
    for label, rx in rules if _NEEDED.search(text) else ():
        found = [(m.start(), m.end(), label) for m in rx.finditer(rest)]
        if found:
            spans += found
            parts, at = [], 0
            for s, e, _ in found:
                parts += [rest[at:s], "\0" * (e - s)]
                at = e
            rest = "".join([*parts, rest[at:]])
    words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(rest)] if index else []
    k = 0
    while k < len(words):
        for terms, label in index.get(words[k][0], ()):
            if tuple(w for w, _, _ in words[k:k + len(terms)]) == terms:
                spans.append((words[k][1], words[k + len(terms) - 1][2], label))
                k += len(terms) - 1
                break
        k += 1
    return sorted(spans)


def make_span_detector(gazetteer=D.GAZETTEER_EN):
    """pandas UDF: text -> non-overlapping spans, by detector priority."""
    rules = [(label, re.compile(p)) for label, p in M.DETECTORS]
    index = _gazetteer_index(gazetteer)
    bound_batches(SparkSession.getActiveSession())

    @F.pandas_udf(SPAN_TYPE)
    def detect_spans(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [
            {"start": s, "end": e, "label": label} for s, e, label in find_spans(t, rules, index)] for t in texts])

    return detect_spans
