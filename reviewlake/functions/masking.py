"""Personal-data masking as Catalyst expressions.

Two forms:

* ``mask_pii``: rule detectors (email, card-like number, IPv4, date, phone)
  applied as a chain of ``regexp_replace`` in priority order.  Each detector
  runs on the output of the previous one, so a card number is never re-read as
  a phone number, and placeholders contain no characters a later detector
  matches.  Patterns use ASCII classes only, so Java regex and RE2 agree.
* ``mask_spans``: apply externally produced entity spans (0-based, end
  exclusive, code points): ``aggregate`` over the sorted span array picks them, one join puts the text together; overlapping spans are resolved by earliest start, then longest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Placeholder per entity label.  ORG keeps its own text; any label
# not listed here becomes [ANONYMIZED].
PLACEHOLDERS = {
    "PERSON": "[PERSON]",
    "GPE": "[LOCATION]",
    "LOC": "[LOCATION]",
    "DATE": "[DATE]",
    "EMAIL": "[EMAIL]",
}
KEEP_LABELS = ("ORG",)
OTHER_PLACEHOLDER = "[ANONYMIZED]"

# English month names as dates spell them.
MONTHS = ("January|February|March|April|May|June|July|August|September|October|November|December"
          "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec")

# Rule detectors in priority order: (label, pattern).
DETECTORS = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("CARD", r"[0-9](?:[ -]?[0-9]){12,18}"),
    ("IPV4", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})"
             r"|[0-9]{1,2}(?:st|nd|rd|th)? (?:" + MONTHS + r")(?: [0-9]{4})?"
             r"|(?:" + MONTHS + r") [0-9]{1,2}(?:st|nd|rd|th)?(?:,? [0-9]{4})?"),
    ("PHONE", r"\+?[0-9][0-9 ()-]{7,}[0-9]"),
]


def placeholder_for(label: str) -> str:
    return PLACEHOLDERS.get(label, OTHER_PLACEHOLDER)


# Every detector's matches hold one of these.
NEEDED = "[0-9@]"


def mask_pii(text) -> Column:
    """Replace every detector match by its label's placeholder (whole text).  Texts without a digit
    or an @ are passed on after one scan."""
    raw = F.col(text) if isinstance(text, str) else text
    out = raw
    for label, pattern in DETECTORS:
        out = F.regexp_replace(out, pattern, placeholder_for(label))
    return F.when(raw.rlike(NEEDED), out).otherwise(raw)


def detector_counts(text) -> list[Column]:
    """Per detector: number of matches in the text as masked by earlier detectors. Texts without a digit
    or an @ are looked at once."""
    raw = F.col(text) if isinstance(text, str) else text
    # one input for all detectors, so that the chain is evaluated once a row
    cur = F.when(raw.isNull() | raw.rlike(NEEDED), raw).otherwise("")
    counts = []
    for label, pattern in DETECTORS:
        counts.append(F.size(F.regexp_extract_all(cur, F.lit(pattern), 0)).alias(label))
        cur = F.regexp_replace(cur, pattern, placeholder_for(label))
    return counts


def _span_placeholder(text: Column, s: Column) -> Column:
    expr = F.when(s["label"].isin(*KEEP_LABELS),
                  F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    for label, ph in PLACEHOLDERS.items():
        expr = expr.when(s["label"] == F.lit(label), F.lit(ph))
    return expr.otherwise(F.lit(OTHER_PLACEHOLDER))


def mask_spans(text, spans) -> Column:
    """Mask ``text`` with ``spans`` ARRAY<STRUCT<start INT, end INT, label STRING>>."""
    t = F.col(text) if isinstance(text, str) else text
    sp = F.col(spans) if isinstance(spans, str) else spans
    ordered = F.array_sort(F.coalesce(sp, F.array().cast(
        "array<struct<start:int,end:int,label:string>>")), lambda a, b: F.when(
        a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    kept = "array<struct<prev:int,start:int,end:int,label:string>>"
    init = F.struct(F.array().cast(kept).alias("kept"), F.lit(0).alias("pos"))

    def step(acc, s):
        span = F.struct(acc["pos"].alias("prev"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label"))
        more = F.struct(F.concat(acc["kept"], F.array(span)).alias("kept"), s["end"].cast("int").alias("pos"))
        return F.when(s["start"] >= acc["pos"], more).otherwise(acc)

    def finish(acc):
        # the text between spans and the placeholders are joined once
        pieces = F.transform(acc["kept"], lambda s: F.concat(F.substring(t, s["prev"] + 1, s["start"] - s["prev"]), _span_placeholder(t, s)))
        return F.array_join(F.concat(pieces, F.array(F.substring(t, acc["pos"] + 1, 2147483647))), "")

    return F.when(t.isNull(), F.lit(None)).otherwise(F.aggregate(ordered, init, step, finish))
