"""Ingest: captured pages -> the typed, labelled, masked review record.

Order matters for privacy: labels are computed from the raw text, then title
and body are masked (numbers, mails, dates, and the persons and places of the
gazetteer), and only masked text leaves the job.

Scores are computed in the review's own row (``operators.lexicon.with_scores``):
one page scan, one ``from_json``, no join and no group-by, so a page without a
number, a page captured twice or a repeated id neither loses, doubles nor merges a
review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions import masking as M
from reviewlake.functions import text as T
from reviewlake.operators import entities as EN
from reviewlake.operators import lexicon as L
from reviewlake.sources import pages as PG

RECORD_COLUMNS = ["company", "id", "title", "body", "published_at", "rating_raw", "rating",
                  "text_rating", "discrepancy", "page", "sentiment", "topic", "verified"]


def ingest_pages(spark: SparkSession, pages: DataFrame, lexicon: D.Dictionary = D.LEXICON_EN,
                 taxonomy: D.Dictionary = D.TAXONOMY_FIVE_EN, gazetteer=D.GAZETTEER_EN, detector=None):
    """(records, rejects) from ``pages(company, page, html)`` (already bounded by
    ``take_while_pages``).  ``detector``: text -> spans; by default rules and the gazetteer, else
    e.g. ``tagging.make_tagging_detector``."""
    raw, rejects = PG.parse_reviews(pages, ["company", "page"])
    # the scoring text is materialised with the parsed fields, so the payload is parsed once
    staged = raw.select("*", T.scoring_text("title", "body").alias("_text"))
    j = L.with_scores(staged, "_text", lexicon, taxonomy)
    detect = detector or EN.make_span_detector(gazetteer)
    rating = T.guarded_double("rating_raw")
    text_rating = L.text_rating_from_polarity("polarity", "magnitude")
    rec = j.select(
        "company", "id",
        M.mask_spans("title", detect("title")).alias("title"), M.mask_spans("body", detect("body")).alias("body"),
        F.to_timestamp("published").alias("published_at"),
        "rating_raw", rating.alias("rating"), text_rating.alias("text_rating"),
        F.abs(text_rating - rating).alias("discrepancy"),
        "page", L.sentiment_from_polarity("polarity").alias("sentiment"), "topic", "verified")
    return rec.select(*RECORD_COLUMNS), rejects
