"""Composed report jobs: per-company summary and the report section table.

The report is a small DataFrame ``(part, section_order, level, heading, text)``
assembled from independent aggregates over one review table; every number in
it is computed (including the review count the report states).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions import text as T
from reviewlake.operators import lexicon as L


def company_summary(spark: SparkSession, reviews: DataFrame, lexicon=D.LEXICON_EN) -> DataFrame:
    """Per company: total, pct_positive, pct_negative, avg_text_rating,
    avg_discrepancy, top_topic (most frequent non-NULL topic, ties by name).

    ``reviews`` is an enriched review table (numeric rating / text_rating).
    One scan that scores each review in its row, then two aggregates that each
    shrink the data: per (company, topic), per company.  A hot company is combined
    map-side at both levels; repeated ids count as often as they occur.
    """
    per_review = L.polarity(spark, reviews, T.corpus_text("title", "body"),
                            ["company", "topic", "text_rating", "discrepancy"], lexicon)
    per_topic = per_review.groupBy("company", "topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("polarity") > 0).alias("pos"),
        F.count_if(F.col("polarity") < 0).alias("neg"),
        F.sum("text_rating").alias("s_tr"), F.count("text_rating").alias("n_tr"),
        F.sum("discrepancy").alias("s_d"), F.count("discrepancy").alias("n_d"))
    has_topic = F.col("topic").isNotNull()
    c = per_topic.groupBy("company").agg(
        F.sum("n").alias("total"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.sum("s_tr").alias("s_tr"), F.sum("n_tr").alias("n_tr"),
        F.sum("s_d").alias("s_d"), F.sum("n_d").alias("n_d"),
        # arg-max by count, ties to the smaller topic name: min of (-count, topic)
        F.min_by(F.when(has_topic, F.col("topic")),
                 F.when(has_topic, F.struct((-F.col("n")).alias("a"), F.col("topic").alias("b"))))
        .alias("top_topic"))
    total = F.col("total").cast("double")
    return c.select(
        "company", F.col("total").cast("bigint").alias("total"),
        F.round(F.lit(100.0) * F.col("pos") / total, 6).alias("pct_positive"),
        F.round(F.lit(100.0) * F.col("neg") / total, 6).alias("pct_negative"),
        F.round(F.col("s_tr") / F.nullif(F.col("n_tr"), F.lit(0)), 6).alias("avg_text_rating"),
        F.round(F.col("s_d") / F.nullif(F.col("n_d"), F.lit(0)), 6).alias("avg_discrepancy"),
        "top_topic")


#: Parts of the report, in order: head, questions, tail.
HEAD, QUESTIONS, TAIL = 0, 1, 2


def report_sections(spark: SparkSession, reviews: DataFrame, summaries: DataFrame | None,
                    lexicon=D.LEXICON_EN, company_label: str = "the company",
                    include_rating: bool = True, include_charts: bool = True) -> DataFrame:
    """Ordered report sections (part, section_order, level, heading, text).

    ``summaries`` is (question_id, question, summary, n_batches, n_answered); a question's section
    follows the head whatever its id.  Head and tail come from one aggregate row over one
    scan; the review count counts rows.  The older report layout has neither the
    overall-rating nor the chart section (``include_rating=False, include_charts=False``).
    """
    pol = L.polarity(spark, reviews, T.corpus_text("title", "body"), ["text_rating"], lexicon)
    total = F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")
    head = pol.agg(
        (F.lit(100.0) * F.count_if(F.col("polarity") > 0) / total).alias("pct_positive"),
        (F.lit(100.0) * F.count_if(F.col("polarity") < 0) / total).alias("pct_negative"),
        F.count(F.lit(1)).alias("total"),
        F.avg("text_rating").alias("avg_text_rating"), F.count("text_rating").alias("scored"))
    fmt = lambda c: F.coalesce(F.format_number(F.col(c), 2), F.lit("n/a"))

    def section(part: int, order: int, level: int, heading: str, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(order).cast("bigint").alias("section_order"), F.lit(level).alias("level"),
                        F.lit(heading).alias("heading"), text.alias("text"))

    parts = [
        section(HEAD, 0, 0, "Analytical Report", F.lit("")),
        section(HEAD, 1, 1, "Executive Summary", F.format_string(
            "This report evaluates %d customer reviews of %s.", F.col("total"), F.lit(company_label))),
        section(HEAD, 2, 2, "Sentiment Analysis", F.concat(
            F.lit("Positive Reviews: "), fmt("pct_positive"), F.lit("%\nNegative Reviews: "), fmt("pct_negative"), F.lit("%")))]
    if include_rating:
        parts.append(section(TAIL, 0, 2, "Overall Rating", F.concat(
            F.lit("Average inferred rating: "), F.coalesce(F.format_number("avg_text_rating", 3), F.lit("n/a")),
            F.format_string(" (scored %d of %d reviews)", F.col("scored"), F.col("total")))))
    if include_charts:
        parts.append(section(TAIL, 1, 2, "Charts", F.lit("Inputs: top_terms (term cloud), rating_topic_freq (bar chart).")))
    out = head.select(F.inline(F.array(*parts)))
    if summaries is not None:
        covered = F.when(F.col("n_answered") < F.col("n_batches"), F.format_string(
            " (answered in %d of %d batches)", F.col("n_answered"), F.col("n_batches"))).otherwise(F.lit(""))
        out = out.unionByName(summaries.select(
            F.lit(QUESTIONS).alias("part"), F.col("question_id").cast("bigint").alias("section_order"), F.lit(1).alias("level"),
            F.col("question").alias("heading"), F.concat(F.coalesce("summary", F.lit("")), covered).alias("text")))
    return out
