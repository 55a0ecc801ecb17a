"""Captured review pages -> raw review rows.

Fetching is not built: captured pages ``(company, page, status, html)`` are
the input.  The operators:

* ``take_while_pages``: the paging bound.  Keep pages 1..N-1 where N is the
  first page that is not OK, lacks the payload, is missing (a gap), or is page
  100.  One row per (company, page) is kept first, by an aggregate (a company
  may hold a third of all rows; the aggregate combines map-side).  After the
  ``page < 100`` filter a company has at most 99 rows, so the per-company window
  that finds the first gap is bounded.
* ``extract_next_data``: body of the first ``<script id="__NEXT_DATA__"
  type="application/json">`` element (attributes in any order).
* ``parse_reviews``: ``from_json`` with a declared schema, ``posexplode`` of
  ``props.pageProps.reviews`` (order kept), defaults for absent fields, and a
  reject split for reviews lacking ``dates`` or ``labels.verification``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from reviewlake.functions import text as T
from reviewlake.operators.joins import small_side

# Fixed value: the paging loop stops at this page without parsing it.
PAGE_LIMIT = 100

NEXT_DATA_PATTERN = (r'(?is)<script(?=[^>]*\bid="__NEXT_DATA__")'
                     r'(?=[^>]*\btype="application/json")[^>]*>(.*?)</script>')

REVIEW_STRUCT = Ty.StructType([
    Ty.StructField("id", Ty.StringType()),
    Ty.StructField("title", Ty.StringType()),
    Ty.StructField("text", Ty.StringType()),
    Ty.StructField("rating", Ty.StringType()),
    Ty.StructField("filtered", Ty.BooleanType()),
    Ty.StructField("pending", Ty.BooleanType()),
    Ty.StructField("likes", Ty.LongType()),
    Ty.StructField("labels", Ty.StructType([
        Ty.StructField("verification", Ty.StructType([
            Ty.StructField("isVerified", Ty.BooleanType()),
            Ty.StructField("createdDateTime", Ty.StringType()),
            Ty.StructField("reviewSourceName", Ty.StringType()),
            Ty.StructField("verificationSource", Ty.StringType()),
            Ty.StructField("verificationLevel", Ty.StringType()),
            Ty.StructField("hasDachExclusion", Ty.BooleanType()),
        ])),
    ])),
    Ty.StructField("dates", Ty.StructType([
        Ty.StructField("experiencedDate", Ty.StringType()),
        Ty.StructField("publishedDate", Ty.StringType()),
        Ty.StructField("updatedDate", Ty.StringType()),
    ])),
    Ty.StructField("consumersReviewCountOnSameDomain", Ty.LongType()),
    Ty.StructField("language", Ty.StringType()),
])

PAYLOAD_SCHEMA = Ty.StructType([
    Ty.StructField("props", Ty.StructType([
        Ty.StructField("pageProps", Ty.StructType([
            Ty.StructField("pageUrl", Ty.StringType()),
            Ty.StructField("reviews", Ty.ArrayType(REVIEW_STRUCT)),
        ])),
    ])),
])


def extract_next_data(html) -> F.Column:
    """The embedded JSON payload, or NULL when the page has none."""
    h = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.regexp_extract(h, NEXT_DATA_PATTERN, 1), F.lit(""))


def dedupe_captures(pages: DataFrame, company: str = "company", page: str = "page",
                    prefer: list | str | None = None) -> DataFrame:
    """One row per (company, page): the capture with the greatest ``prefer`` (columns or
    expressions, in order; e.g. ``[F.col("status") == 200, "captured_at"]``), ties by a hash of the
    content, so the choice does not depend on the order of rows.  An aggregate, so repeated
    captures combine map-side."""
    others = [c for c in pages.columns if c not in (company, page)]
    order = [] if prefer is None else [prefer] if isinstance(prefer, str) else list(prefer)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    content = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others]), 256)
    agg = F.max_by(F.struct(*others), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], content.alias("content")))
    return pages.groupBy(company, page).agg(agg.alias("_c")).select(company, page, "_c.*")


def take_while_pages(pages: DataFrame, bad, company: str = "company",
                     page: str = "page", limit: int = PAGE_LIMIT) -> DataFrame:
    """Pages before the first stop (bad page, gap, or page ``limit``), per company.

    ``bad`` is a boolean Column over the page row (status not OK, no payload...).  The
    stop is found on (company, page, bad) alone, at most 99 rows per company; the pages
    themselves only pass a filter by the stop, one row per company.
    """
    inside = pages.where((F.col(page) >= 1) & (F.col(page) < limit))
    p = inside.select(company, page, bad.alias("_bad"))
    w = Window.partitionBy(company).orderBy(page)
    p = p.withColumn("_gap", F.row_number().over(w) != F.col(page))
    stop = p.groupBy(company).agg(F.min(F.when(F.col("_bad") | F.col("_gap"), F.col(page))).alias("_stop"))
    near = small_side(pages.sparkSession, stop.withColumnRenamed(company, "_company"))
    kept = inside.join(near, F.col(company).eqNullSafe(F.col("_company"))).where(
        F.col("_stop").isNull() | (F.col(page) < F.col("_stop")))
    return kept.select(*[f"`{c}`" for c in pages.columns])


def parse_reviews(pages: DataFrame, keys: list[str], html: str = "html",
                  rating_default: str = T.DEFAULT_RATING):
    """(reviews, rejects) from pages.  Reviews: keys..., pos, id, title, body,
    published (string), rating_raw, verified.  Rejects: keys..., pos, reason.
    ``rating_default`` fills an absent rating ('unknown'; the older ingest used
    ``T.DEFAULT_RATING_OLD``)."""
    payload = F.from_json(extract_next_data(html), PAYLOAD_SCHEMA)
    raw = pages.select(*keys, payload["props"]["pageProps"]["reviews"].alias("_rs"))
    # posexplode_outer + a filter on its output: with the plain generator Spark
    # infers size(_rs) > 0 and pushes it below the projection, which re-runs
    # from_json on the whole payload for the filter.
    ex = (raw.select(*keys, F.posexplode_outer("_rs").alias("pos", "r"))
          .where(F.col("pos").isNotNull()))
    r = F.col("r")
    reason = (F.when(r["dates"].isNull(), F.lit("missing dates"))
               .when(r["labels"]["verification"].isNull(), F.lit("missing labels.verification")))
    staged = ex.withColumn("reason", reason)
    rejects = staged.where(F.col("reason").isNotNull()).select(*keys, "pos", "reason")
    ok = staged.where(F.col("reason").isNull())
    title = F.coalesce(r["title"], F.lit(T.DEFAULT_TITLE))
    body = F.coalesce(r["text"], F.lit(T.DEFAULT_BODY))
    reviews = ok.select(
        *keys, "pos",
        T.review_id(r["id"], *[F.col(k) for k in keys], F.col("pos"), title, body).alias("id"),
        title.alias("title"), body.alias("body"),
        F.coalesce(r["dates"]["publishedDate"], F.lit(T.DEFAULT_PUBLISHED)).alias("published"),
        F.coalesce(r["rating"], F.lit(rating_default)).alias("rating_raw"),
        F.coalesce(r["labels"]["verification"]["isVerified"], F.lit(T.DEFAULT_VERIFIED)).alias("verified"))
    return reviews, rejects


def render_page(reviews_array, page_url) -> F.Column:
    """HTML page embedding ``{"props":{"pageProps":{"pageUrl", "reviews"}}}`` the way
    captured pages carry it (used to build test pages from review tables)."""
    payload = F.to_json(F.struct(F.struct(F.struct(
        page_url.alias("pageUrl"), reviews_array.alias("reviews")).alias("pageProps")).alias("props")))
    return F.concat(F.lit('<!DOCTYPE html><html><head><title>reviews</title></head><body>'
                          '<script id="__NEXT_DATA__" type="application/json">'),
                    payload, F.lit("</script></body></html>"))
