"""Column expressions for review text and fields.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so it
stays inside whole-stage codegen; nothing calls Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# Token: a letter, digit or underscore followed by at least one more letter,
# digit, underscore or apostrophe.  \p{L} rather than \w so accented text
# (fr/es/de) tokenises the same in Java regex and RE2.
TOKEN_PATTERN = r"[\p{L}\p{N}_][\p{L}\p{N}_']+"
# A plain decimal number, optionally signed, with optional exponent.  Guards
# numeric casts so '4d', '1_0', 'nan' and 'inf' are rejected in every engine.
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# Labels that mean "no usable answer" from a scorer.
FAILED_LABELS = ("unknown", "", "error")

# Defaults for absent review fields.
DEFAULT_TITLE = "No Title"
DEFAULT_BODY = "No Review Body"
DEFAULT_PUBLISHED = "2000-01-24T14:37:07.000Z"
DEFAULT_RATING = "unknown"
DEFAULT_RATING_OLD = "No Rating"
DEFAULT_VERIFIED = False


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokens(text) -> Column:
    """Lower-cased word tokens of ``text`` as ARRAY<STRING> (whole text)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def guarded_double(value) -> Column:
    """DOUBLE when ``value`` is a plain decimal number, else NULL (never raises)."""
    v = _c(value).cast("string")
    return F.when(v.rlike(NUMBER_PATTERN), F.trim(v).try_cast("double"))


def strict_double(value) -> Column:
    """Plain cast: under ANSI mode a non-number raises (the old strict behaviour)."""
    return _c(value).cast("double")


def discrepancy(text_rating, rating) -> Column:
    """|text_rating - rating|, NULL where either side is not a number."""
    return F.abs(guarded_double(text_rating) - guarded_double(rating))


def url_last_segment(value) -> Column:
    """Text after the last '/', NULL when the value is NULL, empty, or ends in '/'."""
    return F.nullif(F.substring_index(F.nullif(_c(value), F.lit("")), "/", -1), F.lit(""))


def review_id(raw_id, *fallback_parts) -> Column:
    """Last path segment of the id, else a content hash that is stable under retry."""
    parts = [F.coalesce(_c(p).cast("string"), F.lit("")) for p in fallback_parts]
    return F.coalesce(url_last_segment(raw_id), F.sha2(F.concat_ws("\u0001", *parts), 256))


def scoring_text(title, body) -> Column:
    """'{title}. {body}' - the text a label scorer sees."""
    return F.concat(_c(title), F.lit(". "), _c(body))


def corpus_text(title, body) -> Column:
    """'title body' - the text for polarity and the corpus."""
    return F.concat_ws(" ", _c(title), _c(body))


def strip_ws(value) -> Column:
    """Remove leading/trailing whitespace of any kind (trim strips spaces only)."""
    return F.regexp_replace(_c(value), r"^\s+|\s+$", "")


def normalise_label(value, legacy: bool = False) -> Column:
    """strip + lower; a failed answer (NULL, empty, 'unknown', 'error') -> 'unknown'.

    ``legacy=True`` is the older rule: only a failed call (NULL) becomes
    'unknown'; empty or 'error' answers are kept as given."""
    v = F.lower(strip_ws(_c(value)))
    failed = v.isNull() if legacy else (v.isNull() | v.isin(*FAILED_LABELS))
    return F.when(failed, F.lit("unknown")).otherwise(v)


def off_list(label, allowed: list[str]) -> Column:
    """True when a normalised label is neither 'unknown' nor in the allowed set."""
    return ~(_c(label).isin(*allowed) | (_c(label) == F.lit("unknown")))


def company_slug(company) -> Column:
    """File/partition name of a company: spaces to '_', lower case."""
    return F.lower(F.replace(_c(company), F.lit(" "), F.lit("_")))


def age_band(age) -> Column:
    """[18,35) -> '18-35', [35,60) -> '35-60', [60,inf) -> '60+', else NULL."""
    a = _c(age)
    return (F.when((a >= 18) & (a < 35), F.lit("18-35"))
             .when((a >= 35) & (a < 60), F.lit("35-60"))
             .when(a >= 60, F.lit("60+")))


def page_from_url(url) -> Column:
    """Page number from a '?page=N' / '&page=N' query parameter, NULL if absent."""
    m = F.regexp_extract(_c(url), r"[?&]page=([0-9]+)", 1)
    return F.nullif(m, F.lit("")).try_cast("int")


def html_title(html) -> Column:
    """Text inside the first <title> element (empty string when there is none)."""
    return F.regexp_extract(_c(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
