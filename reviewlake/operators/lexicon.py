"""Dictionary-driven text labels: polarity, sentiment, text rating, topics,
mentions, aspects, emotions, products.

Every label is computed in the review's own row: the tokens are filtered once to
those that some dictionary knows (a hash-set lookup), and each weight or topic is a
count over the few that are left.  No token becomes a row, nothing is grouped
by id, so reviews that share an id (two companies, a rerun, a page captured
twice) are never merged, doubled or lost, and only the small final
aggregates shuffle.

A dictionary is a bounded table: a ``Dictionary`` or a DataFrame with the same
columns, which ``D.as_dictionary`` reads up to its bound.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import dictionaries as D
from reviewlake.functions import text as T

NO_STRINGS = "array<string>"


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _among(terms: Iterable[str]):
    terms = tuple(terms)
    return lambda t: t.isin(*terms)


def with_counts(reviews: DataFrame, text_col, groups: dict[str, Iterable[str]]) -> DataFrame:
    """``reviews`` with one BIGINT column per group: how many tokens are among its terms.

    The hits are materialised in their own projection, so the tokenizer runs once.
    """
    groups = {name: sorted(set(terms)) for name, terms in groups.items()}
    known = sorted(set().union(*groups.values()) if groups else ())
    hits = _free(reviews, "_hits")
    found = F.filter(T.tokens(text_col), _among(known)) if known else F.array()
    staged = reviews.withColumn(hits, F.coalesce(found.cast(NO_STRINGS), F.array().cast(NO_STRINGS)))
    counts = [F.size(F.filter(F.col(hits), _among(terms))).cast("bigint").alias(name)
              for name, terms in groups.items()]
    return staged.select(*[F.col(f"`{c}`") for c in reviews.columns], *counts)


def _total(parts: list[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for p in parts:
        out = out + p
    return out.cast("bigint")


def _by_weight(rows: Iterable[tuple[str, int]], prefix: str) -> tuple[dict[str, list[str]], dict[str, tuple[int, int, int]]]:
    """Terms grouped by (sum of weights, sum of absolute weights, rows): the groups and their values."""
    per: dict[str, list[int]] = {}
    for term, w in rows:
        per.setdefault(term, []).append(w)
    groups: dict[tuple[int, int, int], list[str]] = {}
    for term, ws in per.items():
        groups.setdefault((sum(ws), sum(map(abs, ws)), len(ws)), []).append(term)
    names = {f"{prefix}{i}": key for i, key in enumerate(sorted(groups))}
    return {n: groups[key] for n, key in names.items()}, names


def with_scores(reviews: DataFrame, text_col, lexicon=D.LEXICON_EN, taxonomy=None) -> DataFrame:
    """``reviews`` with polarity, magnitude and hits and, given a taxonomy, topic, topic_score and topic_scores."""
    lex = D.as_dictionary(lexicon)
    groups, weights = _by_weight(((r[0], r[1]) for r in lex.rows), "_w")
    topics: list[tuple[int, str]] = []
    topic_weights: dict[str, dict[str, tuple[int, int, int]]] = {}
    if taxonomy is not None:
        tax = D.as_dictionary(taxonomy)
        topics = sorted({(r[1], r[0]) for r in tax.rows})
        for k, (_, topic) in enumerate(topics):
            g, w = _by_weight(((r[2], r[3]) for r in tax.rows if r[0] == topic), f"_t{k}_")
            groups |= g
            topic_weights[topic] = w
    cols = [F.col(f"`{c}`") for c in reviews.columns]
    counted = with_counts(reviews, text_col, groups)
    out = [_total([F.lit(v[i]) * F.col(n) for n, v in weights.items()]).alias(name)
           for i, name in enumerate(("polarity", "magnitude", "hits"))]
    if topics:
        score = {t: _total([F.lit(v[0]) * F.col(n) for n, v in topic_weights[t].items()]) for _, t in topics}
        # arg-max: largest score, then smallest order -> encode the order as negative
        best = F.greatest(*[F.struct(score[t].alias("score"), F.lit(-o).alias("neg_order"), F.lit(t).alias("topic"))
                            for o, t in topics]) if len(topics) > 1 else F.struct(
            score[topics[0][1]].alias("score"), F.lit(-topics[0][0]).alias("neg_order"), F.lit(topics[0][1]).alias("topic"))
        out += [F.when(best["score"] > 0, best["topic"]).otherwise(F.lit("unknown")).alias("topic"),
                best["score"].alias("topic_score"), F.array(*[score[t] for _, t in topics]).alias("topic_scores")]
    return counted.select(*cols, *out)


def polarity(spark: SparkSession, reviews: DataFrame, text_col, keys: list[str],
             lexicon=D.LEXICON_EN) -> DataFrame:
    """Per review (row): keys, polarity (sum of integer weights), magnitude, hits."""
    staged = reviews.select(*keys, _text(text_col).alias("_text"))
    return with_scores(staged, "_text", lexicon).drop("_text")


def _text(text_col) -> Column:
    return F.col(text_col) if isinstance(text_col, str) else text_col


def sentiment_from_polarity(p) -> F.Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p > 0, F.lit("positive")).when(p < 0, F.lit("negative"))
             .otherwise(F.lit("neutral")))


def text_rating_from_polarity(pol, mag) -> F.Column:
    """1.000-5.000: 3 + 2 * (net weight / total weight); 3.000 with no hits."""
    pol = F.col(pol) if isinstance(pol, str) else pol
    mag = F.col(mag) if isinstance(mag, str) else mag
    share = F.when(mag > 0, pol.cast("double") / mag.cast("double")).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.lit(3.0) + F.lit(2.0) * share)), 3)


def sentiment_pct(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Percent of reviews with polarity > 0 and < 0; neutral counts in the total.

    Empty input gives NULL percentages rather than a division error.
    """
    total = F.nullif(F.count(F.lit(1)), F.lit(0)).cast("double")
    aggs = [
        (F.lit(100.0) * F.count_if(F.col("polarity") > 0) / total).alias("pct_positive"),
        (F.lit(100.0) * F.count_if(F.col("polarity") < 0) / total).alias("pct_negative"),
        F.count(F.lit(1)).alias("total"),
    ]
    return scored.groupBy(*(group or [])).agg(*aggs)


def classify_topics(spark: SparkSession, reviews: DataFrame, text_col, keys: list[str],
                    taxonomy=D.TAXONOMY_FIVE_EN) -> DataFrame:
    """Single-label topic per review: highest keyword-weight sum; ties by topic order;
    'unknown' when no keyword hits.  Also returns the per-topic scores."""
    staged = reviews.select(*keys, _text(text_col).alias("_text"))
    none = D.Dictionary("none", "term string, weight int", ())
    return with_scores(staged, "_text", none, taxonomy).select(*keys, "topic", "topic_score", "topic_scores")


def _by_label(rows: Iterable[tuple], label: int = 0, term: int = 1) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r[label], []).append(r[term])
    return out


def _labels_long(counted: DataFrame, keep: list[str], labels: list[str], label_col: str) -> DataFrame:
    """One row per (review, label) with hits, from the count columns ``_l0.._ln``."""
    long = counted.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(lab).alias(label_col), F.col(f"_l{i}").alias("hits")) for i, lab in enumerate(labels)])))
    return long.where(F.col("hits") > 0)


def labels_hit(spark: SparkSession, reviews: DataFrame, text_col, keys: list[str],
               pairs, label_col: str) -> DataFrame:
    """Per (review, label): number of keyword hits, only where hits > 0."""
    by = _by_label(D.as_dictionary(pairs).rows)
    labels = sorted(by)
    staged = reviews.select(*keys, _text(text_col).alias("_text"))
    counted = with_counts(staged, "_text", {f"_l{i}": by[lab] for i, lab in enumerate(labels)})
    return _labels_long(counted, keys, labels, label_col)


def services(spark: SparkSession, reviews: DataFrame, text_col, keys: list[str], pairs) -> DataFrame:
    """Per review with at least one hit: its labels, sorted and joined by commas."""
    by = _by_label(D.as_dictionary(pairs).rows)
    labels = sorted(by)
    staged = reviews.select(*keys, _text(text_col).alias("_text"))
    counted = with_counts(staged, "_text", {f"_l{i}": by[lab] for i, lab in enumerate(labels)})
    named = F.concat_ws(",", *[F.when(F.col(f"_l{i}") > 0, F.lit(lab)) for i, lab in enumerate(labels)])
    return counted.select(*keys, named.alias("services")).where(F.col("services") != "")


def label_hits_with_polarity(spark: SparkSession, reviews: DataFrame, text_col, keys: list[str],
                             lexicon, pairs, label_col: str) -> DataFrame:
    """Per (review, label) with at least one keyword hit: hits and the review's polarity."""
    by = _by_label(D.as_dictionary(pairs).rows)
    labels = sorted(by)
    staged = reviews.select(*keys, _text(text_col).alias("_text"))
    lex_groups, weights = _by_weight(((r[0], r[1]) for r in D.as_dictionary(lexicon).rows), "_w")
    counted = with_counts(staged, "_text", lex_groups | {f"_l{i}": by[lab] for i, lab in enumerate(labels)})
    pol = _total([F.lit(v[0]) * F.col(n) for n, v in weights.items()])
    return _labels_long(counted.withColumn("polarity", pol), [*keys, "polarity"], labels, label_col)


def _gram_at(toks, n: int):
    def at(i):
        return F.concat_ws(" ", *[F.element_at(toks, i + k) for k in range(n)])
    return at


def _starts_with(toks, words: list[str]):
    def keep(i):
        return F.element_at(toks, i).isin(*words)
    return keep


def phrase_hits(toks: Column, phrases: list[str]) -> Column:
    """Occurrences of the phrases in a token array, as an array of phrases.

    n-grams are only built at positions whose token can start a phrase of that length.
    """
    by_n: dict[int, list[str]] = {}
    for p in phrases:
        by_n.setdefault(len(p.split(" ")), []).append(p)
    parts = []
    for n, of_n in sorted(by_n.items()):
        if n == 1:
            parts.append(F.filter(toks, _among(of_n)))
            continue
        first = sorted({p.split(" ")[0] for p in of_n})
        idx = F.sequence(F.lit(1), F.greatest(F.size(toks) - F.lit(n - 1), F.lit(1)))
        idx = F.filter(idx, _starts_with(toks, first))
        grams = F.filter(F.transform(idx, _gram_at(toks, n)), _among(of_n))
        parts.append(F.when(F.size(toks) >= n, grams).otherwise(F.array().cast(NO_STRINGS)))
    return F.concat(*parts)


def mention_counts(spark: SparkSession, reviews: DataFrame, text_col, keys: list[str],
                   phrases=D.PHRASES_EN) -> DataFrame:
    """Per category: phrase hits and number of reviews (rows) mentioning it."""
    by = _by_label(D.as_dictionary(phrases).rows)
    labels = sorted(by)
    toks = F.coalesce(T.tokens(text_col), F.array().cast(NO_STRINGS))
    staged = reviews.select(toks.alias("_toks"))
    found = staged.select(phrase_hits(F.col("_toks"), sorted({p for ps in by.values() for p in ps})).alias("_hits"))
    counted = found.select(*[F.size(F.filter("_hits", _among(by[lab]))).cast("bigint")
                             .alias(f"_l{i}") for i, lab in enumerate(labels)])
    return _labels_long(counted, [], labels, "category").groupBy("category").agg(
        F.sum("hits").cast("bigint").alias("mentions"), F.count(F.lit(1)).alias("reviews_mentioning"))
