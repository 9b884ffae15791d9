"""Explanations: how a document came by its score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.operators import quality, ranking
from loomsearch.operators.index import idf


def bm25_terms(terms: DataFrame, posts: DataFrame, stats: ranking.Stats, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`(query_id, doc_id, term, tf, df, idf, contribution)`: the rows whose sum is the score."""
    rows = ranking.matched(terms, posts, stats).withColumn("idf", idf(F.col("n"), F.col("df")))
    return rows.select("query_id", "doc_id", "term", "tf", "df", "idf", ranking.bm25_part(k1, b).alias("contribution"))


def bm25f_terms(*args, **options) -> DataFrame:
    return ranking.bm25f_terms(*args, **options).withColumnRenamed("score", "contribution")


def matched_terms(terms: DataFrame, posts: DataFrame, stats: ranking.Stats) -> DataFrame:
    """For scores that aren't sums over terms: which terms matched, with contribution 0."""
    return bm25_terms(terms, posts, stats).withColumn("contribution", F.lit(0.0))


def field_contributions(explained: DataFrame, by_field: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """A term's contribution split over fields by frequency; `weights(query_id, field, fw)` adds the field's weight."""
    split = explained.join(by_field.select("term", "doc_id", "field", F.col("tf").alias("field_tf")), ["term", "doc_id"])
    split = split.withColumn("field_contribution", F.col("contribution") * F.col("field_tf") / F.col("tf"))
    if weights is None:
        return split.withColumn("field_weight", F.lit(1.0))
    return split.join(weights, ["query_id", "field"], "left").withColumn("field_weight", F.coalesce("fw", F.lit(1.0))).drop("fw")


def static_contributions(docs: DataFrame) -> DataFrame:
    """`(doc_id, signal, contribution)` of documents with quality signals; their sum is the prior."""
    parts = quality.prior({k: F.col(k) for k in quality.SIGNALS})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), v.cast("double").alias("contribution")) for k, v in parts.items()])).alias("e")
    return docs.select("doc_id", each).select("doc_id", "e.signal", "e.contribution")


def ranked_explanations(ranked: DataFrame, explained: DataFrame, by_field: DataFrame, docs: DataFrame, weights: DataFrame | None = None, positional: DataFrame | None = None) -> DataFrame:
    """`explanations` of ranked documents, with a list of field parts too: `(term, field, field_tf, field_weight, field_contribution)`."""
    best = ranked.select("query_id", "doc_id").distinct()
    parts = explained.join(best, ["query_id", "doc_id"], "left_semi")
    split = field_contributions(parts, by_field, weights)
    fields_of = split.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "field", "field_tf", "field_weight", "field_contribution"))).alias("fields"))
    full = explanations(ranked, parts, static_contributions(docs.join(best.select("doc_id").distinct(), "doc_id", "left_semi")), positional)
    return full.join(fields_of, ["query_id", "doc_id"], "left")


def explanations(ranked: DataFrame, explained: DataFrame, static: DataFrame, positional: DataFrame | None = None) -> DataFrame:
    """Ranked rows with arrays of term and static parts, and the positional bonus, so that the parts add up to the score."""
    by_term = explained.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf", "df", "idf", "contribution"))).alias("terms"))
    by_signal = static.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("signal", "contribution"))).alias("static"))
    out = ranked.join(by_term, ["query_id", "doc_id"], "left").join(by_signal, "doc_id", "left")
    if positional is None:
        return out.withColumn("positional", F.lit(0.0))
    return out.join(positional.withColumnRenamed("bonus", "positional"), ["query_id", "doc_id"], "left").fillna(0.0, ["positional"])
