"""Features for learning to rank, and preferences between judged documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.operators import fields, quality


def field_matches(terms: DataFrame, by_field: DataFrame) -> DataFrame:
    """`(query_id, doc_id, field, matches)`: occurrences of the query's terms in each field."""
    hits = by_field.join(terms.select("query_id", "term"), "term")
    return hits.groupBy("query_id", "doc_id", "field").agg(F.sum("tf").alias("matches"))


def feature_rows(ranked: DataFrame, queries: DataFrame, terms: DataFrame, by_field: DataFrame, docs: DataFrame, judged: DataFrame) -> DataFrame:
    """`(query_id, query, query_intent, doc_path, rank, relevance, features, expansion_provenance)`.

    `ranked(query_id, doc_id, rank, score)`, `queries(query_id, query, intent)`, `docs(doc_id, path, quality signals,
    static_prior)`, `judged(query_id, path, relevance)`.
    """
    counts = field_matches(terms, by_field).groupBy("query_id", "doc_id").pivot("field", fields.FIELDS).agg(F.first("matches")).withColumnsRenamed({f: f"_{f}_matches" for f in fields.FIELDS})
    provenance = terms.groupBy("query_id").agg(
        F.count_if(F.col("provenance") == "controlled_expansion").cast("double").alias("n_controlled"),
        F.count_if(F.col("provenance") == "feedback").cast("double").alias("n_feedback"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("provenance") != "original", F.struct("term", "provenance"))))).alias("expansion_provenance"),
    )
    rows = ranked.join(docs, "doc_id").join(queries, "query_id").join(counts, ["query_id", "doc_id"], "left").join(provenance, "query_id", "left")
    named = judged.select(F.col("query_id").alias("_query"), F.col("path").alias("_path"), "relevance")
    rows = rows.join(named, (F.col("path") == F.col("_path")) & (F.col("query_id") == F.col("_query")), "left")
    features = F.map_concat(
        F.create_map(F.lit("ranking_score"), F.col("score")),
        F.map_from_entries(F.transform(F.map_entries(quality.feature_map({k: F.col(k) for k in quality.SIGNALS}, F.col("static_prior"))), lambda e: F.struct(F.concat(F.lit("static."), e["key"]).alias("key"), e["value"].alias("value")))),
        F.create_map(*[x for f in fields.FIELDS for x in (F.lit(f"field_match.{f}"), F.coalesce(F.col(f"_{f}_matches"), F.lit(0)).cast("double"))]),
        F.create_map(
            F.lit("path_exact_contains_query"), text.contains_normalized(F.col("path"), F.col("query")),
            F.lit("filename_exact_contains_query"), text.contains_normalized(text.file_name(F.col("path")), F.col("query")),
            F.lit("expansion.controlled_terms"), F.coalesce("n_controlled", F.lit(0.0)),
            F.lit("expansion.feedback_terms"), F.coalesce("n_feedback", F.lit(0.0)),
            F.lit("regex.literal_evidence"), F.lit(0.0),
        ),
    )
    return rows.select("query_id", "query", F.col("intent").alias("query_intent"), F.col("path").alias("doc_path"), "rank", "relevance", features.alias("features"), "expansion_provenance")


def pairwise_preferences(judged: DataFrame) -> DataFrame:
    """All pairs of relevant documents of a query with different ranks, the smaller rank preferred."""
    a = judged.select("query_id", F.col("path").alias("preferred_doc"), F.col("relevance").alias("preferred_relevance"))
    b = judged.select("query_id", F.col("path").alias("dispreferred_doc"), F.col("relevance").alias("dispreferred_relevance"))
    return a.join(b, "query_id").where("preferred_relevance < dispreferred_relevance")
