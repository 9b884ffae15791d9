"""Pseudo-relevance feedback: terms of high-signal fields of the first results widen the query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsearch.operators import query

SIGNAL = {"filename": 0.28, "symbols": 0.24, "identifiers": 0.22, "path": 0.20, "imports": 0.14, "string_literals": 0.12}
CAP = 0.45


def feedback_terms(seeds: DataFrame, by_field: DataFrame, terms: DataFrame, k: int = 6) -> DataFrame:
    """`(query_id, term, weight, source_docs, source_fields)`: the `k` best by weight, then term.

    `seeds(query_id, doc_id)`; `by_field(term, doc_id, field, tf)`. A document adds the sum of weighted field
    frequencies times its total frequency; the sum over seeds is divided by their number and capped.
    """
    n = seeds.groupBy("query_id").agg(F.count("*").alias("n_seeds"))
    table = terms.sparkSession.createDataFrame(list(SIGNAL.items()), "field string, signal double")
    hits = by_field.join(seeds, "doc_id").join(F.broadcast(table), "field", "left")
    per = hits.groupBy("query_id", "term", "doc_id").agg(
        F.sum(F.coalesce("signal", F.lit(0.0)) * F.col("tf")).alias("w"), F.sum("tf").alias("tf"), F.collect_set(F.when(F.col("signal") > 0, F.col("field"))).alias("fields")
    )
    fresh = per.where("w > 0").join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti")
    summed = fresh.groupBy("query_id", "term").agg(F.sum(F.col("w") * F.col("tf")).alias("w"), F.sort_array(F.collect_set("doc_id")).alias("source_docs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))).alias("source_fields"))
    weighted = summed.join(n, "query_id").withColumn("weight", F.least(F.col("w") / F.col("n_seeds"), F.lit(CAP)))
    best = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")
    return weighted.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k).select("query_id", "term", "weight", "source_docs", "source_fields")


def expanded(terms: DataFrame, found: DataFrame) -> DataFrame:
    """Query terms with feedback terms merged in."""
    return query.merge_terms(terms, found.select("query_id", "term", "weight", F.lit("feedback").alias("provenance")))


def rank_with_feedback(rank: Callable[[DataFrame, int], DataFrame], terms: DataFrame, postings_of: Callable[[DataFrame], DataFrame], top_n: int = 10, n_seeds: int | None = None, n_terms: int = 6) -> DataFrame:
    """Ranks, widens the query by the first results, and ranks again.

    `rank(terms, k)` gives `(query_id, doc_id, ...)`; `postings_of(seeds)` gives `(term, doc_id, field, tf)` of these
    documents only. The few seeds are kept, as two parts of the plan need them.
    """
    seeds = rank(terms, min(top_n, 3) if n_seeds is None else n_seeds).select("query_id", "doc_id").persist()
    return rank(expanded(terms, feedback_terms(seeds, postings_of(seeds), terms, n_terms)), top_n)
