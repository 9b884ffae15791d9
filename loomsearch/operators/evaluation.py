"""Retrieval metrics over ranked results and judgments, for all queries in one plan.

`ranked(query_id, path, rank)` ranks from 1; `judged(query_id, path, relevant)`; `queries(query_id, ...)` names every
query, so that one without results or judgments counts with zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsearch.functions import text

METRICS = ["precision_at_k", "recall_at_k", "mean_average_precision", "mean_reciprocal_rank", "normalized_discounted_cumulative_gain"]
GATED = METRICS[1:]
MANY_RELEVANT = ("conceptual",)


def per_query(queries: DataFrame, ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """`(query_id, k, metrics...)`; precision divides by k, all is 0 without relevant documents or with k = 0."""
    relevant = judged.where("relevant").select("query_id", "path").distinct()
    total = relevant.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = ranked.where(F.col("rank") <= k).join(relevant.withColumn("hit", F.lit(1)), ["query_id", "path"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    per = hits.withColumn("so_far", F.sum("hit").over(seen)).groupBy("query_id").agg(
        F.sum("hit").alias("hits"),
        F.sum(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    rows = queries.select("query_id").join(total, "query_id", "left").join(per, "query_id", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("total"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    ok = (F.coalesce("total", F.lit(0)) > 0) & F.lit(k > 0) & F.col("hits").isNotNull()
    zero = lambda c: F.when(ok, c).otherwise(0.0)
    return rows.select(
        "query_id",
        F.lit(k).alias("k"),
        zero(F.col("hits") / F.lit(max(k, 1))).alias(METRICS[0]),
        zero(F.col("hits") / F.col("total")).alias(METRICS[1]),
        zero(F.col("ap") / F.col("total")).alias(METRICS[2]),
        zero(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias(METRICS[3]),
        zero(F.col("dcg") / ideal).alias(METRICS[4]),
    )


def aggregate(evaluations: DataFrame) -> DataFrame:
    """The mean of each metric, and the largest k."""
    return evaluations.agg(F.max("k").alias("k"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS])


def slices(evaluations: DataFrame, shapes: DataFrame) -> DataFrame:
    """`(query_shape, family, queries, metrics...)` by shape of query."""
    family = F.when(F.col("query_shape").isin(*MANY_RELEVANT), "many_relevant_documents").otherwise("top_document")
    by = evaluations.join(shapes, "query_id").groupBy("query_shape").agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in METRICS])
    return by.withColumn("family", family)


def groundedness(queries: DataFrame, ranked: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """Counts and ratios of evidence in the first k results.

    `evidence(query_id, path, relevant, start_line, end_line, snippet)`; evidence is the same if path, lines and snippet are.
    """
    span = ["query_id", "path", "start_line", "end_line", "snippet"]
    expected = evidence.where("relevant").select(*span).distinct()
    top = ranked.where(F.col("rank") <= k).select("query_id", "path").distinct()
    cited = evidence.join(top, ["query_id", "path"], "left_semi").select(*span).distinct()
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    citing = top.join(evidence.select("query_id", "path").distinct(), ["query_id", "path"], "left_semi")
    grounded = citing.join(expected.select("query_id", "path").distinct(), ["query_id", "path"], "left_semi")
    rows = queries.select("query_id")
    names = ["expected_evidence", "cited_evidence", "matching_evidence", "grounded_citations", "total_citations"]
    for df, name in zip((expected, cited, cited.intersect(expected), grounded, citing), names):
        rows = rows.join(count(df, name), "query_id", "left")
    none = F.coalesce("expected_evidence", F.lit(0)) == 0
    rows = rows.select("query_id", *[F.when(none, 0).otherwise(F.coalesce(n, F.lit(0))).cast("bigint").alias(n) for n in names])
    return with_groundedness_ratios(rows)


def with_groundedness_ratios(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "highlight_recall": text.safe_ratio(F.col("matching_evidence"), F.col("expected_evidence")),
        "highlight_precision": text.safe_ratio(F.col("matching_evidence"), F.col("cited_evidence")),
        "citation_precision": text.safe_ratio(F.col("grounded_citations"), F.col("total_citations")),
    })


def total_groundedness(rows: DataFrame) -> DataFrame:
    """Ratios of the summed counts."""
    names = ["expected_evidence", "cited_evidence", "matching_evidence", "grounded_citations", "total_citations"]
    return with_groundedness_ratios(rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]))


def token_efficiency(queries: DataFrame, ranked: DataFrame, evidence: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """`(query_id, returned_bytes, evidence_bytes, density, returned_tokens, evidence_tokens)`; `sizes(path, bytes)`."""
    top = ranked.where(F.col("rank") <= k).join(sizes, "path").select("query_id", "path", "bytes")
    returned = top.groupBy("query_id").agg(F.sum("bytes").alias("returned_bytes"))
    proof = evidence.where("relevant").join(top.select("query_id", "path").distinct(), ["query_id", "path"], "left_semi").groupBy("query_id").agg(F.sum(F.octet_length("snippet")).alias("evidence_bytes"))
    rows = queries.select("query_id").join(returned, "query_id", "left").join(proof, "query_id", "left").fillna(0)
    return with_density(rows)


def with_density(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "density": text.safe_ratio(F.col("evidence_bytes"), F.col("returned_bytes")),
        "returned_tokens": text.estimated_tokens(F.col("returned_bytes")),
        "evidence_tokens": text.estimated_tokens(F.col("evidence_bytes")),
    })


def total_token_efficiency(rows: DataFrame) -> DataFrame:
    return with_density(rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("returned_bytes", "evidence_bytes")]))


def report_delta(baseline: DataFrame, current: DataFrame, key: str = "query_id") -> DataFrame:
    """`(key, metric, baseline, current, delta)` of what both reports have; a delta under 1e-12 is 0."""
    long = lambda df, name: df.dropDuplicates([key]).select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(name)) for m in METRICS])).alias("m")).select(key, "m.*")
    both = long(baseline, "baseline").join(long(current, "current"), [key, "metric"])
    d = F.col("current") - F.col("baseline")
    return both.withColumn("delta", F.when(F.abs(d) < 1e-12, 0.0).otherwise(d))


def regressions(delta: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Gated metrics that fell by more than the threshold; precision isn't gated."""
    return delta.where(F.col("metric").isin(*GATED) & (F.col("delta") < -threshold))


class RegressionError(RuntimeError):
    pass


def gate(delta: DataFrame, threshold: float = 0.0, key: str = "query_id") -> None:
    """Raises if a gated metric fell by more than the threshold."""
    if threshold < 0:
        raise ValueError("the threshold isn't negative")
    worst = regressions(delta, threshold).orderBy("delta").select(key, "metric", "delta").take(5)
    if worst:
        raise RegressionError("; ".join(f"{r[0]}: {r[1]} {r[2]:+.4f}" for r in worst))


def report(queries: DataFrame, ranked: DataFrame, judged: DataFrame, evidence: DataFrame, sizes: DataFrame, k: int) -> dict[str, DataFrame]:
    """All parts of an evaluation by name. `queries` has `query_shape`."""
    each = per_query(queries, ranked, judged, k)
    grounded, tokens = groundedness(queries, ranked, evidence, k), token_efficiency(queries, ranked, evidence, sizes, k)
    return {
        "queries": each, "aggregate": aggregate(each), "slices": slices(each, queries.select("query_id", "query_shape")), "groundedness": grounded,
        "groundedness_total": total_groundedness(grounded), "token_efficiency": tokens, "token_efficiency_total": total_token_efficiency(tokens),
    }
