"""Query understanding: intent, terms, phrases and controlled expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.operators import index

EXPANSIONS = {
    "db": ["database"], "auth": ["authentication", "authorization"], "cfg": ["configuration"], "config": ["configuration"], "repo": ["repository"],
    "err": ["error"], "msg": ["message"], "req": ["request"], "res": ["response", "result"],
}
EXPANSION_WEIGHT = 0.35
EXPANDING = ("natural_language", "error_message", "config")


def intent(query: Column) -> Column:
    """config, path, error_message, identifier or natural_language; the first that fits."""
    q = F.trim(query)
    low = F.lower(q)
    config = low.rlike(r"cargo\.toml|package\.json|config|setting|env") | F.contains(q, F.lit("=")) | (F.contains(q, F.lit(":")) & ~q.rlike(r"\s"))
    path = q.rlike(r"[/\\]") | low.rlike(r"\.(?:rs|toml|json|yaml|yml)$")
    error = F.contains(q, F.lit('"')) | low.rlike(r"error:|panic|failed to|exception|not found") | ((F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) >= 6) & q.rlike(r"[:'`()]"))
    identifier = q.rlike("^[A-Za-z0-9_-]+$") & q.rlike("[_A-Z-]")
    return F.when(config, "config").when(path, "path").when(error, "error_message").when(identifier, "identifier").otherwise("natural_language")


def allows_expansion(kind: Column) -> Column:
    return kind.isin(*EXPANDING)


def queries_of(spark: SparkSession, texts: list[str]) -> DataFrame:
    """`(query_id, query)` numbered q1, q2, ..."""
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts, 1)], "query_id string, query string")


def query_terms(queries: DataFrame, key: str = "query_id", content: str = "query") -> DataFrame:
    """`(query_id, term, frequency, weight, provenance)` by the code analyser; a term's weight is its frequency."""
    each = queries.select(F.col(key).alias("query_id"), F.explode(text.code_tokens(F.col(content))).alias("term"))
    counted = each.groupBy("query_id", "term").agg(F.count("*").cast("int").alias("frequency"))
    return counted.select("query_id", "term", "frequency", F.col("frequency").cast("double").alias("weight"), F.lit("original").alias("provenance"))


def prose_terms(queries: DataFrame, n: int = 1, key: str = "query_id", content: str = "query") -> DataFrame:
    """Like `query_terms` for a flat index: windows of `n` terms of the prose analyser."""
    tokens = index.with_prose_tokens(queries.select(F.col(key).alias("query_id"), F.coalesce(content, F.lit("")).alias("text")), F.col("text"))
    counted = tokens.select("query_id", F.explode(text.word_ngrams(F.col("tokens"), n)).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("int").alias("frequency"))
    return counted.select("query_id", "term", "frequency", F.col("frequency").cast("double").alias("weight"), F.lit("original").alias("provenance"))


def terms_from_weights(spark: SparkSession, weights: dict[str, float], query_id: str = "q1") -> DataFrame:
    """Direct construction; terms without positive weight are dropped."""
    return spark.createDataFrame([(query_id, t, 1, float(w), "original") for t, w in weights.items() if w > 0], "query_id string, term string, frequency int, weight double, provenance string")


def phrases(queries: DataFrame, key: str = "query_id", content: str = "query") -> DataFrame:
    """`(query_id, phrase_id, n_terms, offset, term)` of quoted phrases with more than one token."""
    quoted = F.regexp_extract_all(F.col(content), F.lit('"([^"]*)"'), F.lit(1))
    each = queries.select(F.col(key).alias("query_id"), F.posexplode(quoted).alias("phrase_id", "phrase")).withColumn("tokens", text.code_tokens(F.col("phrase")))
    long = each.where(F.size("tokens") > 1)
    return long.select("query_id", "phrase_id", F.size("tokens").alias("n_terms"), F.posexplode("tokens").alias("offset", "term"))


def merge_terms(terms: DataFrame, added: DataFrame) -> DataFrame:
    """Terms that are there get the added weight and keep their provenance; new ones have frequency 1."""
    both = terms.select("*", F.lit(0).alias("order")).unionByName(added.select("query_id", "term", F.lit(1).alias("frequency"), "weight", "provenance", F.lit(1).alias("order")))
    return both.groupBy("query_id", "term").agg(F.min_by("frequency", "order").alias("frequency"), F.sum("weight").alias("weight"), F.min_by("provenance", "order").alias("provenance")).where("weight > 0")


def expanded_terms(queries: DataFrame, terms: DataFrame, key: str = "query_id", content: str = "query") -> DataFrame:
    """Terms with their controlled expansions, for queries whose intent allows it."""
    spark = terms.sparkSession
    table = spark.createDataFrame([(a, b) for a, bs in EXPANSIONS.items() for b in bs], "term string, long string")
    open_ = queries.where(allows_expansion(intent(F.col(content)))).select(F.col(key).alias("query_id"))
    found = terms.join(open_, "query_id").join(F.broadcast(table), "term").select("query_id", F.col("long").alias("term")).distinct()
    return merge_terms(terms, found.select("query_id", "term", F.lit(EXPANSION_WEIGHT).alias("weight"), F.lit("controlled_expansion").alias("provenance")))
