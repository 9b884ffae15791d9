"""Snapshots, judgments and line-based records."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
SHAPES = ["conceptual", "configuration", "error_message", "identifier", "navigational", "path", "regex", "test_finding"]
JUDGMENTS = """repo string, repo_path string, commit string, local_root string, examples array<struct<query:string, narrative:string, query_shape:string,
 results:array<struct<path:string, content:string, relevant:boolean, rank:int, evidence:array<struct<start_line:int, end_line:int, snippet:string>>>>>>"""
FEATURES = "kind string, query_id string, query string, query_intent string, doc_path string, rank int, relevance int, features map<string,double>, expansion_provenance map<string,string>, preferred_doc string, dispreferred_doc string, preferred_relevance int, dispreferred_relevance int"


class SnapshotMismatch(ValueError):
    """A snapshot was made by another version, with other settings or from another folder."""


def config_hash(n_grams: int = 1, stop_words: list[str] | tuple = (), stemmer: str = "porter2", fielded: bool = True, gitignore: bool = True) -> str:
    """Of everything that changes what an index holds."""
    if n_grams < 1:
        raise ValueError("n_grams is at least 1")
    plain = json.dumps([n_grams, sorted(stop_words), stemmer, fielded, gitignore])
    return hashlib.sha256(plain.encode()).hexdigest()


def write_snapshot(folder: str, tables: dict[str, DataFrame], root: str, config: str) -> None:
    """Tables as Parquet; postings are sorted by term, so that a look-up reads few row groups. The metadata come last."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if "term" in df.columns:
            df = df.repartitionByRange("term").sortWithinPartitions(*[c for c in ("term", "doc_id") if c in df.columns])
        elif "gram" in df.columns:
            df = df.repartitionByRange("gram").sortWithinPartitions("gram", "doc_id")
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    meta = spark.createDataFrame([(VERSION, config, root, datetime.now(UTC).replace(tzinfo=None), sorted(tables))], "version int, config string, root string, created timestamp, tables array<string>")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/metadata")


def load_snapshot(spark: SparkSession, folder: str, root: str, config: str) -> dict[str, DataFrame]:
    """Checks version, settings and source folder in this order, then gives the tables."""
    meta = spark.read.parquet(f"{folder}/metadata").first()
    for what, found, wanted in (("version", meta["version"], VERSION), ("settings", meta["config"], config), ("source folder", meta["root"], root)):
        if found != wanted:
            raise SnapshotMismatch(f"{what}: the snapshot has {found}, not {wanted}")
    return {name: spark.read.parquet(f"{folder}/{name}") for name in meta["tables"]}


def snapshot_exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(f"{folder}/metadata")
    except AnalysisException:
        return False
    return True


def replace_snapshot(folder: str, tables: dict[str, DataFrame], root: str, config: str) -> None:
    """Writes the next snapshot beside the present one, which its tables may read, and then puts it in its place."""
    spark = next(iter(tables.values())).sparkSession
    write_snapshot(f"{folder}.next", tables, root, config)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path(folder), True)
    fs.rename(path(f"{folder}.next"), path(folder))
    spark.catalog.refreshByPath(folder)  # what was kept of the tables before is no longer theirs


def read_repository(spark: SparkSession, path: str) -> tuple[str, str]:
    """`(repository, commit)` that a judgments file names."""
    r = spark.read.schema(JUDGMENTS).option("multiLine", True).json(path).select(F.coalesce("repo_path", "repo").alias("repo"), "commit").first()
    return r["repo"], r["commit"]


def postings_of(tables: dict[str, DataFrame], term: str) -> DataFrame:
    """Postings of one term; the filter reaches the Parquet scan."""
    return tables["postings"].where(F.col("term") == term)


def lexicon_entry(tables: dict[str, DataFrame], term: str) -> DataFrame:
    """`(term, df, cf)`."""
    return postings_of(tables, term).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lexicon_size(tables: dict[str, DataFrame]) -> int:
    return tables["postings"].select("term").distinct().count()


def read_judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`queries(query_id, query, query_shape)`, `judged(query_id, path, relevance)` and `evidence` of a judgments file.

    Queries are numbered q1, q2, ... in file order. An unknown shape, and a relevant result without a rank, are errors
    when the rows are read.
    """
    raw = spark.read.schema(JUDGMENTS).option("multiLine", True).json(path)
    each = raw.select(F.posexplode("examples").alias("i", "e")).select(F.format_string("q%d", F.col("i") + 1).alias("query_id"), "e.*")
    known = F.coalesce("query_shape", F.lit("conceptual"))
    queries = each.select("query_id", "query", F.when(known.isin(*SHAPES), known).otherwise(F.raise_error(F.concat(F.lit("unknown query shape: "), known))).alias("query_shape"))
    results = each.select("query_id", F.explode("results").alias("r")).select("query_id", "r.*")
    rank = F.when(F.col("rank").isNotNull(), F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("relevant without rank: "), F.col("path"))).cast("int"))
    judged = results.where("relevant").select("query_id", "path", rank.alias("relevance"))
    evidence = results.select("query_id", "path", "relevant", F.explode("evidence").alias("e")).select("query_id", "path", "relevant", "e.*")
    return queries, judged, evidence


def write_features(rows: DataFrame, preferences: DataFrame, folder: str) -> None:
    """JSON lines, a record of either kind on each; features come first."""
    a, b = rows.withColumn("kind", F.lit("feature")), preferences.withColumn("kind", F.lit("pairwise_preference"))
    a.unionByName(b, allowMissingColumns=True).write.mode("overwrite").json(folder)


def read_features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.schema(FEATURES).json(folder)
    pair = ["query_id", "preferred_doc", "dispreferred_doc", "preferred_relevance", "dispreferred_relevance"]
    return raw.where("kind = 'feature'").drop("kind", *pair[1:]), raw.where("kind = 'pairwise_preference'").select(*pair)


def log_query(spark: SparkSession, folder: str, query: str, results: int) -> None:
    """Appends one line to the query log."""
    spark.createDataFrame([(datetime.now(UTC).replace(tzinfo=None), query, results)], "at timestamp, query string, results int").coalesce(1).write.mode("append").json(folder)


def read_baseline(spark: SparkSession, path: str) -> dict:
    """A report of an earlier run: `{"aggregate": {...}, "queries": [...]}`, or a flat object of aggregate metrics."""
    found = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return found if "aggregate" in found else {"aggregate": found, "queries": []}
