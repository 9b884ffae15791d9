"""Ranked retrieval. Every scorer takes query terms and postings of any number of queries and scores them in one plan.

Whether query terms are broadcast is left to Spark's check of their size; only single rows and fixed tables carry a hint.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.operators.index import idf

FIELD_WEIGHTS = {
    "filename": 8.0, "path": 4.0, "extension": 0.25, "content": 1.0, "identifiers": 3.0, "symbols": 4.0, "imports": 2.0, "comments": 0.8,
    "string_literals": 0.8, "frontmatter": 1.2,
}
INTENTS = ["path", "identifier", "error_message", "config", "natural_language"]
INTENT_FACTORS = {
    "filename": (1.5, 1.15, 0.7, 1.5, 0.8), "path": (2.2, 1.1, 0.7, 1.8, 0.8), "extension": (1.4, 0.8, 0.7, 1.7, 0.8), "content": (0.45, 0.75, 1.25, 0.9, 1.1),
    "identifiers": (0.6, 1.7, 0.7, 1.25, 0.9), "symbols": (0.6, 1.8, 1.1, 1.0, 0.9), "imports": (0.6, 1.1, 0.7, 1.0, 0.9), "comments": (0.6, 0.8, 0.9, 0.8, 1.35),
    "string_literals": (0.6, 0.8, 2.0, 0.8, 0.8), "frontmatter": (0.6, 0.8, 0.7, 1.8, 1.2),
}
POSITIONAL_FIELDS = ["content", "identifiers", "comments", "string_literals"]
NAMES = {
    "cosim": "cosine", "bm25": "bm25", "bm25f": "bm25f", "bm25-proximity": "bm25_proximity", "proximity": "bm25_proximity", "ql": "ql_dirichlet",
    "ql-dirichlet": "ql_dirichlet", "query-likelihood": "ql_dirichlet", "ql-jm": "ql_jm", "jelinek-mercer": "ql_jm", "tfidf": "tfidf",
}
TINY = 2.2250738585072014e-308


@dataclass
class Stats:
    """`lengths(doc_id, length)` and, made of it, one row `(n, total, avgdl)`."""

    lengths: DataFrame
    totals: DataFrame = field(init=False)

    def __post_init__(self):
        self.totals = self.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("total")).withColumn("avgdl", text.safe_ratio(F.col("total"), F.col("n")))


def matched(terms: DataFrame, posts: DataFrame, stats: Stats) -> DataFrame:
    """Query terms with their postings, document frequency, lengths and totals."""
    hits = posts.join(terms, "term")
    dfs = posts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return hits.join(dfs, "term").join(stats.lengths, "doc_id").crossJoin(F.broadcast(stats.totals))


def _sum(rows: DataFrame, value: Column) -> DataFrame:
    return rows.withColumn("part", value).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def bm25_part(k1: float, b: float) -> Column:
    tf, wide = F.col("tf"), F.col("length") / F.col("avgdl")
    return F.when((tf > 0) & (F.col("avgdl") > 0), F.col("weight") * idf(F.col("n"), F.col("df")) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * wide))).otherwise(0.0)


def bm25(terms: DataFrame, posts: DataFrame, stats: Stats, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`(query_id, doc_id, score)`."""
    return _sum(matched(terms, posts, stats), bm25_part(k1, b))


def tfidf(terms: DataFrame, posts: DataFrame, stats: Stats) -> DataFrame:
    return _sum(matched(terms, posts, stats), F.col("weight") * F.col("tf") / F.col("length") * idf(F.col("n"), F.col("df")))


def cosine(terms: DataFrame, posts: DataFrame, stats: Stats, norms: DataFrame) -> DataFrame:
    """Terms that no document has count in the query's norm."""
    dfs = posts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    own = terms.join(dfs, "term", "left").crossJoin(F.broadcast(stats.totals)).withColumn("w", F.col("weight") * idf(F.col("n"), F.coalesce("df", F.lit(0))))
    qnorm = own.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qnorm"))
    i = idf(F.col("n"), F.col("df"))
    summed = _sum(matched(terms, posts, stats), F.col("weight") * F.col("tf") * i * i)
    return summed.join(norms, "doc_id").join(qnorm, "query_id").select("query_id", "doc_id", (F.col("score") / (F.col("qnorm") * F.col("norm"))).alias("score"))


def query_likelihood(terms: DataFrame, posts: DataFrame, stats: Stats, vocabulary: DataFrame, mu: float | None = 1500.0, lam: float = 0.2, k: int | None = None) -> DataFrame:
    """Dirichlet smoothing, or Jelinek-Mercer where `mu` is None. Every document is scored.

    Only documents with a term are touched by name: the score of a document is the sum over all terms of what it would
    be at tf = 0, which depends on its length alone, plus differences for the terms it has.

    With `k`, documents that can't be among the first k of their query are left out, so that queries and documents
    aren't crossed: without a term, a document's score falls with its length (Dirichlet) or is the same for all, so
    beside documents with a term only the k shortest, or those of smallest id, come into question.
    """
    dfs = posts.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("tf").alias("cf"))
    p = F.when(F.col("total") == 0, F.lit(TINY)).when(F.col("cf") > 0, F.col("cf") / F.col("total")).otherwise(1 / (F.col("total") + F.col("vocabulary") + 1))
    known = terms.join(dfs, "term", "left").crossJoin(F.broadcast(stats.totals.crossJoin(vocabulary))).withColumn("p", p).select("query_id", "term", "weight", "p")

    def chance(tf: Column, length: Column, pc: Column) -> Column:
        raw = (tf + mu * pc) / (length + mu) if mu is not None else (1 - lam) * text.safe_ratio(tf, length) + lam * pc
        return F.log(F.greatest(raw, F.lit(TINY)))

    each = known.groupBy("query_id").agg(F.collect_list(F.struct("weight", "p")).alias("all"))
    hits = posts.join(known, "term").join(stats.lengths, "doc_id")
    if k is None:
        pairs = stats.lengths.crossJoin(each)
    else:
        few = stats.lengths.orderBy(*(["length", "doc_id"] if mu is not None else ["doc_id"])).limit(k)
        some = hits.select("query_id", "doc_id", "length").unionByName(each.select("query_id").crossJoin(F.broadcast(few))).distinct()
        pairs = some.join(each, "query_id")
    base = pairs.select("query_id", "doc_id", F.aggregate("all", F.lit(0.0), lambda acc, t: acc + t["weight"] * chance(F.lit(0.0), F.col("length"), t["p"])).alias("part"))
    more = hits.select("query_id", "doc_id", (F.col("weight") * (chance(F.col("tf"), F.col("length"), F.col("p")) - chance(F.lit(0.0), F.col("length"), F.col("p")))).alias("part"))
    return base.unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def intent_weights(spark) -> DataFrame:
    """`(intent, field, fw)`: field weights adapted to each intent."""
    return spark.createDataFrame([(i, f, FIELD_WEIGHTS[f] * x) for f, xs in INTENT_FACTORS.items() for i, x in zip(INTENTS, xs)], "intent string, field string, fw double")


def bm25f_terms(terms: DataFrame, intents: DataFrame, by_field: DataFrame, lengths: DataFrame, averages: DataFrame, n_docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """`(query_id, doc_id, term, tf, df, idf, score)` before the sum over terms.

    `by_field(term, doc_id, field, tf)`, `lengths(doc_id, field, length)`, `averages(field, avg_length)`.
    """
    hits = by_field.join(terms, "term").join(intents, "query_id")
    dfs = by_field.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    full = hits.join(F.broadcast(intent_weights(terms.sparkSession)), ["intent", "field"]).join(lengths, ["doc_id", "field"]).join(F.broadcast(averages), "field")
    part = F.when(F.col("avg_length") > 0, F.col("fw") * F.col("tf") / (1 - b + b * F.col("length") / F.col("avg_length"))).otherwise(0.0)
    per = full.withColumn("wtf", part).groupBy("query_id", "doc_id", "term").agg(F.sum("wtf").alias("wtf"), F.sum("tf").alias("tf"), F.first("weight").alias("weight"))
    scored = per.join(dfs, "term").crossJoin(F.broadcast(n_docs)).withColumn("idf", idf(F.col("n"), F.col("df")))
    return scored.select("query_id", "doc_id", "term", "tf", "df", "idf", (F.col("weight") * F.col("idf") * F.col("wtf") * (k1 + 1) / (F.col("wtf") + k1)).alias("score"))


def bm25f(*args, **options) -> DataFrame:
    return bm25f_terms(*args, **options).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def phrase_counts(positions: DataFrame, phrases: DataFrame) -> DataFrame:
    """`(query_id, phrase_id, doc_id, phrase_count)`: starts at which all terms of a phrase follow each other in a field.

    `positions(doc_id, field, pos, term)`, `phrases(query_id, phrase_id, n_terms, offset, term)`.
    """
    hits = positions.where(F.col("field").isin(*POSITIONAL_FIELDS)).join(phrases, "term").withColumn("start", F.col("pos") - F.col("offset"))
    starts = hits.groupBy("query_id", "phrase_id", "doc_id", "field", "start").agg(F.count_distinct("offset").alias("k"), F.first("n_terms").alias("n"))
    return starts.where("k = n").groupBy("query_id", "phrase_id", "doc_id").agg(F.count("*").alias("phrase_count"))


def cover_spans(positions: DataFrame, terms: DataFrame) -> DataFrame:
    """`(query_id, doc_id, field, span)`: least distance from first to last position that has every distinct term.

    The positions of a field are folded once, in order, with an array of the latest position of each term: wherever
    all terms have been seen, the span ends there and starts at the earliest of them.
    """
    distinct = terms.select("query_id", "term").distinct()
    numbered = distinct.withColumn("t", F.row_number().over(Window.partitionBy("query_id").orderBy("term")) - 1).withColumn("n", F.count("*").over(Window.partitionBy("query_id")).cast("int"))
    hits = positions.join(numbered, "term").groupBy("query_id", "doc_id", "field", "n").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "t"))).alias("hits"), F.count_distinct("t").alias("seen"))
    start = F.struct(F.array_repeat(F.lit(-1), F.col("n")).alias("last"), F.lit(None).cast("int").alias("span"))

    def fold(acc: Column, hit: Column) -> Column:
        last = F.transform(acc["last"], lambda x, i: F.when(i == hit["t"], hit["pos"]).otherwise(x))
        low = F.array_min(last)
        return F.struct(last.alias("last"), F.when(low >= 0, F.least(acc["span"], hit["pos"] - low)).otherwise(acc["span"]).alias("span"))

    found = hits.where(F.col("seen") == F.col("n")).select("query_id", "doc_id", "field", F.aggregate("hits", start, fold, lambda acc: acc["span"]).alias("span"))
    return found.where("span is not null")


def proximity_bonus(positions: DataFrame, terms: DataFrame, window: int = 8, boost: float = 0.75) -> DataFrame:
    """`(query_id, doc_id, bonus)`; queries of one distinct term have none."""
    several = terms.groupBy("query_id").agg(F.count_distinct("term").alias("n")).where("n >= 2").select("query_id")
    spans = cover_spans(positions.where(F.col("field").isin(*POSITIONAL_FIELDS)), terms.join(several, "query_id", "left_semi")).where(F.col("span") <= window)
    return spans.groupBy("query_id", "doc_id").agg(F.sum(boost * (window - F.col("span") + 1) / window).alias("bonus"))


def positional_bonus(positions: DataFrame, terms: DataFrame, phrases: DataFrame, phrase_boost: float = 2.0, window: int = 8, boost: float = 0.75) -> DataFrame:
    """`(query_id, doc_id, bonus)` of phrases and proximity together."""
    by_phrase = phrase_counts(positions, phrases).groupBy("query_id", "doc_id").agg((phrase_boost * F.sum("phrase_count")).alias("bonus"))
    return by_phrase.unionByName(proximity_bonus(positions, terms, window, boost)).groupBy("query_id", "doc_id").agg(F.sum("bonus").alias("bonus"))


def add_scores(scores: DataFrame, extra: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `value` of `extra` to documents that have a score already."""
    joined = scores.join(extra.select(*keys, value), keys, "left")
    return joined.withColumn("score", F.col("score") + F.coalesce(value, F.lit(0.0))).drop(value)


def top_k(scores: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """`rank` from 1 within each query: score descending, then `tie`; Spark keeps k rows a task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def path_order(path: Column) -> Column:
    """Sort key of a path by components."""
    return F.split(path, "/")
