"""Command line: `python -m loomsearch.cli [options] [QUERY | regex PATTERN]`.

Modes, the first that applies: `regex PATTERN`, `--evaluate`, `--stats`, a query, and lines from standard input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.operators import evaluation, explain, features, feedback, index, quality, query, ranking, regex_search
from loomsearch.sources import corpus, tables
from loomsearch.streaming import event_log, maintenance

FIELDED = ("bm25f", "bm25_proximity")


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="loomsearch")
    p.add_argument("-d", "--directory", default=".")
    p.add_argument("-n", "--n-grams", type=int, default=1)
    p.add_argument("-r", "--ranking-algorithm", default="bm25-proximity", choices=sorted(ranking.NAMES))
    p.add_argument("-t", "--top-n", type=int, default=10)
    p.add_argument("-e", "--evaluate", action="store_true")
    p.add_argument("--eval-format", default="pretty", choices=["pretty", "json"])
    p.add_argument("--eval-compare")
    p.add_argument("--eval-regression-threshold", type=float, default=0.0)
    p.add_argument("--eval-data", default="./data/train.json")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--query-expansion", action="store_true")
    p.add_argument("--feedback-expansion", action="store_true")
    p.add_argument("--export-features")
    p.add_argument("--index-dir")
    p.add_argument("--eval-workdir")
    p.add_argument("--fresh", action="store_true")
    p.add_argument("--explain", action="store_true")
    p.add_argument("--query-log")
    p.add_argument("--reindex", action="store_true")
    p.add_argument("--no-respect-gitignore", dest="respect_gitignore", action="store_false")
    p.add_argument("words", nargs="*")
    found = p.parse_args(args)
    if found.n_grams < 1:
        p.error("--n-grams is at least 1")
    return found


class Search:
    """An index and the settings it is searched with. Fielded algorithms read code, the flat ones windows of prose terms."""

    def __init__(self, docs: DataFrame, algorithm: str = "bm25-proximity", expand: bool = False, feed_back: bool = False, n_grams: int = 1, tokens: DataFrame | None = None):
        self.algorithm, self.expand, self.feed_back, self.n_grams = ranking.NAMES[algorithm], expand, feed_back, n_grams
        self.fielded = self.algorithm in FIELDED
        self.docs = quality.with_quality(docs, "path", "content").drop("content")
        self.tokens = maintenance.tokens_of(docs, self.fielded, n_grams) if tokens is None else tokens

    def terms(self, queries: DataFrame) -> DataFrame:
        if not self.fielded:
            return query.prose_terms(queries, self.n_grams)
        found = query.query_terms(queries)
        return query.expanded_terms(queries, found) if self.expand else found

    def explained(self, queries: DataFrame, ranked: DataFrame) -> DataFrame:
        """Ranked rows with the parts of their scores: terms, fields, static signals and positions."""
        terms = self.terms(queries)
        by_field, lengths = index.query_field_postings(self.tokens, terms)
        n = self.docs.agg(F.count("*").alias("n"))
        weights = positional = None
        if self.algorithm == "bm25f":
            intents = queries.select("query_id", query.intent(F.col("query")).alias("intent"))
            parts = explain.bm25f_terms(terms, intents, by_field, lengths, index.field_averages(lengths, n), n)
            weights = intents.join(F.broadcast(ranking.intent_weights(queries.sparkSession)), "intent").select("query_id", "field", "fw")
        else:
            posts, stats = self._flat(by_field, lengths)
            parts = (explain.bm25_terms if self.algorithm in ("bm25", "bm25_proximity") else explain.matched_terms)(terms, posts, stats)
        if self.algorithm == "bm25_proximity":
            positional = self._positional(terms, queries)
        return explain.ranked_explanations(ranked, parts, by_field, self.docs, weights, positional)

    def _flat(self, by_field: DataFrame, lengths: DataFrame) -> tuple[DataFrame, ranking.Stats]:
        total = self.docs.select("doc_id").join(lengths.groupBy("doc_id").agg(F.sum("length").alias("length")), "doc_id", "left").fillna(0, ["length"])
        return by_field.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")), ranking.Stats(total)

    def _positional(self, terms: DataFrame, queries: DataFrame) -> DataFrame:
        each = self.tokens.select("doc_id", "field", F.posexplode("tokens").alias("pos", "term")).join(terms.select("term").distinct(), "term", "left_semi")
        return ranking.positional_bonus(each, terms, query.phrases(queries))

    def scored(self, terms: DataFrame, queries: DataFrame) -> DataFrame:
        by_field, lengths = index.query_field_postings(self.tokens, terms)
        posts, stats = self._flat(by_field, lengths)
        if self.algorithm == "bm25f":
            n = self.docs.agg(F.count("*").alias("n"))
            intents = queries.select("query_id", query.intent(F.col("query")).alias("intent"))
            scores = ranking.bm25f(terms, intents, by_field, lengths, index.field_averages(lengths, n), n)
        elif self.algorithm in ("ql_dirichlet", "ql_jm"):
            vocabulary = self.tokens.select(F.explode("tokens").alias("t")).distinct().agg(F.count("*").alias("vocabulary"))
            scores = ranking.query_likelihood(terms, posts, stats, vocabulary, 1500.0 if self.algorithm == "ql_dirichlet" else None)
        elif self.algorithm == "cosine":
            every = index.field_frequencies(self.tokens).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))
            scores = ranking.cosine(terms, posts, stats, index.doc_norms(every, stats.lengths, "doc_id"))
        else:
            scores = (ranking.tfidf if self.algorithm == "tfidf" else ranking.bm25)(terms, posts, stats)
        if self.algorithm == "bm25_proximity":
            scores = ranking.add_scores(scores, self._positional(terms, queries), ["query_id", "doc_id"], "bonus")
        return scores

    def rank(self, queries: DataFrame, k: int) -> DataFrame:
        """`(query_id, doc_id, path, score, rank)` with the static prior added before the cut; ties go by path."""

        def once(terms: DataFrame, n: int) -> DataFrame:
            full = self.scored(terms, queries).join(self.docs.select("doc_id", "path", "static_prior"), "doc_id")
            full = full.select("query_id", "doc_id", "path", F.round(F.col("score") + F.col("static_prior"), 9).alias("score")).withColumn("_order", ranking.path_order(F.col("path")))
            return ranking.top_k(full, n, "_order").drop("_order")

        terms = self.terms(queries)
        if not self.feed_back:
            return once(terms, k)
        seeds_of = lambda seeds: index.field_frequencies(self.tokens.join(seeds.select("doc_id").distinct(), "doc_id", "left_semi"))
        return feedback.rank_with_feedback(once, terms, seeds_of, k)

    def features(self, queries: DataFrame, ranked: DataFrame, judged: DataFrame) -> DataFrame:
        terms = self.terms(queries)
        intents = queries.withColumn("intent", query.intent(F.col("query")))
        by_field, _ = index.query_field_postings(self.tokens, terms)
        return features.feature_rows(ranked.drop("path"), intents.select("query_id", "query", "intent"), terms, by_field, self.docs, judged)


def prepare(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Tables of the index: `docs` with `tokens`, or with `grams` for patterns.

    They come from the snapshot if there is a fitting one; changes in its log are applied to it, and it is written
    anew. Otherwise, they are built and written. Fielded and flat tokens, and trigrams, have a snapshot each.
    """
    fresh = lambda: corpus.scan(spark, a.directory, a.respect_gitignore)[0]
    patterns, fielded = a.words[:1] == ["regex"], ranking.NAMES[a.ranking_algorithm] in FIELDED and not a.stats
    kind = "grams" if patterns else "fielded" if fielded else "flat"

    def made(docs: DataFrame) -> dict[str, DataFrame]:
        extra = {"grams": regex_search.trigram_postings(docs, "doc_id", "content")} if patterns else {"tokens": maintenance.tokens_of(docs, fielded, a.n_grams)}
        return {"docs": docs} | extra

    if not a.index_dir:
        return made(fresh()) if not patterns else {"docs": fresh()}
    config = tables.config_hash(a.n_grams, fielded=fielded, gitignore=a.respect_gitignore)
    place, log = f"{a.index_dir}/{kind}/snapshot", f"{a.index_dir}/{kind}/events"
    if not a.reindex and tables.snapshot_exists(spark, place):
        held = tables.load_snapshot(spark, place, a.directory, config)
        events = event_log.read_events(spark, log)
        if events.isEmpty():
            return held
        now = fresh()
        if patterns:
            docs = maintenance.apply(maintenance.Version(held["docs"], maintenance.tokens_of(held["docs"].limit(0), False)), events, now, False).docs
            gone = held["docs"].select("doc_id", "path", F.xxhash64("content").alias("h")).join(docs.select("doc_id", F.xxhash64("content").alias("h")), ["doc_id", "h"], "left_anti")
            new = docs.join(held["docs"].select("doc_id", F.xxhash64("content").alias("_h")), "doc_id", "left").where("_h is null or _h <> xxhash64(content)").drop("_h")
            nxt = {"docs": docs, "grams": regex_search.refresh(held["grams"], new, gone, "doc_id", "content")}
        else:
            version = maintenance.apply(maintenance.Version(held["docs"], held["tokens"]), events, now, fielded, a.n_grams)
            nxt = {"docs": version.docs, "tokens": version.tokens}
        tables.replace_snapshot(place, nxt, a.directory, config)
        event_log.clear_events(spark, log)
        return tables.load_snapshot(spark, place, a.directory, config)
    tables.write_snapshot(place, made(fresh()), a.directory, config)
    event_log.clear_events(spark, log)
    return tables.load_snapshot(spark, place, a.directory, config)


def evaluate(spark: SparkSession, a: argparse.Namespace, search: Search) -> int:
    queries, judged, evidence = tables.read_judgments(spark, a.eval_data)
    ranked = search.rank(queries, a.top_n).persist()
    sizes = search.docs.select("path", F.col("file_size_bytes").alias("bytes"))
    report = evaluation.report(queries, ranked, judged.withColumn("relevant", F.lit(True)), evidence, sizes, a.top_n)
    whole = {"aggregate": report["aggregate"].first().asDict(), "queries": [r.asDict() for r in report["queries"].join(queries, "query_id").collect()], "slices": [r.asDict() for r in report["slices"].collect()]}
    if a.eval_format == "json":
        print(json.dumps(whole, indent=1))
    else:
        for k, v in whole["aggregate"].items():
            print(f"{k}: {v:.4f}")
    if a.export_features:
        tables.write_features(search.features(queries, ranked, judged), features.pairwise_preferences(judged), a.export_features)
    if a.eval_compare:
        before = tables.read_baseline(spark, a.eval_compare)["aggregate"]
        now = whole["aggregate"]
        worse = [f"{m}: {now[m] - before[m]:+.4f}" for m in evaluation.GATED if m in before and now[m] - before[m] < -a.eval_regression_threshold]
        if worse:
            print("regressions: " + "; ".join(worse), file=sys.stderr)
            return 1
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments(args)
    spark = spark or SparkSession.builder.appName("loomsearch").getOrCreate()
    if a.eval_workdir:
        a.directory = corpus.clone(*tables.read_repository(spark, a.eval_data), a.eval_workdir, a.fresh)
    held = prepare(spark, a)
    docs = held["docs"]
    if a.words[:1] == ["regex"]:
        found = regex_search.search_regex(docs, "doc_id", "content", " ".join(a.words[1:]), held.get("grams")).join(docs.select("doc_id", "path"), "doc_id")
        for r in found.orderBy(F.split("path", "/"), "byte_start").toLocalIterator():
            print(f"{r['path']}:{r['line_start']}-{r['line_end']}:{r['byte_start']}..{r['byte_end']}: {r['matched_text']}")
        return 0
    if a.stats:
        posts = index.field_frequencies(held["tokens"]).select("doc_id", "term", "tf")
        lengths = docs.select("doc_id").join(held["tokens"].select("doc_id", F.size("tokens").cast("bigint").alias("length")), "doc_id")
        print(json.dumps(index.corpus_stats(posts, lengths, "doc_id").first().asDict(), indent=1))
        for r in index.top_terms(posts, "doc_id", a.top_n).collect():
            print(f"{r['term']} cf={r['cf']} df={r['df']}")
        return 0
    search = Search(docs, a.ranking_algorithm, a.query_expansion, a.feedback_expansion, a.n_grams, held["tokens"])
    if a.evaluate:
        return evaluate(spark, a, search)
    for line in [" ".join(a.words)] if a.words else sys.stdin:
        if line.strip() in ("exit", "quit"):
            break
        if line.strip():
            queries = query.queries_of(spark, [line.strip()])
            found = search.rank(queries, a.top_n)
            rows = (search.explained(queries, found) if a.explain else found).orderBy("rank").collect()
            for r in rows:
                print(f"{r['path']} score={r['score']:.4f}")
                if a.explain:
                    parts = [f"{t['term']} {t['contribution']:+.4f}" for t in r["terms"] or []] + [f"{t['signal']} {t['contribution']:+.4f}" for t in r["static"] or [] if t["contribution"]]
                    print("  " + ", ".join([*parts, f"positions {r['positional']:+.4f}"]))
            if a.query_log:
                tables.log_query(spark, a.query_log, line.strip(), len(rows))
    return 0


if __name__ == "__main__":
    sys.exit(main())
