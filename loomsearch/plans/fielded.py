"""Queries over fields of pages: weighted scoring, feedback, query understanding, static quality and features.

The address of a page is its path and the markup its content. All fields are analysed as code, so that SQL can express
the results; prose and extracted fields are covered by tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.functions.oracle import tokens_cte
from loomsearch.operators import explain, features, feedback, fields, index, quality, query, ranking
from loomsearch.plans.lexical import FIELD_TOKENS, field_tokens, rounded, table, texts

TEXTS = ["blog index example version", "m.ththth.example.net/en"]
K = 10


def _pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("path"), "html")


def _setup(spark, sf_dir):
    queries = query.queries_of(spark, TEXTS)
    intents = queries.select("query_id", query.intent(F.col("query")).alias("intent"))
    return queries, intents, query.query_terms(queries)


def _query_postings(spark, sf_dir, terms: DataFrame):
    return fields.query_base_postings(_pages(spark, sf_dir), "doc_id", "path", "html", terms)


def _fielded_rank(spark, sf_dir, intents):
    """A ranking function `(terms, k) -> (query_id, doc_id, rank, score)` over the fields of pages."""
    n = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))

    def rank(terms: DataFrame, k: int) -> DataFrame:
        by_field, lengths = _query_postings(spark, sf_dir, terms)
        averages = index.field_averages(lengths, n)
        scores = ranking.bm25f(terms, intents, by_field, lengths, averages, n)
        return ranking.top_k(rounded(scores, "score"), k)

    return rank


def _seed_postings(spark, sf_dir):
    """Postings of the few pages that come first."""
    return lambda seeds: index.field_frequencies(field_tokens(spark, sf_dir, seeds))


def bm25f(spark, sf_dir):
    _, intents, terms = _setup(spark, sf_dir)
    return _fielded_rank(spark, sf_dir, intents)(terms, K).select("query_id", "rank", "doc_id", "score")


def feedback_terms(spark, sf_dir):
    _, intents, terms = _setup(spark, sf_dir)
    seeds = _fielded_rank(spark, sf_dir, intents)(terms, 3).select("query_id", "doc_id").persist()
    found = feedback.feedback_terms(seeds, _seed_postings(spark, sf_dir)(seeds), terms)
    return rounded(found, "weight").select("query_id", "term", "weight", F.array_join("source_fields", " ").alias("source_fields"))


def rank_with_feedback(spark, sf_dir):
    _, intents, terms = _setup(spark, sf_dir)
    found = feedback.rank_with_feedback(_fielded_rank(spark, sf_dir, intents), terms, _seed_postings(spark, sf_dir), K)
    return found.select("query_id", "rank", "doc_id", "score")


def intent(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    return turns.select("conv_id", "turn", query.intent(F.col("text")).alias("intent"))


def expansion(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return query.expanded_terms(turns, query.query_terms(turns))


def quality_signals(spark, sf_dir):
    return quality.with_quality(_pages(spark, sf_dir), "path", "html").select("doc_id", *quality.SIGNALS)


def static_prior(spark, sf_dir):
    return rounded(quality.with_quality(_pages(spark, sf_dir), "path", "html").select("doc_id", "static_prior"), "static_prior")


def bm25f_prior(spark, sf_dir):
    """The first results with the static prior added to the score, as ranked search does."""
    _, intents, terms = _setup(spark, sf_dir)
    by_field, lengths = _query_postings(spark, sf_dir, terms)
    n = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    scores = rounded(ranking.bm25f(terms, intents, by_field, lengths, index.field_averages(lengths, n), n), "score")
    full = ranking.add_scores(scores, static_prior(spark, sf_dir), ["doc_id"], "static_prior")
    return ranking.top_k(rounded(full, "score"), K).select("query_id", "rank", "doc_id", "score")


def _explained(spark, sf_dir):
    """`(parts, postings by field, field weights by query)` of the first ten results."""
    _, intents, terms = _setup(spark, sf_dir)
    n = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    by_field, lengths = _query_postings(spark, sf_dir, terms)
    parts = explain.bm25f_terms(terms, intents, by_field, lengths, index.field_averages(lengths, n), n)
    best = ranking.top_k(rounded(parts.groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("score")), "score"), K).select("query_id", "doc_id")
    weights = intents.join(F.broadcast(ranking.intent_weights(spark)), "intent").select("query_id", "field", "fw")
    return parts.join(best, ["query_id", "doc_id"], "left_semi"), by_field, weights


def explain_bm25f(spark, sf_dir):
    return rounded(_explained(spark, sf_dir)[0].select("query_id", "doc_id", "term", "tf", "df", "idf", "contribution"), "idf", "contribution")


def explain_fields(spark, sf_dir):
    """Each term's contribution by field."""
    split = explain.field_contributions(*_explained(spark, sf_dir))
    return rounded(split.select("query_id", "doc_id", "term", "field", "field_tf", "field_weight", "field_contribution"), "field_weight", "field_contribution")


def explain_static(spark, sf_dir):
    """The static prior of all pages by signal."""
    return rounded(explain.static_contributions(quality.with_quality(_pages(spark, sf_dir), "path", "html")), "contribution")


def ltr_features(spark, sf_dir):
    """Every feature of the ranked pages as a row of its own; pages of the first address in order are judged."""
    queries, intents, terms = _setup(spark, sf_dir)
    ranked = _fielded_rank(spark, sf_dir, intents)(terms, K).persist()
    docs = quality.with_quality(_pages(spark, sf_dir), "path", "html").drop("html")
    judged = spark.createDataFrame([("q2", "https://m.ththth.example.net/en/25#top", 1)], "query_id string, path string, relevance int")
    by_field, _ = _query_postings(spark, sf_dir, terms)
    rows = features.feature_rows(ranked, queries.join(intents, "query_id"), terms, by_field, docs, judged)
    return rows.select("query_id", "query_intent", "doc_path", "rank", "relevance", F.explode("features").alias("feature", "value")).withColumn("value", F.round("value", 6))


def heuristic_fields(spark, sf_dir):
    """Comments and string literals of pages by the language-independent scanners."""
    return fields.parsed_fields(_pages(spark, sf_dir), "doc_id", "path", "html", heuristics_only=True).select("doc_id", "field", "n", "text")


QUERIES = {f.__name__: f for f in (bm25f, feedback_terms, rank_with_feedback, intent, expansion, quality_signals, static_prior, bm25f_prior, explain_bm25f, explain_fields, explain_static, ltr_features, heuristic_fields)}


def _values(name: str, cols: str, rows) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE"
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


_INTENTS = _values("qi", "query_id, intent", [("q1", "natural_language"), ("q2", "path")])
_TERMS = _values("q", "query_id, term, w", [("q1", t, 1.0) for t in ("blog", "index", "example", "version")] + [("q2", t, 1.0) for t in ("m", "ththth", "example", "net", "en")])
_FW = _values("fw", "intent, field, fw", [(i, f, ranking.FIELD_WEIGHTS[f] * x) for f, xs in ranking.INTENT_FACTORS.items() for i, x in zip(ranking.INTENTS, xs)])
_SIGNAL = _values("sig", "field, signal", list(feedback.SIGNAL.items()))
_INDEX = f"""{FIELD_TOKENS}, {_INTENTS}, {_FW},
pf AS (SELECT doc_id, field, term, count(*) AS tf FROM ft JOIN fielded USING (k) GROUP BY ALL),
len AS (SELECT doc_id, field, sum(tf) AS length FROM pf GROUP BY ALL),
n AS (SELECT count(*) AS n FROM pages), av AS (SELECT field, sum(length) / any_value(n) AS av FROM len, n GROUP BY field),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM pf GROUP BY term)"""


def _ranked(terms: str, name: str, k: int) -> str:
    return f"""{name}_w AS (SELECT query_id, doc_id, term, any_value(w) AS w, sum(fw * tf / (0.25 + 0.75 * length / av)) AS wtf FROM {terms} JOIN pf USING (term) JOIN qi USING (query_id) JOIN fw USING (intent, field) JOIN len USING (doc_id, field) JOIN av USING (field) GROUP BY query_id, doc_id, term),
{name}_s AS (SELECT query_id, doc_id, round(sum(w * ln((n + 1) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2)), 6) AS score FROM {name}_w JOIN df USING (term), n GROUP BY query_id, doc_id),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {k})"""


_FEEDBACK = f"""{_INDEX}, {_TERMS}, {_SIGNAL}, {_ranked("q", "seeds", 3)},
per AS (SELECT query_id, term, doc_id, sum(coalesce(signal, 0) * tf) AS w, sum(tf) AS tf, list(field) FILTER (signal > 0) AS fields FROM pf JOIN seeds USING (doc_id) LEFT JOIN sig USING (field) GROUP BY ALL),
summed AS (SELECT query_id, term, sum(w * tf) AS w, list_sort(list_distinct(flatten(list(fields)))) AS fields FROM per p WHERE w > 0 AND NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = p.query_id AND q.term = p.term) GROUP BY ALL),
ns AS (SELECT query_id, count(*) AS ns FROM seeds GROUP BY query_id),
weighted AS (SELECT query_id, term, least(w / ns, 0.45) AS weight, array_to_string(fields, ' ') AS source_fields FROM summed JOIN ns USING (query_id)),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS i FROM weighted) WHERE i <= 6)"""

_INTENT_SQL = r"""CASE WHEN regexp_matches(lower(q), 'cargo\.toml|package\.json|config|setting|env') OR contains(q, '=') OR (contains(q, ':') AND NOT regexp_matches(q, '\s')) THEN 'config'
  WHEN regexp_matches(q, '[/\\]') OR regexp_matches(lower(q), '\.(?:rs|toml|json|yaml|yml)$') THEN 'path'
  WHEN contains(q, '"') OR regexp_matches(lower(q), 'error:|panic|failed to|exception|not found') OR (len(list_filter(string_split_regex(q, '\s+'), lambda w: w <> '')) >= 6 AND regexp_matches(q, '[:''`()]')) THEN 'error_message'
  WHEN regexp_matches(q, '^[A-Za-z0-9_-]+$') AND regexp_matches(q, '[_A-Z-]') THEN 'identifier' ELSE 'natural_language' END"""
_QUALITY = r"""
paths AS (SELECT page_id AS doc_id, url, replace(url, '\', '/') AS p, string_split_regex(html, '\r?\n') AS l, strlen(html) AS size FROM pages),
named AS (SELECT *, lower(p) AS norm, lower(regexp_extract(p, '[^/]*$')) AS name, list_transform(l, lambda x: ltrim(x)) AS t FROM paths),
quality AS (SELECT doc_id, url, greatest(len(list_filter(string_split(p, '/'), lambda x: x NOT IN ('', '.', '..'))) - 1, 0) AS file_depth, size AS file_size_bytes,
  regexp_matches(norm, '/generated/|/gen/|\.generated\.rs$|\.pb\.go$|\.pb\.rs$') OR len(list_filter(l[1:8], lambda x: contains(lower(x), 'generated'))) > 0 AS "generated",
  regexp_matches(norm, '(?:^|/)(?:vendor|node_modules|third_party|target|dist|build)/') AS vendor,
  regexp_matches(norm, '/tests/|/test/') OR regexp_matches(name, '^test_|_test\.rs$|_test\.go$|\.test\.ts$|\.spec\.ts$') AS test,
  name IN ('main.rs', 'lib.rs', 'mod.rs', 'main.py', 'index.ts', 'index.js', 'main.go') AS entry_point, name IN ('readme', 'readme.md') AS readme,
  name IN ('cargo.toml', 'pyproject.toml', 'package.json', 'tsconfig.json', 'dockerfile', 'makefile', 'justfile', 'readme.md') OR regexp_matches(name, '\.(?:yaml|yml|toml|json)$') AS config_or_manifest,
  len(list_filter(t[1:80], lambda x: regexp_matches(x, '^(?:pub fn main|fn main|pub mod |pub struct |pub enum |export |def main)'))) > 0 AS public_entry_point,
  len(list_filter(t, lambda x: regexp_matches(x, '^(?:use |pub use |pub mod |mod |import |from |#include |require\()'))) AS reference_count FROM named),
prior AS (SELECT *, CASE WHEN "generated" THEN -0.55 ELSE 0 END + CASE WHEN vendor THEN -0.45 ELSE 0 END + CASE WHEN test THEN -0.08 ELSE 0 END + CASE WHEN entry_point THEN 0.28 ELSE 0 END
  + CASE WHEN readme THEN 0.22 ELSE 0 END + CASE WHEN config_or_manifest THEN 0.20 ELSE 0 END + CASE WHEN public_entry_point THEN 0.12 ELSE 0 END
  + CASE WHEN file_depth <= 1 THEN 0.10 WHEN file_depth = 2 THEN 0.04 WHEN file_depth <= 5 THEN 0 ELSE -0.08 END
  + CASE WHEN file_size_bytes > 750000 THEN -0.18 WHEN file_size_bytes > 250000 THEN -0.08 ELSE 0 END + 0.015 * least(reference_count, 12) AS static_prior FROM quality)"""
_SIGNALS = ", ".join(f'"{s}"' for s in quality.SIGNALS)
_STATIC = " UNION ALL ".join(f"SELECT doc_id, 'static.{s}' AS feature, \"{s}\"::DOUBLE AS value FROM prior" for s in quality.SIGNALS)

_PRIOR_PARTS = {
    **{k: f'CASE WHEN "{k}" THEN {w} ELSE 0 END' for k, w in quality.PRIOR.items()},
    "file_depth": "CASE WHEN file_depth <= 1 THEN 0.10 WHEN file_depth = 2 THEN 0.04 WHEN file_depth <= 5 THEN 0 ELSE -0.08 END",
    "file_size_bytes": "CASE WHEN file_size_bytes > 750000 THEN -0.18 WHEN file_size_bytes > 250000 THEN -0.08 ELSE 0 END",
    "reference_count": "0.015 * least(reference_count, 12)",
}
_EXPLAINED = f"""{_INDEX}, {_TERMS}, {_ranked("q", "best", K)},
tfs AS (SELECT doc_id, term, sum(tf)::BIGINT AS tf FROM pf GROUP BY ALL),
parts AS (SELECT query_id, doc_id, term, tf, df, ln((n + 1) / (df + 0.5)) AS idf, w * ln((n + 1) / (df + 0.5)) * wtf * 2.2 / (wtf + 1.2) AS contribution FROM best_w JOIN tfs USING (doc_id, term) JOIN df USING (term), n WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM best))"""

ORACLES = {
    "bm25f_prior": f"""{_INDEX}, {_TERMS}, {_ranked("q", "best", K)}, {_QUALITY}, full_s AS (SELECT query_id, doc_id, round(score + round(static_prior, 6)::DOUBLE, 6) AS score FROM best_s JOIN prior USING (doc_id))
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM full_s) WHERE rank <= {K}""",
    "explain_bm25f": f"{_EXPLAINED} SELECT query_id, doc_id, term, tf, df, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM parts",
    "explain_fields": f"{_EXPLAINED} SELECT query_id, doc_id, term, field, pf.tf AS field_tf, round(fw, 6) AS field_weight, round(contribution * pf.tf / parts.tf, 6) AS field_contribution FROM parts JOIN pf USING (doc_id, term) JOIN qi USING (query_id) JOIN fw USING (intent, field)",
    "explain_static": f"WITH {_QUALITY} " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS signal, round({v}, 6)::DOUBLE AS contribution FROM quality" for k, v in _PRIOR_PARTS.items()),
    "bm25f": f"{_INDEX}, {_TERMS}, {_ranked('q', 'best', K)} SELECT query_id, rank, doc_id, score FROM best",
    "feedback_terms": f"{_FEEDBACK} SELECT query_id, term, round(weight, 6) AS weight, source_fields FROM found",
    "rank_with_feedback": f"{_FEEDBACK}, wide AS (SELECT * FROM q UNION ALL SELECT query_id, term, weight FROM found), {_ranked('wide', 'best', K)} SELECT query_id, rank, doc_id, score FROM best",
    "intent": f"SELECT conv_id, turn, {_INTENT_SQL} AS intent FROM (SELECT conv_id, turn, trim(text) AS q FROM conversations WHERE role = 'user')",
    "expansion": f"""WITH turns AS (SELECT conv_id || '-' || turn AS query_id, text, trim(text) AS q FROM conversations WHERE role = 'user'), {tokens_cte("turns", "query_id", "text", "qt")},
base AS (SELECT query_id, term, count(*) AS frequency FROM qt GROUP BY ALL), {_values("ex", "term, long", [(a, b) for a, bs in query.EXPANSIONS.items() for b in bs])},
added AS (SELECT DISTINCT query_id, long AS term FROM base JOIN ex USING (term) JOIN turns USING (query_id) WHERE {_INTENT_SQL} IN ('natural_language', 'error_message', 'config'))
SELECT query_id, term, coalesce(frequency, 1)::INT AS frequency, coalesce(frequency, 0) + CASE WHEN a.term IS NULL THEN 0 ELSE 0.35 END::DOUBLE AS weight, CASE WHEN frequency IS NULL THEN 'controlled_expansion' ELSE 'original' END AS provenance
FROM base FULL JOIN added a USING (query_id, term)""",
    "quality_signals": f"WITH {_QUALITY} SELECT doc_id, {_SIGNALS} FROM quality",
    "static_prior": f"WITH {_QUALITY} SELECT doc_id, round(static_prior, 6)::DOUBLE AS static_prior FROM prior",
    "ltr_features": f"""{_INDEX}, {_TERMS}, {_ranked("q", "best", K)}, {_QUALITY}, {_values("texts", "query_id, query", [(f"q{i}", t) for i, t in enumerate(TEXTS, 1)])},
names AS (SELECT unnest([{", ".join(f"'{f}'" for f in fields.FIELDS)}]) AS field),
hits AS (SELECT query_id, doc_id, field, sum(tf) AS m FROM pf JOIN q USING (term) GROUP BY ALL),
values_of AS (
  SELECT query_id, doc_id, 'ranking_score' AS feature, score AS value FROM best
  UNION ALL SELECT query_id, doc_id, feature, value FROM best JOIN ({_STATIC} UNION ALL SELECT doc_id, 'static.static_prior_score', static_prior::DOUBLE FROM prior) USING (doc_id)
  UNION ALL SELECT query_id, doc_id, 'field_match.' || field, coalesce(m, 0)::DOUBLE FROM best CROSS JOIN names LEFT JOIN hits USING (query_id, doc_id, field)
  UNION ALL SELECT query_id, b.doc_id, 'path_exact_contains_query', CASE WHEN contains(lower(url), lower(query)) THEN 1 ELSE 0 END FROM best b JOIN texts USING (query_id) JOIN paths USING (doc_id)
  UNION ALL SELECT query_id, b.doc_id, 'filename_exact_contains_query', CASE WHEN contains(lower(regexp_extract(url, '[^/]*$')), lower(query)) THEN 1 ELSE 0 END FROM best b JOIN texts USING (query_id) JOIN paths USING (doc_id)
  UNION ALL SELECT query_id, doc_id, unnest(['expansion.controlled_terms', 'expansion.feedback_terms', 'regex.literal_evidence']), 0 FROM best)
SELECT query_id, intent AS query_intent, url AS doc_path, rank, CASE WHEN query_id = 'q2' AND url = 'https://m.ththth.example.net/en/25#top' THEN 1 END::INT AS relevance, feature, round(value, 6) AS value
FROM values_of JOIN best USING (query_id, doc_id) JOIN qi USING (query_id) JOIN paths USING (doc_id)""",
}
