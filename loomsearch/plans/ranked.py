"""Ranked queries over documents: one scorer each, with the first ten results."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsearch.functions.oracle import tokens_cte
from loomsearch.operators import batch_ranking, explain, index, query, ranking
from loomsearch.plans.lexical import LENGTHS, TOKENS, docs, rounded, table

QUERY = "apache public license version"
PHRASED = '"general public license" version'
K = 10


def _setup(spark, sf_dir, text=QUERY):
    queries = query.queries_of(spark, [text])
    terms = query.query_terms(queries)
    posts, lengths = index.query_postings(docs(spark, sf_dir), "doc_id", terms)
    return queries, terms, posts, ranking.Stats(lengths)


def _top(scores):
    return ranking.top_k(rounded(scores, "score"), K).select("query_id", "rank", "doc_id", "score")


def bm25(spark, sf_dir):
    _, terms, posts, stats = _setup(spark, sf_dir)
    return _top(ranking.bm25(terms, posts, stats))


def tfidf(spark, sf_dir):
    _, terms, posts, stats = _setup(spark, sf_dir)
    return _top(ranking.tfidf(terms, posts, stats))


def cosine(spark, sf_dir):
    _, terms, posts, stats = _setup(spark, sf_dir)
    return _top(ranking.cosine(terms, posts, stats, index.text_norms(docs(spark, sf_dir), "doc_id", only=posts)))


def ql_dirichlet(spark, sf_dir):
    _, terms, posts, stats = _setup(spark, sf_dir, QUERY + " zzunseen")
    return _top(ranking.query_likelihood(terms, posts, stats, index.vocabulary(docs(spark, sf_dir), "doc_id"), k=K))


def ql_jm(spark, sf_dir):
    _, terms, posts, stats = _setup(spark, sf_dir, QUERY + " zzunseen")
    return _top(ranking.query_likelihood(terms, posts, stats, index.vocabulary(docs(spark, sf_dir), "doc_id"), mu=None, k=K))


def bm25_batch(spark, sf_dir):
    """Every user turn of the conversations is a query; the first three documents of each."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    terms = index.postings(turns, "query_id", "query").select("query_id", "term", F.col("tf").cast("double").alias("weight"))
    return batch_ranking.Packed(docs(spark, sf_dir), "doc_id", terms).first(3)


def _positions(spark, sf_dir, terms):
    """Positions of the query's terms only; the few that there are are kept, as phrases and spans both need them."""
    each = index.positions(docs(spark, sf_dir), "doc_id", terms=index.few_terms(terms)).withColumn("field", F.lit("content"))
    return each.join(terms.select("term").distinct(), "term", "left_semi").persist()


def phrase_count(spark, sf_dir):
    q = query.queries_of(spark, [PHRASED])
    return ranking.phrase_counts(_positions(spark, sf_dir, query.query_terms(q)), query.phrases(q)).select("query_id", "doc_id", "phrase_count")


def min_cover_span(spark, sf_dir):
    terms = query.query_terms(query.queries_of(spark, ["public license version"]))
    return ranking.cover_spans(_positions(spark, sf_dir, terms), terms).select("query_id", "doc_id", F.col("span").cast("bigint").alias("span"))


def bm25_proximity(spark, sf_dir):
    queries, terms, posts, stats = _setup(spark, sf_dir, PHRASED)
    bonus = ranking.positional_bonus(_positions(spark, sf_dir, terms), terms, query.phrases(queries))
    return _top(ranking.add_scores(ranking.bm25(terms, posts, stats), bonus, ["query_id", "doc_id"], "bonus"))


def explain_terms(spark, sf_dir):
    """Parts of the BM25 scores of the first ten documents."""
    _, terms, posts, stats = _setup(spark, sf_dir)
    parts = explain.bm25_terms(terms, posts, stats)
    best = _top(parts.groupBy("query_id", "doc_id").agg(F.sum("contribution").alias("score"))).select("query_id", "doc_id")
    return rounded(parts.join(best, ["query_id", "doc_id"], "left_semi"), "idf", "contribution")


QUERIES = {f.__name__: f for f in (bm25, tfidf, cosine, ql_dirichlet, ql_jm, bm25_batch, phrase_count, min_cover_span, bm25_proximity, explain_terms)}


def _query(*terms: str) -> str:
    return f"q(term, w) AS (VALUES {', '.join(f"('{t}', 1.0::DOUBLE)" for t in terms)})"


_Q = _query("apache", "public", "license", "version")
_TOTALS = "s AS (SELECT count(*) AS n, sum(length) AS total, avg(length) AS avgdl FROM lengths), d AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term)"
_BASE = f"{LENGTHS}, {_TOTALS}"
_BM25 = "w * ln((n + 1) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))"


def _first(scores: str, k: int = K) -> str:
    return f"""scored AS ({scores}), best AS (SELECT query_id, doc_id, round(score, 6) AS score FROM scored)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM best) WHERE rank <= {k}"""


def _ql(chance: str) -> str:
    q = _query("apache", "public", "license", "version", "zzunseen")
    return f"""{_BASE}, {q}, p AS (SELECT q.term, w, CASE WHEN cf > 0 THEN cf / total ELSE 1 / (total + (SELECT count(*) FROM d) + 1) END AS pc FROM q LEFT JOIN d USING (term), s), {_first(f"SELECT 'q1' AS query_id, l.doc_id, sum(w * ln({chance})) AS score FROM lengths l CROSS JOIN p LEFT JOIN tf ON tf.doc_id = l.doc_id AND tf.term = p.term GROUP BY l.doc_id")}"""


_PHRASE = f"""hits AS (SELECT doc_id, pos - o AS start, o FROM tokens JOIN (VALUES (0, 'general'), (1, 'public'), (2, 'license')) ph(o, term) USING (term)),
phrase AS (SELECT doc_id, count(*) AS phrase_count FROM (SELECT doc_id, start FROM hits GROUP BY ALL HAVING count(DISTINCT o) = 3) GROUP BY doc_id)"""


def _cover(*terms: str) -> str:
    cols = ", ".join(f"max(CASE WHEN term = '{t}' THEN pos END) OVER w AS l{i}" for i, t in enumerate(terms))
    ready = " AND ".join(f"l{i} IS NOT NULL" for i in range(len(terms)))
    return f"""runs AS (SELECT doc_id, pos, {cols} FROM tokens WHERE term IN ({", ".join(f"'{t}'" for t in terms)}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cover AS (SELECT doc_id, min(pos - least({", ".join(f"l{i}" for i in range(len(terms)))})) AS span FROM runs WHERE {ready} GROUP BY doc_id)"""


_COS = f"""{_BASE}, {_Q}, norms AS (SELECT doc_id, sqrt(sum(pow(tf * ln((n + 1) / (df + 0.5)), 2))) AS norm FROM tf JOIN d USING (term), s GROUP BY doc_id),
qn AS (SELECT sqrt(sum(pow(w * ln((n + 1) / (coalesce(df, 0) + 0.5)), 2))) AS qnorm FROM q LEFT JOIN d USING (term), s)"""
_TURNS = tokens_cte("turns", "query_id", "text", "qt")

ORACLES = {
    "bm25": f"{_BASE}, {_Q}, {_first(f"SELECT 'q1' AS query_id, doc_id, sum({_BM25}) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN lengths USING (doc_id), s GROUP BY doc_id")}",
    "tfidf": f"{_BASE}, {_Q}, {_first("SELECT 'q1' AS query_id, doc_id, sum(w * tf / length * ln((n + 1) / (df + 0.5))) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN lengths USING (doc_id), s GROUP BY doc_id")}",
    "cosine": f"{_COS}, {_first("SELECT 'q1' AS query_id, doc_id, sum(w * tf * pow(ln((n + 1) / (df + 0.5)), 2)) / (any_value(qnorm) * any_value(norm)) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN norms USING (doc_id), s, qn GROUP BY doc_id")}",
    "ql_dirichlet": _ql("(coalesce(tf, 0) + 1500 * pc) / (length + 1500)"),
    "ql_jm": _ql("0.8 * coalesce(tf / nullif(length, 0), 0) + 0.2 * pc"),
    "bm25_batch": f"""{_BASE}, turns AS (SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'), {_TURNS}, q AS (SELECT query_id, term, count(*)::DOUBLE AS w FROM qt GROUP BY ALL),
{_first(f"SELECT query_id, doc_id, sum({_BM25}) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN lengths USING (doc_id), s GROUP BY query_id, doc_id", 3)}""",
    "phrase_count": f"WITH {TOKENS}, {_PHRASE} SELECT 'q1' AS query_id, doc_id, phrase_count FROM phrase",
    "min_cover_span": f"WITH {TOKENS}, {_cover('public', 'license', 'version')} SELECT 'q1' AS query_id, doc_id, span FROM cover",
    "bm25_proximity": f"""{_BASE}, {_query("general", "public", "license", "version")}, {_PHRASE}, {_cover("general", "public", "license", "version")},
base AS (SELECT doc_id, sum({_BM25}) AS score FROM q JOIN tf USING (term) JOIN d USING (term) JOIN lengths USING (doc_id), s GROUP BY doc_id),
{_first("SELECT 'q1' AS query_id, doc_id, score + 2.0 * coalesce(phrase_count, 0) + CASE WHEN span <= 8 THEN 0.75 * (9 - span) / 8 ELSE 0 END AS score FROM base LEFT JOIN phrase USING (doc_id) LEFT JOIN cover USING (doc_id)")}""",
    "explain_terms": f"""{_BASE}, {_Q}, parts AS (SELECT doc_id, term, tf, df, ln((n + 1) / (df + 0.5)) AS idf, {_BM25} AS contribution FROM q JOIN tf USING (term) JOIN d USING (term) JOIN lengths USING (doc_id), s),
top AS (SELECT doc_id FROM (SELECT doc_id, round(sum(contribution), 6) AS score FROM parts GROUP BY doc_id) ORDER BY score DESC, doc_id LIMIT {K})
SELECT 'q1' AS query_id, doc_id, term, tf, df, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM parts SEMI JOIN top USING (doc_id)""",
}
