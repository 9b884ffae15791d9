"""Queries of literal and pattern search, and set operations on postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsearch.operators import index, postings_codec
from loomsearch.operators import regex_search as rx
from loomsearch.plans.lexical import TF, docs, texts

LITERAL = "General Public"
PATTERN = r'href="/[A-Za-z]+"'
BRANCHES = r'class="ad">Th|<title>By'
MASKED = "General Public"


def _pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", "html")


def trigram_df(spark, sf_dir):
    posts = rx.trigram_postings(docs(spark, sf_dir), "doc_id", "text")
    return posts.groupBy("gram").agg(F.count("*").alias("df"))


def _candidates(source, key, content, planned):
    posts = rx.plan_postings(source, key, content, planned)
    return rx.select(planned, posts, source.select(F.col(key).alias("doc_id")))


def literal_candidates(spark, sf_dir):
    return _candidates(docs(spark, sf_dir), "doc_id", "text", rx.literal_plan(LITERAL)).candidates


def literal_search(spark, sf_dir):
    d = docs(spark, sf_dir)
    return rx.search_literal(d, "doc_id", "text", LITERAL, rx.plan_postings(d, "doc_id", "text", rx.literal_plan(LITERAL)))


def regex_search(spark, sf_dir):
    """Matches of a pattern in pages, by page and line."""
    pages = _pages(spark, sf_dir)
    found = rx.search_regex(pages, "page_id", "html", PATTERN, rx.plan_postings(pages, "page_id", "html", rx.plan(PATTERN)))
    return found.groupBy(F.col("doc_id").alias("page_id"), "line_start", "matched_text").agg(F.count("*").alias("n"))


def regex_candidates(spark, sf_dir):
    return _candidates(_pages(spark, sf_dir), "page_id", "html", rx.plan(BRANCHES)).candidates.withColumnRenamed("doc_id", "page_id")


def regex_diagnostics(spark, sf_dir):
    return _candidates(_pages(spark, sf_dir), "page_id", "html", rx.plan(BRANCHES)).diagnostics()


def masked_candidates(spark, sf_dir):
    d = docs(spark, sf_dir)
    masks = rx.trigram_masks(d, "doc_id", "text", rx.literal_trigrams(MASKED))
    return rx.masked_candidates(masks, _candidates(d, "doc_id", "text", rx.literal_plan(MASKED)).candidates, MASKED)


def sparse_candidates(spark, sf_dir):
    d = docs(spark, sf_dir)
    return rx.sparse_candidates(rx.sparse_postings(d, "doc_id", "text", rx.sparse_covering(LITERAL)), d.select("doc_id"), LITERAL)


def sparse_comparison(spark, sf_dir):
    return rx.sparse_comparison(docs(spark, sf_dir), "doc_id", "text", LITERAL)


def posting_intersect(spark, sf_dir):
    each = index.token_arrays(docs(spark, sf_dir), "doc_id").select("doc_id", F.explode("tokens").alias("term"))
    return postings_codec.documents_with_all(each, "doc_id", ["public", "license", "version"])


QUERIES = {f.__name__: f for f in (trigram_df, literal_candidates, literal_search, regex_search, regex_candidates, regex_diagnostics, masked_candidates, sparse_candidates, sparse_comparison, posting_intersect)}


def _list(items) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in items) + "]"


def _chosen(n: int, key: str, source: str, trigrams) -> str:
    """CTEs `chosen{n}(g)` and `cand{n}(key)` by the planner's rule: rarest first, eight at most, under the corpus size together."""
    return f"""t{n} AS (SELECT g, sum(CASE WHEN contains(body, g) THEN 1 ELSE 0 END) AS n FROM (SELECT unnest({_list(trigrams)}) AS g), {source} GROUP BY g),
r{n} AS (SELECT g, sum(n) OVER (ORDER BY n, g ROWS UNBOUNDED PRECEDING) AS work, row_number() OVER (ORDER BY n, g) AS i FROM t{n}),
chosen{n} AS (SELECT g, i FROM r{n} WHERE i <= {rx.MOST_TRIGRAMS} AND work < (SELECT count(*) FROM {source})),
cand{n} AS (SELECT {key} FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM chosen{n} WHERE NOT contains(s.body, g)))"""


_DOCS = "src AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)"
_PAGES = "src AS (SELECT page_id, coalesce(html, '') AS body FROM pages)"
_BRANCHES = ", ".join(_chosen(i, "page_id", "src", b.trigrams) for i, b in enumerate(rx.plan(BRANCHES).branches))

ORACLES = {
    "trigram_df": """WITH c AS (SELECT doc_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)),
g AS (SELECT doc_id, a || lead(a) OVER w || lead(a, 2) OVER w AS gram FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT gram, count(DISTINCT doc_id) AS df FROM g WHERE gram IS NOT NULL GROUP BY gram""",
    "literal_candidates": f"WITH {_DOCS}, {_chosen(0, 'doc_id', 'src', rx.literal_trigrams(LITERAL))} SELECT doc_id FROM cand0",
    "literal_search": f"""WITH cut AS (SELECT doc_id, string_split(text, '{LITERAL}') AS p FROM documents WHERE contains(text, '{LITERAL}')),
piece AS (SELECT doc_id, unnest(p) AS s, generate_subscripts(p, 1) AS i, len(p) AS n FROM cut),
placed AS (SELECT *, sum(strlen(s)) OVER w + (i - 1) * {len(LITERAL)} AS start, sum(length(s) - length(replace(s, chr(10), ''))) OVER w + 1 AS line FROM piece WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT doc_id, start::BIGINT AS byte_start, (start + {len(LITERAL)})::BIGINT AS byte_end, line::BIGINT AS line_start, line::BIGINT AS line_end, '{LITERAL}' AS matched_text FROM placed WHERE i < n""",
    "regex_search": f"""WITH l AS (SELECT page_id, unnest(x) AS line, generate_subscripts(x, 1) AS line_start FROM (SELECT page_id, string_split(html, chr(10)) AS x FROM pages)),
m AS (SELECT page_id, line_start, unnest(regexp_extract_all(line, '{PATTERN}')) AS matched_text FROM l) SELECT page_id, line_start, matched_text, count(*) AS n FROM m GROUP BY ALL""",
    "regex_candidates": f"WITH {_PAGES}, {_BRANCHES} SELECT page_id FROM cand0 UNION SELECT page_id FROM cand1",
    "regex_diagnostics": f"""WITH {_PAGES}, {_BRANCHES} SELECT (SELECT count(*) FROM src)::INT AS full_corpus_count, (SELECT count(*) FROM (SELECT page_id FROM cand0 UNION SELECT page_id FROM cand1)) AS candidate_count,
(SELECT string_agg(g, ',' ORDER BY b, i) FROM (SELECT 0 AS b, * FROM chosen0 UNION ALL SELECT 1, * FROM chosen1)) AS selected_trigrams, false AS fell_back""",
    "posting_intersect": f"{TF} SELECT doc_id FROM tf WHERE term IN ('public', 'license', 'version') GROUP BY doc_id HAVING count(*) = 3",
}
