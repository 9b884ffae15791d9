"""Queries over the token stream: frequencies, statistics and norms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.functions.oracle import parts_sql, tokens_cte
from loomsearch.operators import fields, index


SCAN_BYTES = 64 << 20  # a table of more bytes a core is read as it lies


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts. A small one, of which there are fewer scan tasks than cores, is spread over the cores, as analysis costs more."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(size) < cores * SCAN_BYTES else df


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", "text")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


def tok_code_tf(spark, sf_dir):
    return index.postings(docs(spark, sf_dir), "doc_id")


def tok_ngram2(spark, sf_dir):
    return index.ngram_postings(docs(spark, sf_dir), "doc_id", 2)


def ident_split(spark, sf_dir):
    """Parts of the lexemes of whole documents."""
    lex = docs(spark, sf_dir).select("doc_id", F.posexplode(text.lexemes(F.col("text"))).alias("n", "lexeme"))
    return lex.select("doc_id", "n", "lexeme", F.posexplode(text.identifier_stream(F.col("lexeme"))).alias("i", "token"))


def prose_tf(spark, sf_dir):
    return index.prose_postings(docs(spark, sf_dir), "doc_id")


def doc_lengths(spark, sf_dir):
    lengths = index.doc_lengths(docs(spark, sf_dir), "doc_id")
    totals = lengths.agg(F.count("*").alias("n_docs"), F.round(F.avg("length"), 6).alias("avg_length"))
    return lengths.crossJoin(F.broadcast(totals))


def field_tokens(spark, sf_dir, only: DataFrame | None = None) -> DataFrame:
    """Fields of pages, the address being the path. All are analysed as code, so that SQL can express the rest.

    With `only(doc_id)`, of these pages.
    """
    pages = texts(spark, sf_dir, "pages").select("page_id", "url", "html")
    if only is not None:
        pages = pages.join(F.broadcast(only.select(F.col("doc_id").alias("page_id")).distinct()), "page_id", "left_semi")
    return fields.field_tokens(fields.base_fields(pages, "page_id", "url", "html"))


def field_lengths(spark, sf_dir):
    n = table(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    sized = field_tokens(spark, sf_dir).withColumn("length", F.size("tokens")).where("length > 0")
    by = sized.groupBy("field").agg(F.count("*").alias("docs"), F.sum("length").cast("bigint").alias("total"))
    return by.crossJoin(F.broadcast(n)).select("field", "docs", "total", F.round(F.col("total") / F.col("n"), 6).alias("avg_length"))


def df_cf(spark, sf_dir):
    return index.term_stats(tok_code_tf(spark, sf_dir), "doc_id")


def corpus_stats(spark, sf_dir):
    d = docs(spark, sf_dir)
    return rounded(index.corpus_stats(index.postings(d, "doc_id"), index.doc_lengths(d, "doc_id"), "doc_id"), "avg_length")


def top_terms(spark, sf_dir):
    return index.top_terms(tok_code_tf(spark, sf_dir), "doc_id", 20)


def doc_norms(spark, sf_dir):
    return rounded(index.text_norms(docs(spark, sf_dir), "doc_id"), "norm")


def positional_postings(spark, sf_dir):
    """Postings of whole documents with their positions as text."""
    made = index.positional_postings(docs(spark, sf_dir).select("doc_id", F.lit("content").alias("field"), text.code_tokens(F.col("text")).alias("tokens")))
    return made.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


QUERIES = {f.__name__: f for f in (tok_code_tf, tok_ngram2, ident_split, prose_tf, doc_lengths, field_lengths, df_cf, corpus_stats, top_terms, doc_norms, positional_postings)}

TOKENS = tokens_cte()
TF = f"WITH {TOKENS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL)"
LENGTHS = f"{TF}, lengths AS (SELECT d.doc_id, count(term) AS length FROM documents d LEFT JOIN tokens t ON d.doc_id = t.doc_id GROUP BY d.doc_id)"
PAGE_FIELDS = r"""
raw_fields AS (
  SELECT page_id AS doc_id, 'filename' AS field, regexp_extract(url, '[^/]*$') AS text FROM pages
  UNION ALL SELECT page_id, 'path', url FROM pages
  UNION ALL SELECT page_id, 'extension', regexp_extract(regexp_extract(url, '[^/]*$'), '^.+\.([^.]*)$', 1) FROM pages
  UNION ALL SELECT page_id, 'content', html FROM pages
  UNION ALL SELECT page_id, 'identifiers', array_to_string(list_filter(regexp_extract_all(html, '[A-Za-z0-9_-]+'), lambda s: regexp_matches(s, '[_-]') OR (regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')) OR (regexp_matches(s, '[A-Za-z]') AND regexp_matches(s, '[0-9]'))), ' ') FROM pages),
fielded AS (SELECT doc_id, field, doc_id || ' ' || field AS k, text FROM raw_fields WHERE length(trim(text)) > 0)"""
FIELD_TOKENS = f"WITH {PAGE_FIELDS}, {tokens_cte('fielded', 'k', 'text', 'ft')}"

ORACLES = {
    "tok_code_tf": f"{TF} SELECT * FROM tf",
    "tok_ngram2": f"WITH {TOKENS}, pairs AS (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS gram FROM tokens) SELECT doc_id, gram, count(*) AS tf FROM pairs WHERE gram IS NOT NULL GROUP BY ALL",
    "ident_split": f"""
WITH lex AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_-]+') AS l FROM documents)),
p AS (SELECT doc_id, n, s, [lower(s), array_to_string({parts_sql()}, '')] || {parts_sql()} AS l FROM lex),
d AS (SELECT doc_id, n, s, list_filter(l, lambda x, k: list_position(l, x) = k) AS l FROM p)
SELECT doc_id, n, s AS lexeme, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS token FROM d""",
    "doc_lengths": f"{LENGTHS} SELECT doc_id, length, n_docs, avg_length FROM lengths, (SELECT count(*) AS n_docs, round(avg(length), 6) AS avg_length FROM lengths)",
    "field_lengths": f"{FIELD_TOKENS}, l AS (SELECT k, count(*) AS length FROM ft GROUP BY k) SELECT field, count(*) AS docs, sum(length)::BIGINT AS total, round(sum(length) / (SELECT count(*) FROM pages), 6) AS avg_length FROM l JOIN fielded USING (k) GROUP BY field",
    "df_cf": f"{TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term",
    "corpus_stats": f"""{LENGTHS}, t AS (SELECT term, sum(tf) AS cf FROM tf GROUP BY term)
SELECT (SELECT count(*) FROM lengths) AS n_docs, (SELECT sum(length)::BIGINT FROM lengths) AS total_tokens, count(*) AS vocabulary, count(*) FILTER (cf = 1) AS hapax, (SELECT round(avg(length), 6) FROM lengths) AS avg_length FROM t""",
    "top_terms": f"{TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term ORDER BY cf DESC, df DESC, term LIMIT 20",
    "doc_norms": f"""{TF}, d AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc_id, round(sqrt(sum(pow(tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 0.5)), 2))), 6) AS norm FROM tf JOIN d USING (term) GROUP BY doc_id""",
    "positional_postings": f"WITH {TOKENS} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ' ' ORDER BY pos) AS positions FROM tokens GROUP BY ALL",
}
