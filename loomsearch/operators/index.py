"""Inverted index as tables: token streams, postings, statistics and norms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomsearch.functions import analysis, stop_words, text
from loomsearch.functions.stemmer import stemmed_stream

BATCH = 1 << 16  # rows that a worker gathers before it sends them
_TF = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])


def exploded(docs: DataFrame, key: str, content: str, fields: T.StructType, made: Callable[[], Callable[[str], list[list]]]) -> DataFrame:
    """`(key, *fields)`: rows of each text, given as a list for each field by the function that `made` makes in a worker.

    One pass over Arrow batches without a shuffle. A null text counts as empty.
    """
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = made()
        for b in batches:
            keys, own, sizes, held = b.column(0), [], [], 0
            columns: list[list] = [[] for _ in kinds]

            def rows() -> pa.RecordBatch:
                at = pa.array(np.repeat(np.array(own, np.int64), np.array(sizes, np.int64)))
                return pa.RecordBatch.from_arrays([keys.take(at), *(pa.array(c, k) for c, k in zip(columns, kinds))], [key, *fields.names])

            for i, x in enumerate(b.column(1)):
                found = of(x.as_py() or "")
                n = len(found[0])
                own.append(i)
                sizes.append(n)
                held += n
                for c, f in zip(columns, found):
                    c.extend(f)
                if held >= BATCH:
                    yield rows()
                    own, sizes, held = [], [], 0
                    columns = [[] for _ in kinds]
            if held:
                yield rows()

    return docs.select(key, F.col(content).alias("_text")).mapInArrow(run, T.StructType([docs.schema[key], *fields]))


def repeats(docs: DataFrame, key: str) -> bool:
    """Whether two rows share a key; only keys are shuffled."""
    return bool(docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect())


def _summed(counts: DataFrame, docs: DataFrame, key: str, name: str) -> DataFrame:
    """Counts of rows of one key added up; as keys seldom repeat, the counts are shuffled only where they do."""
    return counts.groupBy(key, name).agg(F.sum("tf").alias("tf")) if repeats(docs, key) else counts


def with_prose_tokens(df: DataFrame, content: Column, name: str = "tokens", stops: list[str] | None = None) -> DataFrame:
    """`df` with the prose analyser's stream of a text in order: stop words out, parts stemmed, each term once in a lexeme.

    Null texts have a null stream. The stemmer runs over Arrow batches; its results for words are kept in each worker.
    """
    marked = df.withColumn("_marked", text.marked_pieces(content, stop_words.ENGLISH if stops is None else stops))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            streams = [None if x is None else stemmed_stream(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(streams, pa.list_(pa.string()))], [*b.schema.names[:-1], name])

    return marked.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))


def token_arrays(docs: DataFrame, key: str, content: str = "text", analyze: Callable[[Column], Column] = text.code_tokens) -> DataFrame:
    """`(key, tokens)`: an analyser's stream of each document as an array; any function of a text column will do."""
    return docs.select(key, analyze(F.col(content)).alias("tokens"))


def positions(docs: DataFrame, key: str, content: str = "text", terms: list[str] | None = None) -> DataFrame:
    """`(key, pos, term)` rows, of `terms` only where they are given."""
    wanted = None if terms is None else frozenset(terms)

    def made():
        kept = analysis.Kept(analysis.identifier_stream)

        def of(x: str) -> list[list]:
            found = [(i, t) for i, t in enumerate(analysis.stream(x, kept)) if wanted is None or t in wanted]
            return [[i for i, _ in found], [t for _, t in found]]

        return of

    return exploded(docs, key, content, T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("term", T.StringType())]), made)


def _counted(stream_of: Callable[[str], tuple[str, ...]]) -> Callable:
    def made():
        kept = analysis.Kept(stream_of)

        def of(x: str) -> list[list]:
            found = analysis.frequencies(x, kept)
            return [list(found), list(found.values())]

        return of

    return made


def postings(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """`(key, term, tf)`, counted text by text in one pass without a shuffle."""
    return _summed(exploded(docs, key, content, _TF, _counted(analysis.identifier_stream)), docs, key, "term")


MOST_TERMS = 1024  # distinct query terms that are put into a plan; more are joined


def few_terms(terms: DataFrame, most: int = MOST_TERMS) -> list[str] | None:
    """The distinct terms of `terms(term)`, or None where there are more than `most`."""
    found = [r[0] for r in terms.select("term").distinct().limit(most + 1).collect()]
    return sorted(found) if len(found) <= most else None


def vocabulary(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """One row: how many distinct terms there are; only terms are shuffled, once from each task."""
    each = docs.select(F.explode(text.lexemes(F.col(content))).alias("_lexeme")).distinct()
    return each.select(F.explode(text.identifier_stream(F.col("_lexeme"))).alias("term")).distinct().agg(F.count("*").alias("vocabulary"))


def query_postings(docs: DataFrame, key: str, terms: DataFrame, content: str = "text") -> tuple[DataFrame, DataFrame]:
    """Postings of the terms of `terms(term)` only, and `(key, length)` of all documents; one pass for both.

    With up to `MOST_TERMS` distinct terms, tokens of others are dropped where they are found, and the view kept in
    between has a few numbers a document; if an executor is lost, its part is computed again. With more terms, both
    come from all postings.
    """
    wanted = few_terms(terms)
    if wanted is None:
        posts = postings(docs, key, content)
        lengths = docs.select(key).join(posts.groupBy(key).agg(F.sum("tf").alias("length")), key, "left").select(key, F.coalesce("length", F.lit(0)).cast("bigint").alias("length"))
        return posts.join(terms.select("term").distinct(), "term", "left_semi").select(key, "term", "tf"), lengths
    sought = frozenset(wanted)

    def made():
        kept = analysis.Kept(lambda lexeme: (len(ts := analysis.identifier_stream(lexeme)), tuple(t for t in ts if t in sought)))

        def of(x: str) -> list[list]:
            length, hits = 0, {}
            for lexeme, n in Counter(analysis.lexemes(x)).items():
                size, found = kept[lexeme]
                length += n * size
                for t in found:
                    hits[t] = hits.get(t, 0) + n
            return [[length], [[{"term": t, "tf": n} for t, n in hits.items()]]]

        return of

    fields = T.StructType([T.StructField("length", T.LongType()), T.StructField("hits", T.ArrayType(_TF))])
    view = exploded(docs, key, content, fields, made).persist()
    posts = view.select(key, F.explode("hits").alias("h")).groupBy(key, F.col("h.term").alias("term")).agg(F.sum("h.tf").alias("tf"))
    return posts, view.select(key, "length")


def query_field_postings(fields: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From `(doc_id, field, tokens)`: `(term, doc_id, field, tf)` of the terms of `terms(term)` only, and `(doc_id, field, length)`.

    Like `query_postings`, one pass over the tokens serves both; empty fields are absent.
    """
    there = fields.where(F.size("tokens") > 0)
    wanted = few_terms(terms)
    if wanted is None:
        return field_frequencies(there).join(terms.select("term").distinct(), "term", "left_semi"), there.select("doc_id", "field", F.size("tokens").cast("bigint").alias("length"))
    hits = F.filter("tokens", lambda t: t.isin(*wanted)) if wanted else F.array().cast("array<string>")
    view = there.select("doc_id", "field", F.size("tokens").cast("bigint").alias("length"), hits.alias("hits")).persist()
    posts = view.select("doc_id", "field", F.explode("hits").alias("term")).groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"))
    return posts, view.select("doc_id", "field", "length")


def field_frequencies(fields: DataFrame) -> DataFrame:
    """From `(doc_id, field, tokens)`: `(term, doc_id, field, tf)`."""
    return fields.select("doc_id", "field", F.explode("tokens").alias("term")).groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"))


def field_averages(lengths: DataFrame, n_docs: DataFrame) -> DataFrame:
    """`(field, avg_length)` over all documents, with those that lack the field as 0; `n_docs` is one row `(n)`."""
    return lengths.groupBy("field").agg(F.sum("length").alias("total")).crossJoin(F.broadcast(n_docs)).select("field", (F.col("total") / F.col("n")).alias("avg_length"))


def positional_postings(fields: DataFrame) -> DataFrame:
    """From `(doc_id, field, tokens)`: `(term, doc_id, field, tf, positions)` with positions ascending."""
    each = fields.select("doc_id", "field", F.posexplode("tokens").alias("pos", "term"))
    return each.groupBy("term", "doc_id", "field").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def assembled_postings(by_field: DataFrame) -> DataFrame:
    """`(term, doc_id, tf, field_tf)`: totals over fields and a map of field to frequency."""
    return by_field.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "tf")))).alias("field_tf"))


def doc_lengths(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """`(key, length)` without a shuffle; documents without tokens have length 0."""

    def made():
        kept = analysis.Kept(lambda lexeme: len(analysis.identifier_stream(lexeme)))
        return lambda x: [[sum(map(kept.__getitem__, analysis.lexemes(x)))]]

    return exploded(docs, key, content, T.StructType([T.StructField("length", T.LongType())]), made)


def term_stats(posts: DataFrame, key: str) -> DataFrame:
    """`(term, df, cf)`."""
    return posts.groupBy("term").agg(F.count(key).alias("df"), F.sum("tf").alias("cf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs + 1) / (df + 0.5))


def doc_norms(posts: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """`(key, norm)`: Euclidean norm of tf * idf; documents without tokens have none."""
    n = lengths.agg(F.count("*").alias("n"))
    dfs = posts.groupBy("term").agg(F.count("*").alias("df"))
    return _norms(posts.join(dfs, "term").crossJoin(F.broadcast(n)), key)


def _norms(known: DataFrame, key: str) -> DataFrame:
    weighted = known.withColumn("w", F.col("tf") * idf(F.col("n"), F.col("df")))
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


FREQUENT = 1 << 18  # terms whose document frequencies each worker holds


def document_frequencies(docs: DataFrame, key: str, content: str = "text") -> DataFrame:
    """`(term, df)`; workers add up before anything is shuffled."""
    if repeats(docs, key):
        return postings(docs, key, content).groupBy("term").agg(F.count("*").alias("df"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, seen = analysis.Kept(analysis.identifier_stream), Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])
        for b in batches:
            for x in b.column(0):
                seen.update({t for lexeme in set(analysis.lexemes(x.as_py() or "")) for t in kept[lexeme]})
                if len(seen) >= FREQUENT:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return docs.select(F.col(content).alias("_text")).mapInArrow(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def text_norms(docs: DataFrame, key: str, content: str = "text", only: DataFrame | None = None) -> DataFrame:
    """`doc_norms` of texts, or of those whose keys are in `only`; frequencies and their number cover all of `docs`.

    Each worker knows the frequencies of the `FREQUENT` most frequent terms and adds their part up by text. Only
    postings of the other terms are joined with their frequencies.
    """
    some = docs if only is None else docs.join(only.select(key).distinct(), key, "left_semi")
    if repeats(docs, key):
        dfs = document_frequencies(docs, key, content)
        return _norms(postings(some, key, content).join(dfs, "term").crossJoin(F.broadcast(docs.agg(F.count("*").alias("n")))), key)
    dfs = document_frequencies(docs, key, content).persist()
    n = docs.count()
    most = dfs.orderBy(F.desc("df"), "term").limit(FREQUENT).toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(most["term"].to_pylist(), (np.log((n + 1) / (most["df"].to_numpy() + 0.5))).tolist())))

    def made():
        kept, weights = analysis.Kept(analysis.identifier_stream), known.value

        def of(x: str) -> list[list]:
            found = analysis.frequencies(x, kept)
            if not found:
                return [[], [], []]
            part, rare = 0.0, []
            for t, tf in found.items():
                if (w := weights.get(t)) is None:
                    rare.append(t)
                else:
                    part += (tf * w) ** 2
            # the sum has a name with a space, which no term has, of many for the sake of even partitions
            return [[f" {len(x)}", *rare], [None, *(found[t] for t in rare)], [part, *[None] * len(rare)]]

        return of

    fields = T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("part", T.DoubleType())])
    joined = exploded(some, key, content, fields, made).join(dfs, "term", "left")
    squared = F.coalesce("part", F.pow(F.col("tf") * idf(F.lit(n), F.col("df")), F.lit(2.0)))
    return joined.groupBy(key).agg(F.sqrt(F.sum(squared)).alias("norm"))


def corpus_stats(posts: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """One row: documents, tokens, average length, vocabulary, terms that occur once."""
    by_term = term_stats(posts, key).agg(F.count("*").alias("vocabulary"), F.count_if(F.col("cf") == 1).alias("hapax"))
    by_doc = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_tokens"))
    both = by_doc.crossJoin(by_term)
    return both.withColumn("avg_length", text.safe_ratio(F.col("total_tokens"), F.col("n_docs")))


def top_terms(posts: DataFrame, key: str, k: int) -> DataFrame:
    """The `k` most frequent terms: by collection frequency, document frequency, then name."""
    return term_stats(posts, key).orderBy(F.desc("cf"), F.desc("df"), "term").limit(k)


def prose_postings(docs: DataFrame, key: str, content: str = "text", stops: list[str] | None = None) -> DataFrame:
    """`(key, term, tf)` of the prose analyser: stop words out, parts stemmed, each term once in a lexeme; no shuffle."""
    words = stop_words.ENGLISH if stops is None else stops
    return _summed(exploded(docs, key, content, _TF, _counted(analysis.prose_stream(words))), docs, key, "term")


def ngram_postings(docs: DataFrame, key: str, n: int, content: str = "text", analyze: Callable[[Column], Column] | None = None) -> DataFrame:
    """`(key, gram, tf)` of windows of `n` tokens of the code analyser, in one pass without a shuffle, or of another one."""
    if analyze is not None:
        grams = text.word_ngrams(F.col("tokens"), n)
        return token_arrays(docs, key, content, analyze).select(key, F.explode(grams).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))
    if n < 1:
        raise ValueError("n is at least 1")

    def made():
        kept = analysis.Kept(analysis.identifier_stream)

        def of(x: str) -> list[list]:
            tokens = analysis.stream(x, kept)
            found = Counter(zip(*(tokens[i:] for i in range(n))))
            return [list(map(" ".join, found)), list(found.values())]

        return of

    fields = T.StructType([T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType())])
    return _summed(exploded(docs, key, content, fields, made), docs, key, "gram")


@dataclass
class Index:
    """Tables of one corpus. `fields` holds `(doc_id, path, field, tokens)`."""

    docs: DataFrame
    fields: DataFrame

    def by_field(self) -> DataFrame:
        return positional_postings(self.fields)

    def field_lengths(self) -> DataFrame:
        """`(doc_id, field, length)`; empty fields are absent."""
        return self.fields.where(F.size("tokens") > 0).select("doc_id", "field", F.size("tokens").cast("bigint").alias("length"))

    def avg_field_lengths(self) -> DataFrame:
        """`(field, avg_length)` over all documents, with those that lack the field as 0."""
        return field_averages(self.field_lengths(), self.docs.agg(F.count("*").alias("n")))
