"""The first documents of many queries at once, by scores that are sums over terms.

Joining queries with postings gives a row for each query, document and term that they share. Here documents are packed
into blocks of postings of the queries' terms, and each block is scored against queries that every worker holds, a
query at a time: terms are added from the one that can add most on, until those that are left can't lift a document
that has none of the others into the first k; only documents that still can be are then scored in full. So all first k
documents are exact, and only k rows of each query and block leave a task. Terms are known by 64 bits of hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.functions import analysis
from loomsearch.operators import index, ranking

DOCUMENTS, POSTINGS = 1 << 15, 1 << 22  # of a block at most
TERMS = 1 << 21  # of the queries that workers hold at once
DIGITS, NEAR, TINY = 6, 2e-6, 5e-324  # scores are ranked as rounded
_BLOCK = "documents bigint, total bigint, payload binary"

Part = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def bm25_part(tf: np.ndarray, length: np.ndarray, avgdl: float) -> np.ndarray:
    """What an occurrence adds, without the query term's weight and idf, as `ranking.bm25`."""
    return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl))


def tfidf_part(tf: np.ndarray, length: np.ndarray, avgdl: float) -> np.ndarray:
    return tf / length


PARTS = {ranking.bm25: bm25_part, ranking.tfidf: tfidf_part}


def code(term: str) -> int:
    return int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


def _coded(terms: DataFrame) -> DataFrame:
    """`(query_id, code, weight)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = analysis.Kept(code)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kept[t] for t in b.column(1).to_pylist()], pa.int64()), b.column(2)], ["query_id", "code", "weight"])

    return terms.select("query_id", "term", "weight").mapInArrow(run, "query_id string, code bigint, weight double")


def _pack(keys: list[int], lengths: list[int], found: list[dict[int, int]]) -> bytes:
    sizes = np.array([len(f) for f in found], np.int64)
    n = int(sizes.sum())
    term = np.fromiter((t for f in found for t in f), np.int32, n)
    tf = np.fromiter((x for f in found for x in f.values()), np.int32, n)
    doc = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
    order = np.argsort(term, kind="stable")
    terms, counts = np.unique(term, return_counts=True)
    arrays = [np.array(keys, np.int64), np.array(lengths, np.int64), terms, counts.astype(np.int32), doc[order], tf[order]]
    return np.array([len(keys), len(terms), n], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _unpack(payload: bytes) -> list[np.ndarray]:
    """Keys, lengths, terms with their numbers of postings, and by term the documents and frequencies of these."""
    d, t, n = (int(x) for x in np.frombuffer(payload, np.int64, 3))
    raw, at, out = zstandard.ZstdDecompressor().decompress(payload[24:]), 0, []
    for kind, size in ((np.int64, d), (np.int64, d), (np.int32, t), (np.int32, t), (np.int32, n), (np.int32, n)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    return out


def _blocks(docs: DataFrame, key: str, content: str, sought) -> DataFrame:
    """Blocks of documents with the terms of `sought`, a broadcast of ascending codes; others count in the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = sought.value

        def of(lexeme: str) -> tuple[int, tuple[int, ...]]:
            terms = analysis.identifier_stream(lexeme)
            own = np.array([code(t) for t in terms], np.int64)
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            return len(terms), tuple(at[codes[at] == own].tolist())

        kept = analysis.Kept(of)
        keys, lengths, found = [], [], []
        documents = total = postings = 0

        def row() -> pa.RecordBatch:
            payload = _pack(keys, lengths, found)
            return pa.RecordBatch.from_arrays([pa.array([documents], pa.int64()), pa.array([total], pa.int64()), pa.array([payload], pa.binary())], ["documents", "total", "payload"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                length, tf = 0, {}
                for lexeme, n in Counter(analysis.lexemes(x.as_py() or "")).items():
                    size, terms = kept[lexeme]
                    length += n * size
                    for t in terms:
                        tf[t] = tf.get(t, 0) + n
                documents, total = documents + 1, total + length
                if tf:
                    keys.append(k)
                    lengths.append(length)
                    found.append(tf)
                    postings += len(tf)
                if len(keys) >= DOCUMENTS or postings >= POSTINGS:
                    yield row()
                    keys, lengths, found, documents, total, postings = [], [], [], 0, 0, 0
        if documents:
            yield row()

    return docs.select(F.col(key).cast("bigint").alias("key"), F.col(content).alias("text")).mapInArrow(run, _BLOCK)


def _frequencies(blocks: DataFrame, n: int) -> np.ndarray:
    """Document frequency of each of the `n` terms; each task adds up its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for b in batches:
            for p in b.column(0):
                _, _, terms, counts, _, _ = _unpack(p.as_py())
                df[terms] += counts
        at = np.flatnonzero(df)
        for i in range(0, len(at), index.BATCH):
            part = at[i : i + index.BATCH]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(df[part])], ["term", "df"])

    found = blocks.select("payload").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n, np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    return df


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit, halves up as Spark rounds a double's decimal form."""
    scaled = scores * 10**DIGITS
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        out[i] = int((Decimal(repr(float(scores[i]))) * 10**DIGITS).to_integral_value(ROUND_HALF_UP))
    return out


class Block:
    """A block's postings by term, with what each adds to a score before the query's weight."""

    def __init__(self, payload: bytes, part: Part, avgdl: float):
        self.keys, lengths, self.terms, counts, self.docs, tf = _unpack(payload)
        self.base = part(tf.astype(np.float64), lengths[self.docs].astype(np.float64), avgdl)
        self.ends = np.cumsum(counts, dtype=np.int64)
        self.starts = self.ends - counts
        self.top = np.maximum.reduceat(self.base, self.starts) if len(self.terms) else np.zeros(0)
        self.sums = np.zeros(len(self.keys))

    def first(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in `keys` and scores of the first k documents, of rounded score and then the smallest key."""
        if not len(self.terms) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        at, weights = at[here], weights[here]
        most = weights * self.top[at]
        order = np.argsort(-most)
        at, weights, most = at[order], weights[order], most[order]
        left = np.append(np.cumsum(most[::-1])[::-1], 0.0)  # what the terms from here on can add at most
        sums, least, i = self.sums, 0.0, 0
        while i < len(at) and least <= left[i] + NEAR:
            own = slice(self.starts[at[i]], self.ends[at[i]])
            d = self.docs[own]
            now = sums[d] + weights[i] * self.base[own]
            sums[d] = now
            i += 1
            if len(d) >= k and now.max() > max(least, left[i]):  # the k-th of these documents bounds that of all from below
                least = max(least, np.partition(now, len(now) - k)[len(now) - k])
        some = np.flatnonzero(sums >= least - left[i] - NEAR) if i < len(at) else np.flatnonzero(sums >= max(least - NEAR, TINY))
        scores = sums[some]
        sums.fill(0.0)
        for j in range(i, len(at)):
            own = slice(self.starts[at[j]], self.ends[at[j]])
            d = self.docs[own]
            where = np.minimum(np.searchsorted(d, some), len(d) - 1)
            scores += np.where(d[where] == some, weights[j] * self.base[own][where], 0.0)
            if len(some) > k:
                least = max(least, np.partition(scores, len(scores) - k)[len(scores) - k])
                good = scores >= least - left[j + 1] - NEAR
                some, scores = some[good], scores[good]
        if len(some) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            good = scores >= least - NEAR
            some, scores = some[good], scores[good]
        best = np.lexsort((self.keys[some], -rounded(scores)))[:k]
        return some[best], scores[best]


def _scored(blocks: DataFrame, queries, part: Part, avgdl: float, k: int) -> DataFrame:
    """`(query_id, doc_id, score)`; `queries` is a broadcast of `(ids, starts, terms, weights)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, terms, weights = queries.value
        for b in batches:
            for p in b.column(0):
                block = Block(p.as_py(), part, avgdl)
                query, keys, scores, held = [], [], [], 0

                def rows() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(query))), pa.array(block.keys[np.concatenate(keys)]), pa.array(np.concatenate(scores))], ["query_id", "doc_id", "score"])

                for q in range(len(ids)):
                    own = slice(starts[q], starts[q + 1])
                    d, s = block.first(terms[own], weights[own], k)
                    if len(d):
                        query.append(np.full(len(d), q))
                        keys.append(d)
                        scores.append(s)
                        held += len(d)
                    if held >= index.BATCH:
                        yield rows()
                        query, keys, scores, held = [], [], [], 0
                if held:
                    yield rows()

    return blocks.select("payload").mapInArrow(run, "query_id string, doc_id bigint, score double")


class Packed:
    """Documents packed for the queries of `terms(query_id, term, weight)`; any number of scores share the blocks.

    `key` is a bigint. The blocks are kept between the scan and the scores. Where keys repeat, postings are joined.
    """

    def __init__(self, docs: DataFrame, key: str, terms: DataFrame, content: str = "text"):
        self.spark, self.joined = docs.sparkSession, None
        if index.repeats(docs, key):
            posts, lengths = index.query_postings(docs, key, terms, content)
            self.joined = (terms, posts, ranking.Stats(lengths))
            return
        self.coded = _coded(terms).persist()
        self.codes = np.sort(self.coded.select("code").distinct().toArrow()["code"].to_numpy())
        self.n = self.total = 0
        if len(self.codes):
            self.blocks = _blocks(docs, key, content, self.spark.sparkContext.broadcast(self.codes)).persist()
            self.n, self.total = self.blocks.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
            self.df = _frequencies(self.blocks, len(self.codes))
        self.chunks = math.ceil(self.coded.count() / TERMS) if self.total else 0

    def _queries(self, chunk: int):
        """A broadcast of the query ids of a chunk, where each begins, and its terms with their weights times idf."""
        own = self.coded.where(F.pmod(F.xxhash64("query_id"), F.lit(self.chunks)) == chunk).toArrow().sort_by("query_id")
        at = np.searchsorted(self.codes, own["code"].to_numpy())
        good = self.df[at] > 0
        ids, of = np.unique(own["query_id"].to_numpy(), return_inverse=True)
        weights = own["weight"].to_numpy() * np.log((self.n + 1) / (self.df[at] + 0.5))
        starts = np.searchsorted(of[good], np.arange(len(ids) + 1))
        return self.spark.sparkContext.broadcast((pa.array(ids, pa.string()), starts, at[good].astype(np.int32), weights[good]))

    def first(self, k: int, score: Callable = ranking.bm25) -> DataFrame:
        """`(query_id, rank, doc_id, score)` of the first `k` documents of each query by `ranking.bm25` or `ranking.tfidf`.

        Scores are rounded to six digits; ties go to the smaller key.
        """
        if self.joined:
            scores = score(*self.joined)
        else:
            parts = [_scored(self.blocks, self._queries(c), PARTS[score], self.total / self.n, k) for c in range(self.chunks)]
            scores = reduce(DataFrame.unionByName, parts or [self.spark.createDataFrame([], "query_id string, doc_id bigint, score double")])
        return ranking.top_k(scores.withColumn("score", F.round("score", DIGITS)), k).select("query_id", "rank", "doc_id", "score")
