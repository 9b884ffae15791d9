"""Quality classification by importance resampling with hashed n-gram models.

Two generative models give the chance that a document holds a feature: one of the target (documents labelled good and
not toxic), one of the raw corpus (every document). Features are hashed to buckets: words, and one- and two-grams of
word shapes (what follows the word, its case, whether it repeats the word before), to the first two thirds; two-grams
of words to the rest, as a model of their own. A document's log ratio is the sum over its distinct features of log p(target) - log p(raw),
counts of the document itself left out, and features whose counts could as well be chance (under `z` standard
deviations, `z_pairs` for the many two-grams of words, most of them rare) scaled down by the square of their share
of it. Standard Gumbel noise times `temperature` is added and the k documents of largest value are kept, which
draws k documents without replacement with chances in proportion to exp(log ratio / temperature). Unless it is given,
k is the number of documents above the score that best parts the labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _shared, _words

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("log_ratio", pa.float64())])


def words_of(buckets: int) -> int:
    """Buckets of words and shapes; those behind are of two-grams of words."""
    return buckets - buckets // 3


def features(texts: pa.Array, buckets: int, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """`(first row, row of each feature, feature)` of chunks of rows; a row has each of its features once."""
    data, bounds = _words.buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        raw, edges = data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        chunk = _words.split_bytes(_LOW[raw], edges, i)
        row = chunk.row_of_word()
        most_words = words_of(buckets)
        found = [row * buckets + (chunk.hashes % np.uint64(most_words)).astype(np.int64)]
        pairs, off = _words.ngrams(chunk, 2)
        both = np.repeat(np.diff(chunk.offsets) > 1, np.diff(off))  # a row of one word has no pair
        found.append((np.repeat(np.arange(chunk.rows), np.diff(off)) * buckets + most_words + (pairs % np.uint64(buckets - most_words)).astype(np.int64))[both])
        if len(row):
            stop = edges[row + 1]
            after = [np.where(chunk.ends + k < stop, np.concatenate([raw, np.zeros(2, np.uint8)])[chunk.ends + k], 0).astype(np.uint64) for k in (0, 1)]
            after[1] = np.where(after[0] == 32, 0, np.where(_words._WORD[after[1].astype(np.uint8)], 1, after[1]))
            same = np.zeros(len(row), bool)
            same[1:] = (chunk.hashes[1:] == chunk.hashes[:-1]) & (row[1:] == row[:-1])
            case = _UPPER[raw[chunk.starts]] * 4 + (_UPPER[raw[chunk.ends - 1]] & (chunk.ends - chunk.starts > 1)) * 2 + same
            shape = _words.mix((after[0] * np.uint64(256) + after[1]) * np.uint64(8) + case.astype(np.uint64) + np.uint64(0x51ED))
            shapes = _words.Chunk(i, chunk.rows, shape, chunk.offsets, chunk.starts, chunk.ends, raw, edges)
            for n in (1, 2):
                grams, off = _words.ngrams(shapes, n)
                found.append(np.repeat(np.arange(chunk.rows), np.diff(off)) * buckets + (grams % np.uint64(most_words)).astype(np.int64))
        both = _words.distinct(np.concatenate(found))
        yield i, both // buckets, both % buckets
        i = j


def _member(ids: np.ndarray, sorted_ids: np.ndarray) -> np.ndarray:
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    at = np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)
    return sorted_ids[at] == ids


def _count(target_ids, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for b in batches:
            good = _member(b.column(0).to_numpy(zero_copy_only=False), target_ids.value)
            for first, row, feature in features(b.column(1), buckets, 1 << 20):
                raw += np.bincount(feature, minlength=buckets)
                target += np.bincount(feature[good[first + row]], minlength=buckets)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            own = at[i : i + (1 << 16)]
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(target[own]), pa.array(raw[own])], schema=_COUNTS)

    return run


def weights(target: np.ndarray, raw: np.ndarray, own: int, sums: tuple[float, float], alpha: float, z: float) -> np.ndarray:
    """Log ratios by bucket for documents that the raw model holds, and the target too where `own` is 1."""
    total, whole = sums
    if not total or not whole:
        return np.zeros(len(raw), np.float32)
    a, b = np.maximum(target - own, 0), np.maximum(raw - 1, 0)
    share = total / whole
    ratio = np.log((a + alpha * share) / (total + alpha * share * len(raw))) - np.log((b + alpha) / (whole + alpha * len(raw)))
    due = b * share
    known = np.minimum(1, np.abs(a - due) / np.maximum(z * np.sqrt(due + 1), 1e-9))
    return (ratio * known**2).astype(np.float32)


@dataclass
class Model:
    raw_weights: np.ndarray
    target_weights: np.ndarray
    target_ids: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 3 << 19, alpha: float = 2.0, z: float = 3.0, z_pairs: float = 12.0, max_target: int = 100_000) -> Model:
    """Counts features over all documents; the target are at most `max_target` labelled documents, by hash of their id."""
    spark = docs.sparkSession
    good = good_labels(labels).where("good").select("doc_id")
    ids = np.sort(np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).collect()], np.int64))
    counts = _shared.narrow(docs).mapInArrow(_count(spark.sparkContext.broadcast(ids), buckets), "bucket int, target bigint, raw bigint")
    found = counts.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    at = found["bucket"].to_numpy()
    target[at], raw[at] = found["target"].to_numpy(), found["raw"].to_numpy()
    parts = [(slice(0, words_of(buckets)), z), (slice(words_of(buckets), None), z_pairs)]

    def both(own: int) -> np.ndarray:
        return np.concatenate([weights(target[p], raw[p], own, (float(target[p].sum()), float(raw[p].sum())), alpha, least) for p, least in parts])

    return Model(both(0), both(1), ids)


def good_labels(labels: DataFrame) -> DataFrame:
    """`(doc_id, good)` by document; contradicting rows for one id count as not good, rows with a null are left out."""
    full = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return full.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))


def _score(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            own = _member(ids, m.target_ids)
            out = np.zeros(b.num_rows)
            for first, row, feature in features(b.column(1), buckets):
                w = np.where(own[first + row], m.target_weights[feature], m.raw_weights[feature])
                part = np.bincount(row, weights=w)
                out[first : first + len(part)] += part
            yield pa.record_batch([b.column(0), pa.array(np.round(out, 6))], schema=_SCORES)

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, log_ratio)`, one row for each row of `docs` with an id."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return _shared.narrow(docs).mapInArrow(_score(held, len(model.raw_weights)), "doc_id bigint, log_ratio double")


def _step(score: F.Column) -> F.Column:
    """Scores in steps of 0.05 up to 100 either way, and of about 0.05 % beyond: as many steps as the largest logarithm."""
    size = F.abs(score)
    return F.floor(20 * F.when(size <= 100, score).otherwise(F.signum(score) * 100 * (1 + F.log(F.greatest(size, F.lit(1.0)) / 100))))


def best_threshold(scored: DataFrame, labels: DataFrame) -> float | None:
    """A score at which the shares of good kept and of others rejected have the largest sum, in small steps of scores."""
    held = scored.join(good_labels(labels), "doc_id").select(_step(F.col("log_ratio")).alias("step"), "log_ratio", "good")
    rows = sorted((r["step"], r["at"], r["n"], r["g"]) for r in held.groupBy("step").agg(F.min("log_ratio").alias("at"), F.count("*").alias("n"), F.count_if("good").alias("g")).collect())
    good, bad = sum(r[3] for r in rows), sum(r[2] - r[3] for r in rows)
    if not good or not bad:
        return None
    best, at, lost, out = -1.0, rows[0][1], 0, 0
    for _, value, n, g in rows:
        if (now := (good - lost) / good + out / bad) > best:
            best, at = now, value
        lost, out = lost + g, out + n - g
    return at


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096, few: int = 20_000) -> float | None:
    """The exact k-th largest value of a column: histograms narrow the range until few rows are left in it."""
    low, high, n = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    inside, above = df.select(col), 0
    while n > few and low < high:
        step = (high - low) / bins
        bin_of = F.least(F.lit(bins - 1), F.floor((F.col(col) - low) / step)).alias("b")
        found = sorted(inside.groupBy(bin_of).agg(F.count("*").alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect(), key=lambda r: -r["b"])
        for r in found:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["n"] == n and (r["lo"], r["hi"]) == (low, high):
            break
        low, high, n = r["lo"], r["hi"], r["n"]
        inside = df.select(col).where(F.col(col).between(low, high))
    for r in sorted(inside.groupBy(col).count().collect(), key=lambda r: -r[0]):
        above += r[1]
        if above >= k:
            return r[0]
    return low


def gumbel(seed: int) -> F.Column:
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = 1.0, seed: int = 7, **options) -> DataFrame:
    """`(doc_id, log_ratio)` of the documents kept: the k of largest log_ratio + temperature * standard Gumbel noise.

    The noise of a document is fixed by its id and `seed`, so that runs are repeatable.

    Without `k` it is the number of documents whose score is at least the best threshold on the labels; without good
    or without bad labels all stay. Null and empty texts score 0. Rows with a null id are left out. Rows equal to the
    k-th in value stay, so repeated rows share one fate. Other columns are ignored.
    """
    scored = _shared.cut(scores(docs, fit(docs, labels, **options)))
    if k is None:
        at = best_threshold(scored, labels)
        if at is None:
            return scored
        k = scored.where(F.col("log_ratio") >= at).count()
    keyed = scored.withColumn("_key", F.col("log_ratio") + F.lit(temperature) * gumbel(seed))
    least = kth_largest(keyed, "_key", k)
    return keyed.where(F.col("_key") >= F.lit(least if least is not None else math.inf)).drop("_key")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`docs` without the documents that resampling rejects; rows with a null id stay."""
    kept = resample(docs, labels, **options).select(F.col("doc_id").alias("_loom_kept")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_loom_kept"), "left_semi")
    return named.unionByName(docs.where("doc_id is null"))
