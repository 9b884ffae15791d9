"""Line deduplication with a fixed-depth tree of line templates.

A line's tokens are its space-separated words, those with a digit generalised to `<*>`. The tree sends a line by its
number of tokens and its first two tokens to a leaf. In a leaf, lines are taken in order of text: each joins the first
template that agrees with it in enough places (a share of `similarity`, but in all places but one where a line has a
place after its leading tokens to agree in besides), whose other places
become `<*>`, or starts one. A template that occurs in `min_docs` documents or more is dropped from all of them but the
one of smallest doc_id.

Lines are split and hashed in numpy, and texts are read three times: to count the lines of each leaf, as no template of
a leaf with fewer than `min_docs` lines can recur enough; to send the distinct lines of the other leaves, counted within
each task, to their leaf; and to find the places of the lines whose template recurs. Bloom filters keep all other lines
from the shuffles. In a leaf, candidates are found by blocks: of a line with at most m deviating places, one of m + 1
blocks of places is equal.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _bloom, _shared, _words

WILD = "<*>"
_OUT = pa.schema([("line", pa.int64()), ("template_id", pa.string()), ("template", pa.string())])
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\x0b\f\r"]] = True
_DIGIT = np.zeros(256, np.int32)
_DIGIT[[*b"0123456789"]] = 1
DISTINCT = 1 << 17  # lines that a task holds before it sends them


@dataclass
class Lines:
    """The lines of consecutive rows that aren't blank: row, number in it, hash and leaf, and where their tokens are."""

    row: np.ndarray
    number: np.ndarray
    hashes: np.ndarray
    leaf: np.ndarray
    heads: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    digits: np.ndarray
    data: np.ndarray

    def masked(self, i: int) -> str:
        """The tokens of a line, single-spaced, those with digits generalised."""
        at = range(self.heads[i], self.heads[i] + self.counts[i])
        return b" ".join(WILD.encode() if self.digits[k] else self.data[self.starts[k] : self.ends[k]].tobytes() for k in at).decode()


def _hash_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _words._powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return _words.mix((sums[ends] - sums[starts]) * down[starts])


_WILD_HASH = _hash_of(np.frombuffer(WILD.encode(), np.uint8), np.array([0]), np.array([len(WILD)]))[0]


def _split(data: np.ndarray, bounds: np.ndarray, first: int, lead: int) -> Lines:
    n = len(data)
    inside = ~_SPACE[data]
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    edge = bounds[:-1][bounds[:-1] < n]
    opens[:n] = inside
    opens[1:n] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes[1:] = inside
    closes[1:n] &= ~inside[1:]
    later = edge[edge > 0]
    closes[later] = inside[later - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    tokens = _hash_of(data, starts, ends)
    upto = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    digits = upto[ends] > upto[starts]
    tokens[digits] = _WILD_HASH
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    row = np.searchsorted(bounds, starts, "right") - 1
    line = breaks[starts] + row
    heads = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    counts = np.diff(np.append(heads, len(line)))
    place = np.arange(len(line)) - np.repeat(heads, counts)
    parts = _words.mix(tokens ^ _words.mix(place.astype(np.uint64) + np.uint64(0x3C6EF372FE94F82B)))
    hashes = _words.mix(np.add.reduceat(parts, heads) ^ counts.astype(np.uint64)) if len(heads) else np.zeros(0, np.uint64)
    leaf = counts.astype(np.uint64)
    for i in range(lead):
        there = counts > i
        leaf = _words.mix(leaf * np.uint64(0xD6E8FEB86659FD93) + np.where(there, tokens[np.where(there, heads + i, heads)], np.uint64(0)))
    own = row[heads]
    return Lines(first + own, breaks[starts[heads]] - breaks[bounds[own]], hashes.view(np.int64), leaf.view(np.int64), heads, counts, starts, ends, digits, data)


def lines(texts: pa.Array, lead: int, most: int = 1 << 19) -> Iterator[Lines]:
    """Lines of chunks of about `most` bytes; a longer text is a chunk of its own."""
    data, bounds = _words.buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield _split(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i, lead)
        i = j


def _leaf_counts(lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            found, back = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            return found, np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(found)).astype(np.int64)

        for b in batches:
            for own in lines(b.column(0), lead):
                held.append(own.leaf)
                size += len(own.leaf)
                if size > 1 << 20:
                    keys, counts = merge()
                    held, size = [], 0
        keys, counts = merge()
        for i in range(0, len(keys), 1 << 18):
            yield pa.record_batch([pa.array(keys[i : i + (1 << 18)]), pa.array(counts[i : i + (1 << 18)])], names=["leaf", "n"])

    return run


def _distinct(lead: int, full):
    """`(leaf, masked, line, docs)` of the distinct lines of full leaves in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def sent() -> pa.RecordBatch:
            cols = list(zip(*([v[0], v[1], k, v[2]] for k, v in held.items()))) or [[]] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["leaf", "masked", "line", "docs"])

        for b in batches:
            for own in lines(b.column(0), lead):
                good = np.flatnonzero(_bloom.passes(full.value, own.leaf))
                keys, at, n = np.unique(own.hashes[good], return_index=True, return_counts=True)
                for key, i, docs in zip(keys.tolist(), good[at].tolist(), n.tolist()):
                    if key in held:
                        held[key][2] += docs
                    else:
                        held[key] = [int(own.leaf[i]), own.masked(i), docs]
                if len(held) > DISTINCT:
                    yield sent()
                    held.clear()
        yield sent()

    return run


def _places(lead: int, wanted):
    """`(doc_id, text_hash, line_no, line)` of the lines that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for own in lines(b.column(2), lead):
                good = _bloom.passes(wanted.value, own.hashes)
                row = own.row[good]
                yield pa.record_batch([pa.array(ids[row]), pa.array(hashes[row]), pa.array(own.number[good].astype(np.int32)), pa.array(own.hashes[good])], names=["doc_id", "text_hash", "line_no", "line"])

    return run


def blocks(n: int, allowed: int, lead: int) -> list[tuple[int, int]]:
    """`allowed` + 1 ranges of about equal size over the places after the leading ones."""
    free, parts = max(0, n - lead), allowed + 1
    return [(lead + free * i // parts, lead + free * (i + 1) // parts) for i in range(parts)]


def needed(n: int, similarity: float, lead: int) -> int:
    """Places in which a line of n tokens has to agree; one may differ if another after the leading ones is left."""
    need = max(0, -int(-n * similarity // 1))
    return min(need, n - 1) if n >= lead + 2 and similarity < 1 else need


class Leaf:
    """Templates of lines with the same number of tokens and leading tokens."""

    def __init__(self, n: int, similarity: float, lead: int):
        self.n, self.need = n, needed(n, similarity, lead)
        self.blocks = blocks(n, n - self.need, min(lead, n))
        self.templates: list[list[str]] = []
        self.index: dict[tuple, list[int]] = defaultdict(list)

    def add(self, tokens: list[str]) -> int:
        keys = [(i, *tokens[a:b]) for i, (a, b) in enumerate(self.blocks)]
        for t in sorted({t for k in keys for t in self.index.get(k, ())}):
            own = self.templates[t]
            if sum(x == y for x, y in zip(own, tokens)) >= self.need:
                new = self.templates[t] = [x if x == y else WILD for x, y in zip(own, tokens)]
                for i, (a, b) in enumerate(self.blocks):
                    if new[a:b] != own[a:b]:  # a line may agree with the wild place
                        self.index[i, *new[a:b]].append(t)
                return t
        self.templates.append(list(tokens))
        for k in keys:
            self.index[k].append(len(self.templates) - 1)
        return len(self.templates) - 1


class Clustering:
    """Puts the lines of one leaf, which come in order of text, into templates. Held are templates and two numbers a line."""

    def __init__(self, similarity: float, lead: int, least: int):
        self.similarity, self.lead, self.least = similarity, lead, least
        self.leaf: Leaf | None = None
        self.lines, self.where = array("q"), array("q")
        self.totals, self.firsts = array("q"), []

    def add(self, text: str, line: int, docs: int) -> None:
        tokens = text.split(" ")
        self.leaf = self.leaf or Leaf(len(tokens), self.similarity, self.lead)
        t = self.leaf.add(tokens)
        if t == len(self.totals):
            self.totals.append(0)
            self.firsts.append(text)
        self.totals[t] += docs
        self.lines.append(line)
        self.where.append(t)

    def rows(self) -> Iterator[tuple[int, str, str]]:
        """`(line hash, template id, template)` of lines whose template may recur enough."""
        for line, t in zip(self.lines, self.where):
            if self.totals[t] >= self.least:
                yield line, self.firsts[t], " ".join(self.leaf.templates[t])


def _cluster(similarity: float, lead: int, least: int):
    """Rows come by leaf and text; equal ones of several tasks follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[int, str, str]]:
            here, own, last = None, None, None
            for b in batches:
                for leaf, text, line, docs in zip(*(c.to_pylist() for c in b.columns)):
                    if last and (leaf, text) == last[:2]:
                        last = (leaf, text, line, last[3] + docs)
                        continue
                    if last:
                        own.add(*last[1:])
                    if leaf != here:
                        yield from own.rows() if own else ()
                        here, own = leaf, Clustering(similarity, lead, least)
                    last = (leaf, text, line, docs)
            if last:
                own.add(*last[1:])
                yield from own.rows()

        out: list[tuple[int, str, str]] = []
        for row in found():
            out.append(row)
            if len(out) >= 5000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)

    return run


def _found(docs: DataFrame, min_docs: int, similarity: float, lead: int) -> DataFrame:
    spark = docs.sparkSession
    texts = _shared.narrow(docs)
    counted = texts.select("text").mapInArrow(_leaf_counts(lead), "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n"))
    full = spark.sparkContext.broadcast(_bloom.build(_shared.cut(counted.where(F.col("n") >= min_docs).select("leaf"))))
    distinct = texts.select("text").mapInArrow(_distinct(lead, full), "leaf bigint, masked string, line bigint, docs bigint")
    sorted_ = distinct.repartition("leaf").sortWithinPartitions("leaf", "masked")
    templates = _shared.cut(sorted_.mapInArrow(_cluster(similarity, lead, min_docs), "line bigint, template_id string, template string"))
    wanted = spark.sparkContext.broadcast(_bloom.build(templates.select("line")))
    # a template's documents are counted exactly: its lines may come from one document
    each = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_places(lead, wanted), "doc_id bigint, text_hash bigint, line_no int, line bigint")
    hits = _shared.cut(each.join(templates, "line").drop("line"))
    spread = hits.groupBy("template_id").agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    return hits.join(spread, "template_id").where(F.col("doc_id") != F.col("first"))


def dropped_lines(docs: DataFrame, min_docs: int = 10, similarity: float = 0.9, lead: int = 2) -> DataFrame:
    """`(doc_id, line_no, template, docs)`: lines, numbered from 0, that recur across documents and are dropped.

    Blank lines never are. The document of smallest doc_id with a template keeps all its lines of that template. Rows
    with a null id or text have no lines; rows with equal ids count as one document. Other columns are ignored.
    """
    return _found(docs, min_docs, similarity, lead).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "template", "docs")


def drop_recurring(docs: DataFrame, min_docs: int = 10, similarity: float = 0.9, lead: int = 2) -> DataFrame:
    """`docs` with recurring lines cut from `text` and `n_chars` adapted, where it is a column.

    A document left with blank lines only is dropped; one that was blank or null before stays, as do rows with a null id.
    """
    found = _found(docs, min_docs, similarity, lead).groupBy(F.col("doc_id").alias("_loom_id"), F.col("text_hash").alias("_loom_hash")).agg(F.collect_set("line_no").alias("_loom_gone"))
    joined = docs.join(found, (F.col("doc_id") == F.col("_loom_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_loom_hash")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_loom_gone", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("_loom_gone").isNull(), F.col("text")).otherwise(kept)).where(F.col("_loom_gone").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_loom_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
