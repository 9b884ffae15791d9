"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Text is normalised to lower-case words joined by single spaces; a word is a run of ASCII letters, digits, `_` and
non-ASCII characters. Every window of `n` words that a text shares with an item holds one of the item's pieces of
(n + 1) // 2 words, laid end to end: these are in the automaton, or the whole item where it has fewer than `n` words.
A text is scanned once; a piece found is extended word by word to both sides, and runs of `n` words or more are mapped
back to the original text. The automaton so takes memory in proportion to the items, not to their windows.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _shared

WORD = re.compile("[0-9a-z_\x80-\U0010ffff]+")
_TABLE = bytes(b if b >= 0x80 or b in b"abcdefghijklmnopqrstuvwxyz0123456789_" else 32 for b in range(256))
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())])
_built: dict[str, "Index"] = {}


def normalise(text: str) -> str:
    """The words of a text, each with one space on either side."""
    return (b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" ").decode()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the words in the original text."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    back = [i for i, ch in enumerate(text) for _ in ch.lower()] + [len(text)]  # some letters get longer in lower case
    return [(back[a], back[b - 1] + 1) for a, b in spans]


class Index:
    """The items' words, and the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n = n
        self.words = {i: w for i, w in enumerate(normalise(text).split() for _, text in items) if w}
        self.item = [item for item, _ in items]
        step = (n + 1) // 2
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, w in self.words.items():
            size = step if len(w) >= n else len(w)
            for at in range(0, len(w) - size + 1, size):
                owners[" " + " ".join(w[at : at + size]) + " "].append((i, at))
        self.made = ahocorasick.Automaton()
        for key, who in owners.items():
            self.made.add_word(key, who)
        self.made.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """`(item, start, end, words)`: maximal runs of overlapping or touching windows of each item."""
        norm = normalise(text)
        if len(norm) < 3 or self.made.kind != ahocorasick.AHOCORASICK:
            return []
        hits = list(self.made.iter(norm))
        if not hits:
            return []
        heads = [0]
        at = 0
        while (at := norm.find(" ", at + 1)) > 0:
            heads.append(at)
        words, spans = norm.split(), word_spans(text)
        done: dict[tuple[int, int], int] = {}  # of each item, by how far it is shifted: the last word that was compared
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, who in hits:
            stop = bisect_right(heads, end - 1)
            for i, piece in who:
                own = self.words[i]
                size = min(len(own), (self.n + 1) // 2 if len(own) >= self.n else len(own))
                first, last = stop - size, stop - 1
                shift = first - piece
                if done.get((i, shift), -1) >= last:
                    continue
                if len(own) >= self.n:
                    while first and first - 1 - shift >= 0 and words[first - 1] == own[first - 1 - shift]:
                        first -= 1
                    while last + 1 < len(words) and last + 1 - shift < len(own) and words[last + 1] == own[last + 1 - shift]:
                        last += 1
                done[i, shift] = last
                if last - first + 1 >= min(self.n, len(own)):
                    runs[i].append((first, last))
        out = []
        for i, own in runs.items():
            merged: list[list[int]] = []
            for a, b in sorted(own):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            out += [(self.item[i], spans[a][0], spans[b][1], b - a + 1) for a, b in merged]
        return sorted(out)


def _scan(held, key: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:  # once for each Python worker
            _built.clear()
            _built[key] = Index(held.value, n)
        index = _built[key]
        for b in batches:
            rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for hit in index.find(t)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 5, _OUT)], schema=_OUT)

    return run


def _groups(items: DataFrame, most_bytes: int) -> Iterator[list[tuple[int, str]]]:
    group, size = [], 0
    for item, text in items.toLocalIterator(prefetchPartitions=False):
        if group and size + len(text) > most_bytes:
            yield group
            group, size = [], 0
        group.append((item, text))
        size += len(text)
    yield group


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, item_id, start, end, words)`: character spans [start, end) of documents that hold item passages.

    A passage is `n` words in a row of an item, or all of it where it has fewer, however few. An item's windows that
    touch or overlap are one span. One scan serves items of up to `most_bytes` characters, far more than public
    benchmarks have; a larger table is cut into groups of that size, each with an automaton and scan of its own, so
    that what is broadcast stays bounded. Rows with a null id or text, texts and items without words give nothing.
    Equal items are reported each; equal document rows give equal rows. Other columns are ignored; empty tables give
    no rows.
    """
    spark = docs.sparkSession
    texts = _shared.narrow(docs, id_col, text_col)
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text")).where("item_id is not null and text is not null").distinct()
    parts = [texts.mapInArrow(_scan(spark.sparkContext.broadcast(group), uuid.uuid4().hex, n), "doc_id bigint, item_id bigint, start bigint, end bigint, words bigint") for group in _groups(items, most_bytes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, **options) -> DataFrame:
    """`docs` without the documents that hold a benchmark passage of `least` words or more; rows with a null id or text stay.

    Shorter items, as answers of one word, are in the report of spans but don't condemn a document.
    """
    found = contaminated_spans(docs, benchmark, **options).where(F.col("words") >= least).select("doc_id").distinct()
    return docs.join(found.withColumnRenamed("doc_id", "_loom_found"), docs[options.get("id_col", "doc_id")] == F.col("_loom_found"), "left_anti")


ORACLE = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT item_id, w, len(w) AS m FROM (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(m, 13) AS k, array_to_string(w[s : s + least(m, 13) - 1], ' ') AS gram FROM (SELECT *, unnest(generate_series(1, greatest(m - 12, 1))) AS s FROM items)),
grams AS (SELECT doc_id, k, a, array_to_string(w[a : a + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS a FROM split, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT doc_id, item_id, a, a + k - 1 AS b FROM grams JOIN wins USING (k, gram)),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id, item_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT doc_id, item_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, item_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked) GROUP BY doc_id, item_id, run),
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+|[^0-9a-z_\x{80}-\x{10FFFF}]+') AS p FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM runs))),
placed AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM pieces),
words AS (SELECT doc_id, piece, stop - length(piece) AS start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS w FROM placed WHERE regexp_matches(piece, '^[0-9a-z_\x{80}-\x{10FFFF}]'))
SELECT r.doc_id, r.item_id, CAST(x.start AS BIGINT) AS start, CAST(y.stop AS BIGINT) AS "end", r.b - r.a + 1 AS words
FROM runs r JOIN words x ON x.doc_id = r.doc_id AND x.w = r.a JOIN words y ON y.doc_id = r.doc_id AND y.w = r.b
"""
