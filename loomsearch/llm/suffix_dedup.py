"""Passages that repeat across documents, by a suffix order that is built column by column.

Symbols are words. A passage of `length` words that two documents share has the same seed in both: the k-gram of the
smallest hash within it. So only seeds that occur more than once need a suffix order, and the words around a seed
(`length` - k before it, `length` from it on) hold every passage that has this seed. These contexts, spread by seed,
are the documents of the construction: round by round, from right to left, one symbol of every context is inserted
into the sorted suffixes, known by the Burrows-Wheeler relation: the place of a suffix is that among suffixes with
its first symbol, in the order of what follows. First symbols, links to what follows, and common prefixes are kept in
files in the shared folder, which each round reads and rewrites once from front to end. Runs of suffixes with common
prefixes of `length` words or more that come from two documents or more are repeated passages.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsearch.llm import _shared, _words

_SEEDS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("seed", pa.int64()), ("at", pa.int32())])
_SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_RECORD = np.dtype([("first", np.uint32), ("link", np.uint32), ("context", np.uint32), ("column", np.uint8), ("lcp", np.uint8)])
STEP = 1 << 18


def seeds(chunk: _words.Chunk, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`(row, word in its row, hash)` of the k-gram of smallest hash in each window of `length` words, leftmost on ties."""
    counts = np.diff(chunk.offsets)
    if not len(counts) or counts.max() < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = chunk.hashes
    n = len(h) - k + 1
    grams = np.full(n, 0x9D39247E33776D41, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    grams = _words.mix(grams)
    mask = np.uint64((1 << 24) - 1) if n < 1 << 24 else np.uint64((1 << 32) - 1)
    keys = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    span, low = 1, keys
    width = length - k + 1  # k-grams in a window
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    m = len(keys) - width + 1
    low = np.minimum(low[:m], low[width - span : width - span + m])
    starts = np.arange(m)
    row = np.searchsorted(chunk.offsets, starts, "right") - 1
    inside = starts + length <= chunk.offsets[row + 1]
    at = _words.distinct((low[inside] & mask).astype(np.int64))
    row = np.searchsorted(chunk.offsets, at, "right") - 1
    return row, at - chunk.offsets[row], grams[at]


def _find_seeds(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for chunk in _words.chunks(b.column(2), 1 << 19):
                row, at, seed = seeds(chunk, length, k)
                yield pa.record_batch([pa.array(ids[chunk.first + row]), pa.array(hashes[chunk.first + row]), pa.array(seed.view(np.int64)), pa.array(at.astype(np.int32))], schema=_SEEDS)

    return run


def _cut_contexts(length: int, k: int):
    """From `(doc_id, text_hash, text, seeds, ats)` to `(seed, doc_id, text_hash, first, lead, words)` rows, words as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            offsets = b.column(3).offsets.to_numpy()
            offsets = offsets - offsets[0]
            found = b.column(3).flatten()
            seed, at = found.field(0).to_numpy(zero_copy_only=False), found.field(1).to_numpy(zero_copy_only=False)
            for chunk in _words.chunks(b.column(2), 1 << 19):
                cols: list[list] = [[], [], [], [], []]
                words = (chunk.hashes >> np.uint64(32)).astype(np.uint32)
                for i in range(chunk.rows):
                    r = chunk.first + i
                    own = words[chunk.offsets[i] : chunk.offsets[i + 1]]
                    for s, a in zip(seed[offsets[r] : offsets[r + 1]].tolist(), at[offsets[r] : offsets[r + 1]].tolist()):
                        first = max(0, a - (length - k))
                        for c, v in zip(cols, (s, ids[r], hashes[r], first, own[first : a + length].tobytes())):
                            c.append(v)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["seed", "doc_id", "text_hash", "first", "words"])

    return run


class Files:
    """One sequential file of records in a folder that executors share; a round writes the next one and drops it."""

    def __init__(self, folder: str):
        self.fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        self.base = f"{base}/columns-{uuid.uuid4().hex}"
        self.fs.create_dir(self.base)
        self.round = 0
        self.size = 0

    def read(self) -> Iterator[np.ndarray]:
        if self.size:
            with self.fs.open_input_stream(f"{self.base}/{self.round}") as f:
                while raw := f.read(STEP * _RECORD.itemsize):
                    yield np.frombuffer(raw, _RECORD)

    def write(self, parts: Iterator[np.ndarray]) -> None:
        size = 0
        with self.fs.open_output_stream(f"{self.base}/{self.round + 1}") as f:
            for p in parts:
                f.write(p.tobytes())
                size += len(p)
        if self.round:
            self.fs.delete_file(f"{self.base}/{self.round}")
        self.round, self.size = self.round + 1, size

    def close(self) -> None:
        self.fs.delete_dir(self.base)


def _common(contexts: np.ndarray, sizes: np.ndarray, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths, up to `most`, of suffixes i of contexts a and j of contexts b."""
    out = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    for step in range(most):
        x, y = i[going] + step, j[going] + step
        ok = (x < sizes[a[going]]) & (y < sizes[b[going]])
        going, x, y = going[ok], x[ok], y[ok]
        same = contexts[a[going], x] == contexts[b[going], y]
        going = going[same]
        if not len(going):
            break
        out[going] += 1
    return out


def build(contexts: np.ndarray, sizes: np.ndarray, length: int, files: Files) -> None:
    """Inserts one symbol of every context each round, from its last to its first.

    A context's words are `contexts[i, :sizes[i]]`. Suffixes are ordered by symbols, an end before all of them and
    ends by context. After the last round the file holds all suffixes in order, with the length (up to `length`) of
    the prefix each has in common with the one before.
    """
    n = len(contexts)
    place = np.arange(n, dtype=np.int64)  # of each context's last inserted suffix; at first the empty ones, before all others
    for column in range(int(sizes.max()) - 1, -1, -1):
        # contexts are aligned at their ends: a context joins when its last symbol's turn comes
        step = int(sizes.max()) - 1 - column
        joins = np.flatnonzero(sizes > step)
        at = sizes[joins] - 1 - step
        symbol = contexts[joins, at].astype(np.uint64)
        key = (symbol << np.uint64(32)) | place[joins].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        joins, at, key = joins[order], at[order], key[order]

        # first pass: how many old suffixes are before each new one, and who its neighbours are
        before = np.zeros(len(key), np.int64)
        prev_ctx, prev_col = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        next_ctx, next_col = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        seen = done = 0
        last: tuple[int, int] | None = None
        for part in files.read():  # keys and records are both in order, so each key is looked up in one part only
            old = (part["first"].astype(np.uint64) << np.uint64(32)) | part["link"].astype(np.uint64)
            low, high = (int(x) for x in np.searchsorted(key, old[[0, -1]]))
            between = slice(done, low)
            before[between], next_ctx[between], next_col[between] = seen, part["context"][0], part["column"][0]
            if last is not None:
                prev_ctx[between], prev_col[between] = last
            within = slice(low, high)
            slot = np.searchsorted(old, key[within])
            before[within] = seen + slot
            prev_ctx[within], prev_col[within] = part["context"][slot - 1], part["column"][slot - 1]
            next_ctx[within], next_col[within] = part["context"][slot], part["column"][slot]
            seen, done, last = seen + len(old), high, (int(part["context"][-1]), int(part["column"][-1]))
        before[done:] = seen
        if last is not None:
            prev_ctx[done:], prev_col[done:] = last

        spots = before + np.arange(len(key))  # places in the new order, without the empty suffixes
        # neighbours that are new themselves
        touch = np.flatnonzero(before[1:] == before[:-1])
        prev_ctx[touch + 1], prev_col[touch + 1] = joins[touch], at[touch]
        has = prev_ctx >= 0
        lcp = np.zeros(len(key), np.int64)
        lcp[has] = _common(contexts, sizes, joins[has], at[has], prev_ctx[has], prev_col[has], length)
        lasts = np.ones(len(key), bool)
        lasts[touch] = False  # only the last of new neighbours changes the common prefix of the old one behind
        pushes = lasts & (next_ctx >= 0)
        after = np.zeros(len(key), np.int64)
        after[pushes] = _common(contexts, sizes, joins[pushes], at[pushes], next_ctx[pushes], next_col[pushes], length)

        new = np.zeros(len(key), _RECORD)
        new["first"], new["context"], new["column"], new["lcp"] = key >> np.uint64(32), joins, at, lcp
        link = place[joins]
        ahead = np.cumsum(np.bincount(before, minlength=seen + 1), dtype=np.int64)  # new suffixes up to each old one

        def moved(old_place: np.ndarray, ahead=ahead, n=n) -> np.ndarray:
            """Places after this round of suffixes at places of the round before; empty suffixes stay in front."""
            return np.where(old_place >= n, old_place + ahead[np.maximum(old_place - n, 0)], old_place)

        new["link"] = moved(link)

        def merged() -> Iterator[np.ndarray]:
            start, done = 0, 0
            for part in files.read():
                part = part.copy()
                part["link"] = moved(part["link"].astype(np.int64))
                stop = start + len(part)
                upto = int(np.searchsorted(before, stop, "left"))
                hit = done + np.flatnonzero(pushes[done:upto])
                part["lcp"][before[hit] - start] = after[hit]
                yield np.insert(part, before[done:upto] - start, new[done:upto])
                start, done = stop, upto
            if done < len(new):
                yield new[done:]

        files.write(merged())
        place[joins] = n + spots


def repeated_windows(contexts: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, folder: str) -> np.ndarray:
    """`(context, column)` rows of all windows of `length` words that occur in two documents or more.

    `low` and `high` are the smallest and largest document of each context.
    """
    files = Files(folder)
    try:
        build(contexts, sizes, length, files)
        out: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> None:
            head = rows["lcp"] < length
            head[0] = True
            starts = np.flatnonzero(head)
            ctx = rows["context"].astype(np.int64)
            spread = np.minimum.reduceat(low[ctx], starts) != np.maximum.reduceat(high[ctx], starts)
            fits = sizes[ctx] - rows["column"] >= length
            good = np.repeat(spread, np.diff(np.append(starts, len(rows)))) & fits
            out.append(np.stack([ctx[good], rows["column"][good].astype(np.int64)], 1))

        for part in files.read():
            heads = np.flatnonzero(part["lcp"] < length)
            if len(heads):  # a run of common prefixes may go on in the next part
                settle(np.concatenate([*held, part[: heads[-1]]])) if held or heads[-1] else None
                held = [part[heads[-1] :]]
            else:
                held.append(part)
        if held:
            settle(np.concatenate(held))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    finally:
        files.close()


def _spans(length: int, k: int, folder: str, most: int):
    """Rows of a partition come sorted by seed; contexts are taken in groups of whole seeds, up to about `most` words."""
    width = 2 * length - k

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        sizes_all = np.array([len(r[4]) // 4 for r in rows])
        table = np.zeros((len(rows), width), np.uint32)
        for i, r in enumerate(rows):
            table[i, : sizes_all[i]] = np.frombuffer(r[4], np.uint32)
        # contexts of the same seed and words count once, with all their documents
        doc, seed = np.array([r[1] for r in rows], np.int64), np.array([r[0] for r in rows], np.int64)
        whole = np.concatenate([seed.view(np.uint32).reshape(-1, 2), sizes_all[:, None].astype(np.uint32), table], 1)
        _, lead, of = np.unique(np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
        low, high = np.full(len(lead), np.iinfo(np.int64).max), np.full(len(lead), np.iinfo(np.int64).min)
        np.minimum.at(low, of, doc)
        np.maximum.at(high, of, doc)
        hit = np.zeros((len(lead), width), bool)
        sizes = sizes_all[lead]
        spread = low != high
        hit[spread] = np.arange(width)[None, :] + length <= sizes[spread][:, None]
        # the order is needed where a seed has more than one context
        _, back, many = np.unique(seed[lead], return_inverse=True, return_counts=True)
        several = np.flatnonzero(many[back] > 1)
        if len(several):
            found = repeated_windows(table[lead[several]], sizes[several], low[several], high[several], length, folder)
            hit[several[found[:, 0]], found[:, 1]] = True
        opens = hit.copy()
        opens[:, 1:] &= ~hit[:, :-1]
        closes = hit.copy()
        closes[:, :-1] &= ~hit[:, 1:]
        ctx, start = np.nonzero(opens)
        _, stop = np.nonzero(closes)
        by = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by], np.arange(len(lead) + 1))
        repeat = (edges[1:] - edges[:-1])[ctx]
        row = by[np.repeat(edges[ctx], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)]
        first, text = np.array([r[3] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        cols = [doc[row], text[row], first[row] + np.repeat(start, repeat), first[row] + np.repeat(stop, repeat) + length]
        return pa.record_batch([pa.array(c) for c in cols], schema=_SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if len(rows) * width >= most and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    return run


def repeated_spans(docs: DataFrame, length: int = 50, k: int = 16, most: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, start, end)`: words [start, end) of a document that lie in passages shared with another document.

    A passage is `length` words in a row that also occur in a document of another id; passages that overlap or touch
    are one span. Words are runs of ASCII letters, digits, `_` and non-ASCII characters of the lower-cased text,
    numbered from 0. Texts of fewer words, null ids and null texts have no span. Rows with one id count as one
    document; spans of its texts are given together. Other columns are ignored.
    """
    if not 1 <= k <= length or 2 * length - k > 255:
        raise ValueError("k lies between 1 and length, and 2 * length - k is at most 255")
    spark = docs.sparkSession
    folder = _shared.shared_folder(spark)
    texts = _shared.narrow(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    each = texts.mapInArrow(_find_seeds(length, k), "doc_id bigint, text_hash bigint, seed bigint, at int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    again = each.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")
    recurring = each.join(again, "seed")
    by_doc = recurring.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("seed", "at")).alias("seeds"))
    joined = texts.join(by_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "seeds")
    contexts = joined.mapInArrow(_cut_contexts(length, k), "seed bigint, doc_id bigint, text_hash bigint, first bigint, words binary")
    spans = contexts.repartition(parts, "seed").sortWithinPartitions("seed").mapInArrow(_spans(length, k, folder, most), "doc_id bigint, text_hash bigint, start bigint, end bigint")
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    open_ = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("fresh", F.coalesce(open_, F.lit(True)).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end").distinct()


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT *, unnest(generate_series(0, len(w) - 50)) AS i FROM words WHERE len(w) >= 50)),
shared AS (SELECT h FROM wins GROUP BY h HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT DISTINCT doc_id, i FROM wins SEMI JOIN shared USING (h)),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked)
SELECT doc_id, min(i) AS start, max(i) + 50 AS "end" FROM runs GROUP BY doc_id, run
"""
