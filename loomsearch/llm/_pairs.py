"""Pairs of keys that share tokens, counted exactly, with packed rows through two shuffles.

Tokens are 64-bit numbers whose low 58 bits are hashed. Each task packs its tokens by bucket into binary rows, as a
row for each token would cost several times the bytes. A bucket's task finds runs of equal tokens, pairs the keys in
them and packs the pairs with their counts, by the key that comes first; the last task adds up and filters. Pairs are
packed as differences, for in a group of copies each key has all the others next to it. Each key comes with its size.

Keys of one label are known to be linked, and aren't paired: n near copies would give n * n / 2 pairs for each token
that they share. A task packs what it has counted whenever it holds about `PAIRS` pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "bucket int, payload binary"
PAIRS = 1 << 20
_SCHEMA = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
_PAIRS = pa.schema([("key_a", pa.int64()), ("key_b", pa.int64()), ("shared", pa.int64())])
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _small(arrays: list[np.ndarray]) -> bytes:
    """Compressed bytes of uint32 arrays, first bytes first, as most are small numbers."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for x in arrays))


def _large(data: bytes, sizes: list[int]) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), 0, []
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view(np.uint32).ravel())
        at += 4 * n
    return out


def buckets(spark: SparkSession, parts: int) -> list[int]:
    """Numbers of which Spark's hash partitioning sends one to each of `parts` partitions."""
    ids = spark.range(0, 40 * parts + 400).select(F.col("id").cast("int").alias("id")).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
    found = {r["p"]: r["id"] for r in ids.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(p, p) for p in range(parts)]


def _named(keys: np.ndarray) -> bytes:
    """Keys as they are, or by differences where they ascend in small steps, as numbers given in order do."""
    steps = np.diff(keys)
    if len(keys) > 1 and steps.min() > 0 and steps.max() < 1 << 32:
        near = _small([steps])
        return np.array([len(near)], np.uint32).tobytes() + keys[:1].tobytes() + near
    return np.zeros(1, np.uint32).tobytes() + keys.tobytes()


def _names(payload: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """`(keys, where they end)`."""
    size = int(np.frombuffer(payload, np.uint32, 1, at)[0])
    if not size:
        return np.frombuffer(payload, np.int64, n, at + 4), at + 4 + 8 * n
    first = int(np.frombuffer(payload, np.int64, 1, at + 4)[0])
    (steps,) = _large(payload[at + 12 : at + 12 + size], [n - 1])
    return first + np.concatenate([[0], np.cumsum(steps.astype(np.int64))]), at + 12 + size


class Packer:
    """Collects `(key, tokens)` of a task and packs them by bucket, with the place of each token in its key if `placed`."""

    def __init__(self, numbers: list[int], placed: bool = False, most: int = 1 << 20):
        self.numbers, self.placed, self.most = np.array(numbers, np.int32), placed, most
        self.seen: dict[int, np.ndarray] = {}
        self.sizes: list[int] = []
        self.held = 0

    def add(self, key: int, tokens: np.ndarray, size: int = 0) -> None:
        """A key that the task had before (an identical group, known by 64 bits of hash) isn't packed again."""
        if key not in self.seen:
            self.seen[key] = tokens
            self.sizes.append(size)
            self.held += len(tokens)

    def full(self) -> bool:
        return self.held >= self.most

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, sizes = np.array(list(self.seen), np.int64), np.array(self.sizes, np.int64)
            lengths = np.array([len(t) for t in self.seen.values()])
            own = np.repeat(np.arange(len(keys)), lengths)
            tok = np.concatenate(list(self.seen.values()))
            at = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            part = ((tok >> np.uint64(40)) & np.uint64((1 << 18) - 1)).astype(np.int64) % len(self.numbers)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(len(self.numbers) + 1))
            tok, own, at = tok[order], own[order], at[order]
            for p in np.flatnonzero(np.diff(edges)):
                a, b = edges[p], edges[p + 1]
                here, counts = np.unique(own[a:b], return_counts=True)
                t = tok[a:b]
                steps = np.diff(at[a:b], prepend=0)
                starts = np.cumsum(counts) - counts
                steps[starts] = at[a:b][starts]
                times = _small([counts, sizes[here], *([steps] if self.placed else [])])
                head = np.array([len(here), b - a, len(times)], np.uint32).tobytes() + _named(keys[here])
                body = [(t & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((t >> np.uint64(32)) & np.uint64(255)).astype(np.uint8).tobytes()]
                yield pa.record_batch([pa.array([self.numbers[p]], pa.int32()), pa.array([b"".join([head, *body, times])], pa.binary())], schema=_SCHEMA)
        self.seen, self.sizes, self.held = {}, [], 0


def _unpack(payload: bytes, placed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`(keys, their sizes, owner of each token, tokens, places)`."""
    n, m, size = (int(x) for x in np.frombuffer(payload, np.uint32, 3))
    keys, at = _names(payload, n, 12)
    low, high = np.frombuffer(payload, np.uint32, m, at), np.frombuffer(payload, np.uint8, m, at + 4 * m)
    counts, sizes, *steps = (x.astype(np.int64) for x in _large(payload[len(payload) - size :], [n, n, m] if placed else [n, n]))
    own, places = np.repeat(np.arange(n), counts), np.zeros(m, np.int32)
    if placed:
        total, starts = np.cumsum(steps[0]), np.cumsum(counts) - counts
        places = (total - np.repeat(total[starts] - steps[0][starts], counts)).astype(np.int32)
    return keys, sizes, own, low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)), places


def pack_pairs(keys: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, counts: np.ndarray, proof: np.ndarray) -> bytes:
    """Pairs `a < b` of places in `keys`, sorted by a, then b, with their counts and whether there is evidence."""
    here, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    fresh = np.concatenate([[True], x[1:] != x[:-1]])
    ahead = y - np.where(fresh, x, np.concatenate([[0], y[:-1]]))
    return np.array([len(here), len(a)], np.uint32).tobytes() + _named(keys[here]) + _small([sizes[here], np.diff(x, prepend=0), ahead, counts, proof])


def unpack_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`(keys, their sizes, a, b, counts, proof)`."""
    n, m = (int(x) for x in np.frombuffer(payload, np.uint32, 2))
    keys, at = _names(payload, n, 8)
    sizes, step, ahead, counts, proof = (x.astype(np.int64) for x in _large(payload[at:], [n] + [m] * 4))
    a, total = np.cumsum(step), np.cumsum(ahead)
    starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    base = a[starts] + ahead[starts] - total[starts]
    return keys, sizes, a, total + np.repeat(base, np.diff(np.append(starts, m))), counts, proof


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of `n` nodes the smallest node that edges `(a, b)` lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(label, end, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        if np.array_equal(before, label):
            return label


class _Counter:
    """Counts of pairs as `first * width + second`."""

    def __init__(self, most: int = 1 << 22):
        self.parts: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.held, self.most, self.distinct = 0, most, 0

    def add(self, codes: np.ndarray) -> None:
        self.parts.append((codes, None))
        self.held += len(codes)
        if self.held > self.most:
            codes, counts = self.total()
            self.parts, self.held, self.distinct = [(codes, counts)], 0, len(codes)

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        fresh = [c for c, n in self.parts if n is None]
        old = [(c, n) for c, n in self.parts if n is not None]
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if fresh:  # a plain sort is many times faster than `np.unique`
            codes = np.sort(np.concatenate(fresh))
            at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else counts
            codes, counts = codes[at], np.diff(np.append(at, len(codes)))
        for c, n in old:
            both = np.concatenate([codes, c])
            codes, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
        return codes, counts


def _run_pairs(tok: np.ndarray, own: np.ndarray, places: np.ndarray, sizes: np.ndarray, labels: np.ndarray, ratio: float, evident: Callable | None, width: int) -> Iterator[np.ndarray]:
    """Pairs of owners of equal tokens with the smaller size at least `ratio` of the larger and unlike labels.

    Owners are by size. A pair is coded as twice its number, and one more where the token is evidence.
    """
    order = np.lexsort((own, labels[own], tok))
    tok, own, places = tok[order], own[order], places[order]
    fresh = np.ones(len(tok), bool)
    fresh[1:] = (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])  # an owner packed by several tasks counts once
    tok, own, places = tok[fresh], own[fresh].astype(np.int64), places[fresh]
    if not len(tok):
        return
    ends, differs = [], tok[1:] != tok[:-1]
    for change in (differs, differs | (labels[own[1:]] != labels[own[:-1]])):
        edge = np.flatnonzero(np.concatenate([[True], change, [True]]))
        ends.append(np.repeat(edge[1:], np.diff(edge)))
    # each element is paired with those of its run that come after the ones of its label
    at = np.flatnonzero(ends[0] > ends[1])
    begin_at, after = ends[1][at], (ends[0] - ends[1])[at]
    begin, steps = 0, np.cumsum(after)
    while begin < len(at):
        done = steps[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(steps, done + (1 << 20), "right")))
        n = after[begin:end]
        a = np.repeat(at[begin:end], n)
        b = np.repeat(begin_at[begin:end] - (np.cumsum(n) - n), n) + np.arange(len(a))
        a, b = np.where(own[a] < own[b], a, b), np.where(own[a] < own[b], b, a)
        x, y = own[a], own[b]
        fits = sizes[x] >= ratio * sizes[y] - 1e-9
        x, y = x[fits], y[fits]
        proof = 1 if evident is None else evident(sizes[x], sizes[y], places[a[fits]], places[b[fits]])
        yield (x * width + y) * 2 + proof
        begin = end


def _count(numbers: list[int], ratio: float, evident: Callable | None, labels):
    marks = np.array(numbers, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpack(p.as_buffer().to_pybytes(), evident is not None) for b in batches for p in b.column(1)]
        if not parts:
            return
        keys = np.concatenate([p[0] for p in parts])
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        own = np.concatenate([p[2] + s for p, s in zip(parts, shift)])
        tok, places = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        key_of, lead, of = np.unique(keys, return_index=True, return_inverse=True)
        size_of = np.concatenate([p[1] for p in parts])[lead]
        del parts
        order = np.lexsort((key_of, size_of))  # the same order of keys in all tasks: by size, then key
        key_of, size_of = key_of[order], size_of[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        width = len(key_of)
        label_of = np.arange(width)
        if labels is not None and len(labels.value[0]):
            known, label = labels.value
            near = np.minimum(np.searchsorted(known, key_of), len(known) - 1)
            label_of = np.where(known[near] == key_of, width + label[near], label_of)

        def packed(counter: _Counter) -> Iterator[pa.RecordBatch]:
            codes, counts = counter.total()
            proof, codes = codes & 1, codes >> 1
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            if len(codes):
                codes, counts, proof = codes[first], np.add.reduceat(counts, first), np.maximum.reduceat(proof, first)
            a, b = codes // width, codes % width
            part = (key_of[a].astype(np.uint64) % np.uint64(1000003)).astype(np.int64) % len(marks)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(len(marks) + 1))
            for p, (s, e) in enumerate(zip(edges, edges[1:])):
                if s < e:
                    own = order[s:e]
                    yield pa.record_batch([pa.array([marks[p]], pa.int32()), pa.array([pack_pairs(key_of, size_of, a[own], b[own], counts[own], proof[own])], pa.binary())], schema=_SCHEMA)

        counter = _Counter(PAIRS)
        for codes in _run_pairs(tok, place[of[own]], places, size_of, label_of, ratio, evident, width):
            counter.add(codes)
            if counter.distinct > PAIRS:  # the next task adds up
                yield from packed(counter)
                counter = _Counter(PAIRS)
        yield from packed(counter)

    return run


def _add_up(keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], edges_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_pairs(p.as_buffer().to_pybytes()) for b in batches for p in b.column(1)]
        if not parts:
            return
        keys, lead = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
        sizes = np.concatenate([p[1] for p in parts])[lead]
        codes, counts, proofs = (np.zeros(0, np.int64) for _ in range(3))
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            found, back = np.unique(np.concatenate([codes, *(x[0] for x in pending)]), return_inverse=True)
            sums = [np.bincount(back, weights=np.concatenate([y, *(x[i] for x in pending)]), minlength=len(found)).astype(np.int64) for i, y in ((1, counts), (2, proofs))]
            return found, *sums

        while parts:
            k, _, a, b, n, proof = parts.pop()
            of = np.searchsorted(keys, k)
            pending.append((of[a] * len(keys) + of[b], n, proof))
            held += len(n)
            if held > 1 << 21:
                codes, counts, proofs = merge()
                pending, held = [], 0
        codes, counts, proofs = merge()
        a, b = codes // len(keys), codes % len(keys)
        good = (proofs > 0) & keep(sizes[a], sizes[b], counts)
        a, b, counts = a[good], b[good], counts[good]
        if edges_only:
            low = forest(len(keys), a, b)
            node = np.flatnonzero(low != np.arange(len(keys)))
            columns, schema = [keys[node], keys[low[node]]], _EDGES
        else:
            columns, schema = [keys[a], keys[b], counts], _PAIRS
        for i in range(0, len(columns[0]), 1 << 16):
            yield pa.record_batch([pa.array(c[i : i + (1 << 16)]) for c in columns], schema=schema)

    return run


def sharing_pairs(packed: DataFrame, numbers: list[int], ratio: float, keep: Callable, evident: Callable | None = None, edges_only: bool = False, labels=None) -> DataFrame:
    """`(key_a, key_b, shared)`, each pair of keys once, where `keep(size_a, size_b, shared)` holds.

    With `evident(size_a, size_b, place_a, place_b)` it must hold for one of the shared tokens; tokens are then packed
    with their places.

    `labels` is a broadcast of `(keys, labels)`, by key and with labels from 0 on: keys of one label aren't paired.

    With `edges_only`, `(a, b)` edges that link the same keys as those pairs do, no more than keys in each task.
    """
    parts = len(numbers)
    counted = packed.repartition(parts, "bucket").mapInArrow(_count(numbers, ratio, evident, labels), PACKED)
    out = "a bigint, b bigint" if edges_only else "key_a bigint, key_b bigint, shared bigint"
    return counted.repartition(parts, "bucket").mapInArrow(_add_up(keep, edges_only), out)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [_unpack(p.as_buffer().to_pybytes(), False) for b in batches for p in b.column(1)]
    if not parts:
        return
    keys, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    shift = np.cumsum([0, *(len(p[0]) for p in parts)])
    own, tok = of[np.concatenate([p[2] + s for p, s in zip(parts, shift)])], np.concatenate([p[3] for p in parts])
    del parts
    order = np.argsort(tok, kind="stable")
    tok, own = tok[order], own[order]
    starts = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
    first = np.repeat(own[starts], np.diff(np.append(starts, len(tok))))
    low = forest(len(keys), own, first)
    node = np.flatnonzero(low != np.arange(len(keys)))
    for i in range(0, len(node), 1 << 16):
        part = node[i : i + (1 << 16)]
        yield pa.record_batch([pa.array(keys[part]), pa.array(keys[low[part]])], schema=_EDGES)


def sharing_edges(packed: DataFrame, numbers: list[int]) -> DataFrame:
    """`(a, b)` edges that link the same keys as shared tokens do, no more than keys in each bucket; no pair is counted."""
    return packed.repartition(len(numbers), "bucket").mapInArrow(_edges, "a bigint, b bigint")


LINKS = "a bigint, b bigint, links bigint, best double"
_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64()), ("best", pa.float64())])


class Links:
    """Sums up the links of a task: how many documents each node is linked to, the best score, and a forest of edges."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held = most, 0
        self.pending: list[tuple[np.ndarray, ...]] = []
        self.nodes, self.links, self.best, self.low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, docs_a: np.ndarray, docs_b: np.ndarray, score: np.ndarray) -> None:
        """Links between nodes a and b, which stand for so many documents."""
        self.pending.append((a, b, docs_a, docs_b, score))
        self.held += len(a)
        if self.held >= self.most:
            self._settle()

    def _settle(self) -> None:
        if not self.held:
            return
        a, b, docs_a, docs_b, score = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.held = [], 0
        ends = np.concatenate([a, b, self.nodes, self.low])
        nodes, at = np.unique(ends, return_inverse=True)
        m, k = len(a), len(self.nodes)
        x, y, old, low = at[:m], at[m : 2 * m], at[2 * m : 2 * m + k], at[2 * m + k :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, np.concatenate([x, y, old]), np.concatenate([docs_b, docs_a, self.links]))
        best = np.zeros(len(nodes))
        np.maximum.at(best, np.concatenate([x, y, old]), np.concatenate([score, score, self.best]))
        self.low = nodes[forest(len(nodes), np.concatenate([x, old]), np.concatenate([y, low]))]
        self.nodes, self.links, self.best = nodes, links, best

    def rows(self) -> Iterator[pa.RecordBatch]:
        """`(node, null, links, best)` of each node, and `(node, lower node, null, null)` edges."""
        self._settle()
        for i in range(0, len(self.nodes), 1 << 16):
            part = slice(i, i + (1 << 16))
            node = self.nodes[part]
            yield pa.record_batch([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(self.links[part]), pa.array(self.best[part])], schema=_LINKED)
            edge = node != self.low[part]
            yield pa.record_batch([pa.array(node[edge]), pa.array(self.low[part][edge]), pa.nulls(int(edge.sum()), pa.int64()), pa.nulls(int(edge.sum()), pa.float64())], schema=_LINKED)
