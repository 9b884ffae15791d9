"""Near duplicates by an exact n-gram Jaccard join with grouped prefixes.

A document is the set of its n-grams of words. In one global order of grams (rare before frequent, by a count sketch)
two sets with Jaccard similarity of `t` or more share a gram within their prefixes of size - ceil(t * size) + 1 grams.
Documents with the same prefix and size form one group, known by a 64-bit hash of both; groups are paired over their
prefix grams. A pair of groups of sizes x and y stays only if the shared prefix grams, with all that may lie behind the
prefixes, can reach the overlap need = t / (1 + t) * (x + y), and one of them is among the first x - need + 1 and
y - need + 1 grams. Groups of which sets agree in four minima of hashes at once are linked beforehand: in large
clusters of near copies that links nearly all, so these aren't paired for each of the many grams they share.

Groups that such pairs link are expanded together: each distinct gram set of their members goes once, with
its documents counted, to the block of its component, where all pairs are verified on the full sets. So the pairs
themselves are never moved, only edges that link the same groups, and sums of links by set. A large component is cut
into parts, with a block for each two.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _pairs, _shared, _words

_GROUPS = pa.schema([("doc_id", pa.int64()), ("group", pa.int64()), ("set", pa.int64()), ("size", pa.int64()), ("bands", pa.binary())])
_BAND = pa.schema([("group", pa.int64()), ("band", pa.int64())])
_SETS = pa.schema([("set", pa.int64()), ("grams", pa.binary())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
TOKENS = 1 << 20  # prefix grams of a bucket, about
BANDS, ROWS = 8, 4  # of minima of hashes
LARGE, LABELLED = 16, 1 << 22  # least groups of a cluster that is linked beforehand; groups in all
PART_SETS, PART_BYTES = 1024, 16 << 20  # of a block
TILE, SLAB = 256, 8192


def _hash(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for p in parts:
        h.update(p)
    return int.from_bytes(h.digest(), "little", signed=True)


def prefix_size(n, t: float):
    """Grams of a set of `n` that are enough to meet every set with similarity `t`."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _sketch(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            for chunk in _words.chunks(b.column(0), 1 << 18):
                grams, _ = _words.ngrams(chunk, n)
                total += np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def gram_grades(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Frequency grade, 0 to 63, of each sketch bucket, and the number of grams. Only the join's speed hangs on them.

    The sketch has 2**18 to 2**24 buckets by the number of documents, so its size is bounded.
    """
    bits = int(np.clip(math.log2(max(docs.count(), 1)), 18, 24))
    found = docs.select("text").mapInArrow(_sketch(n, bits), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    mean = counts.mean()
    return np.clip(8 * np.log2(1 + np.maximum(0, counts - mean) / math.sqrt(mean + 1)), 0, 63).astype(np.uint8), int(counts.sum())


def gram_sets(texts: pa.Array, n: int, grades: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """`(row, distinct grams in the global order)`; a gram is its grade in 6 bits, then 58 bits of its hash."""
    bits = len(grades).bit_length() - 1
    for chunk in _words.chunks(texts, 1 << 18):
        grams, off = _words.ngrams(chunk, n)
        keys = (grades[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6))
        for i in range(chunk.rows):
            own = keys[off[i] : off[i + 1]]
            own.sort()
            yield chunk.first + i, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _group_of(grams: np.ndarray, t: float) -> tuple[int, np.ndarray]:
    prefix = grams[: int(prefix_size(np.array(len(grams)), t))]
    return _hash(len(grams).to_bytes(8, "little"), prefix.tobytes()), prefix


def _prefixes(n: int, t: float, grades, numbers: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _pairs.Packer(numbers, placed=True)
        for b in batches:
            for _, grams in gram_sets(b.column(0), n, grades.value):
                if len(grams):
                    packer.add(*_group_of(grams, t), len(grams))
                    if packer.full():
                        yield from packer.flush()
        yield from packer.flush()

    return run


_FACTORS = _words.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def bands(grams: np.ndarray) -> np.ndarray:
    """Hashes of `ROWS` minima each; sets with Jaccard similarity s agree in one with probability s**`ROWS`."""
    x, least = grams << np.uint64(6), np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(x), 4096):
        least = np.minimum(least, (x[None, i : i + 4096] * _FACTORS[:, None]).min(1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = _words.mix(out * np.uint64(0xD6E8FEB86659FD93) + row)
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        groups = np.repeat(b.column(0).to_numpy(), BANDS)
        yield pa.record_batch([pa.array(groups), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], schema=_BAND)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by band; edges between neighbours of one band."""
    group, band = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        group, band = (np.concatenate([x[-1:], c.to_numpy()]) for x, c in zip((group, band), b.columns))
        same = (band[1:] == band[:-1]) & (group[1:] != group[:-1])
        yield pa.record_batch([pa.array(group[:-1][same]), pa.array(group[1:][same])], schema=_LINKS)


def clusters(sets: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Edges `(a, b)` between groups of `(group, bands)` rows that share a band, and the labels of large clusters.

    A label only spares pairs: the groups of one are linked by the edges. Those of the largest clusters are given.
    """
    rows = sets.mapInArrow(_banded, "group bigint, band bigint").repartition("band").sortWithinPartitions("band", "group")
    edges = _shared.cut(rows.mapInArrow(_chained, "a bigint, b bigint").distinct())
    node = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    placed = _shared.cut(components(edges, node))
    large = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= LARGE)
    found = placed.join(large, "component").orderBy(F.desc("n"), "component").limit(LABELLED).select("node", "component").toArrow()
    node, component = found["node"].to_numpy(), found["component"].to_numpy()
    order = np.argsort(node)
    kept = edges.join(placed.join(large, "component").select(F.col("node").alias("a")), "a", "left_semi")
    return kept, (node[order], np.unique(component, return_inverse=True)[1][order].astype(np.int64))


def _groups(n: int, t: float, grades):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[i], _group_of(g, t)[0], _hash(g.tobytes()), len(g), bands(g).tobytes()) for i, g in gram_sets(b.column(1), n, grades.value) if len(g)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 5, _GROUPS)], schema=_GROUPS)

    return run


def _places(sets: np.ndarray, reps: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of a Bloom filter for a set and the document that stands for it."""
    x = _words.mix(sets.astype(np.int64).view(np.uint64) ^ _words.mix(reps.astype(np.int64).view(np.uint64)))
    return [((x >> np.uint64(16 * i)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64) for i in range(3)]


def _bits(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(), b.column(1).to_numpy(), bits):
                held[at] = True
        at = np.flatnonzero(held) // 64
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.unique(at)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(words[at])], names=["at", "word"])

    return run


def wanted_filter(wanted: DataFrame, most: int = 27) -> np.ndarray:
    """Bloom filter of `(set, rep)` rows, of 2**`most` bits at most; beyond, more sets pass it that a join then drops."""
    bits = int(np.clip(math.ceil(math.log2(max(wanted.count(), 1) * 12)), 10, most))
    found = wanted.mapInArrow(_bits(bits), "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros((1 << bits) // 64, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)


def _short(grams: np.ndarray) -> bytes:
    """48 bits of each gram, which tell the grams of two sets apart."""
    return (grams & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def _sets(n: int, grades, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = wanted.value
        bits = len(held).bit_length() - 1
        for b in batches:
            ids, names, grams_of = b.column(0).to_numpy(), [], []
            rows = []
            for i, g in gram_sets(b.column(1), n, grades.value):
                if len(g):
                    names.append(_hash(g.tobytes()))
                    grams_of.append(g)
                    rows.append(ids[i])
            if not names:
                continue
            places = _places(np.array(names, np.int64), np.array(rows, np.int64), bits)
            passed = np.flatnonzero(held[places[0]] & held[places[1]] & held[places[2]])
            yield pa.record_batch([pa.array([names[i] for i in passed], pa.int64()), pa.array([_short(grams_of[i]) for i in passed], pa.binary())], schema=_SETS)

    return run


def _reaches(t: float):
    def keep(x: np.ndarray, y: np.ndarray, shared: np.ndarray) -> np.ndarray:
        behind = np.maximum(x - prefix_size(x, t), y - prefix_size(y, t))
        return shared + behind >= np.ceil(t / (1 + t) * (x + y) - 1e-9)

    return keep


def _evident(t: float):
    """Sets with an overlap of `need` share a gram among the first size - need + 1 of both."""

    def holds(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = np.ceil(t / (1 + t) * (x + y) - 1e-9)
        return (i <= x - need) & (j <= y - need)

    return holds


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, as products of 0-1 matrices over the grams that both have."""
    out = np.zeros((len(x), len(y)), np.float32)
    a, b = np.concatenate(x), np.concatenate(y)
    own_a, own_b = (np.repeat(np.arange(len(s)), [len(g) for g in s]) for s in (x, y))
    both = np.intersect1d(a, b)
    if not len(both):
        return out

    def placed(g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, g), len(both) - 1)
        hit = both[at] == g
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], own[hit][order]

    (col_a, own_a), (col_b, own_b) = placed(a, own_a), placed(b, own_b)
    for low in range(0, len(both), SLAB):
        width = min(SLAB, len(both) - low)
        m = []
        for col, own, n in ((col_a, own_a, len(x)), (col_b, own_b, len(y))):
            s, e = np.searchsorted(col, (low, low + width))
            one = np.zeros((n, width), np.float32)
            one[own[s:e], col[s:e] - low] = 1
            m.append(one)
        out += m[0] @ m[1].T
    return out


def similar(sets: list[np.ndarray], side: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`(i, j, jaccard)` of the similar ones among sets ordered by size; where `side` is -1 or 1, one of either."""
    sizes = np.array([len(s) for s in sets])
    cross = side.any()
    for i in range(0, len(sets), TILE):
        for j in range(i, len(sets), TILE):
            if sizes[min(i + TILE, len(sets)) - 1] < t * sizes[j] - 1e-9:
                break
            shared = overlaps(sets[i : i + TILE], sets[j : j + TILE])
            x, y = sizes[i : i + TILE, None], sizes[None, j : j + TILE]
            good = shared >= t * (x + y - shared) - 1e-6
            if i == j:
                good &= np.arange(good.shape[0])[:, None] < np.arange(good.shape[1])[None, :]
            if cross:
                good &= side[i : i + TILE, None] != side[None, j : j + TILE]
            a, b = np.nonzero(good)
            if len(a):
                n = shared[a, b].astype(np.float64)
                yield i + a, j + b, n / (sizes[i + a] + sizes[j + b] - n)


def _verify(t: float):
    """Rows come by block and size: `(block, side, set, grams, n)`; gives sums of links and edges between sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _pairs.Links()

        def solve(rows: list[tuple]) -> None:
            sets, names, n = [_long(r[3]) for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
            for s in sets:
                s.sort()
            for i, j, jaccard in similar(sets, np.array([r[1] for r in rows]), t):
                links.add(names[i], names[j], n[i], n[j], np.round(jaccard, 6))

        here, rows = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != here:
                    if rows:
                        solve(rows)
                    here, rows = row[0], []
                rows.append(row)
        if rows:
            solve(rows)
        yield from links.rows()

    return run


def similar_sets(docs: DataFrame, t: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All similar pairs of distinct gram sets, summed up by set.

    `(set, doc_id)` of all documents, `(set, rep, n)` of the sets with their smallest document and the number of their
    documents, and `_pairs.LINKS` rows: documents linked to a set and its greatest similarity, and edges between sets.
    """
    if not 0 < t <= 1:
        raise ValueError("the threshold lies in (0, 1]")
    spark = docs.sparkSession
    texts = _shared.narrow(docs)
    grades, total = gram_grades(texts, n)
    grades = spark.sparkContext.broadcast(grades)
    numbers = _pairs.buckets(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * (1 - t) / TOKENS)))
    grouped = texts.mapInArrow(_groups(n, t, grades), "doc_id bigint, group bigint, set bigint, size bigint, bands binary").dropDuplicates(["set", "doc_id"])
    members = _shared.cut(grouped)
    sets = _shared.cut(members.groupBy("set").agg(F.min("doc_id").alias("rep"), F.min("group").alias("group"), F.min("size").alias("size"), F.count("*").alias("n"), F.min("bands").alias("bands")))
    known, labels = clusters(sets.select("group", "bands"))

    packed = texts.select("text").mapInArrow(_prefixes(n, t, grades, numbers), _pairs.PACKED)
    paired = _pairs.sharing_pairs(packed, numbers, t, _reaches(t), _evident(t), edges_only=True, labels=spark.sparkContext.broadcast(labels))
    edges = _shared.cut(paired.unionByName(known))
    linked = components(edges, edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct())

    # expansion: the sets of linked groups, and of one group where its members differ behind the prefix, by component
    placed = sets.join(linked.withColumnRenamed("node", "group"), "group", "left").withColumn("component", F.coalesce("component", "group"))
    loads = placed.groupBy("component").agg(F.count("*").alias("sets"), F.sum("size").alias("grams")).where("sets > 1")
    parts = F.greatest(F.ceil(F.col("sets") / PART_SETS), F.ceil(F.col("grams") * 6 / PART_BYTES))
    chosen = _shared.cut(placed.join(loads.select("component", parts.alias("parts")), "component").select("set", "rep", "n", "component", "parts"))
    wanted = spark.sparkContext.broadcast(wanted_filter(chosen.select("set", "rep")))
    full = texts.mapInArrow(_sets(n, grades, wanted), "set bigint, grams binary").dropDuplicates(["set"])
    own = F.pmod(F.xxhash64("set"), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    spread = chosen.select("set", "n", "component", own.alias("own"), other)
    block = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("block")
    held = full.join(spread.select(block, F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "set", "n"), "set")
    by_block = held.select("block", "side", "set", "grams", "n").repartition("block").sortWithinPartitions("block", F.length("grams"))
    return members.select("set", "doc_id"), sets.select("set", "rep", "n"), _shared.cut(by_block.mapInArrow(_verify(t), _pairs.LINKS))


def classes(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """`(node, class_id, n, links, best)` of nodes `(node, rep, n)` that are linked or stand for two documents or more.

    `class_id` is the smallest document of all nodes that links connect; `links` counts other nodes' documents.
    """
    edges = linked.where("b is not null").select("a", "b")
    sums = linked.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    groups = components(edges, nodes.select("node"))
    lead = nodes.join(groups, "node").join(sums, "node", "left").where("n > 1 or links is not null")
    first = lead.groupBy("component").agg(F.min("rep").alias("class_id"))
    return lead.join(first, "component").select("node", "class_id", "n", F.coalesce("links", F.lit(0)).alias("links"), "best")


def jaccard_join(docs: DataFrame, t: float = 0.6, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, class_id, copies, links, nearest)` of every document that has a similar one, with similarity `t` or more.

    `class_id` is the smallest doc_id among the documents that links connect, `copies` is the number of other
    documents with the same gram set, `links` that of all other documents that are similar, and `nearest` the greatest
    similarity to one of them, 1 for copies. All similar pairs are counted, whatever their number. A text of 1 to
    n - 1 words has one gram, all its words. Null ids, null texts and texts without words have no partner. Rows with
    one id and equal gram sets count as one document; an id with different ones counts once for each, with a row each.
    Other columns are ignored; an empty table gives no rows.
    """
    members, sets, linked = similar_sets(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), t, n)
    named = classes(sets.withColumnRenamed("set", "node"), linked).withColumnRenamed("node", "set")
    copies = F.col("n") - 1
    nearest = F.when(copies > 0, F.lit(1.0)).otherwise(F.col("best"))
    return members.join(named, "set").select("doc_id", "class_id", copies.alias("copies"), (copies + F.col("links")).alias("links"), nearest.alias("nearest"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    ends = np.concatenate([c.to_numpy() for b in parts for c in b.columns])
    cut = np.cumsum([b.num_rows for b in parts for _ in b.columns])[:-1]
    split = np.split(ends, cut)
    nodes, at = np.unique(np.concatenate([*split[::2], *split[1::2]]), return_inverse=True)
    half = len(at) // 2
    low = _pairs.forest(len(nodes), at[:half], at[half:])
    node = np.flatnonzero(low != np.arange(len(nodes)))
    yield pa.record_batch([pa.array(nodes[node]), pa.array(nodes[low[node]])], schema=_LINKS)


def components(edges: DataFrame, nodes: DataFrame, most_local: int = 1 << 22) -> DataFrame:
    """`(node, component)`: the smallest node reached over `(a, b)` edges.

    Every task first reduces its edges to a forest. If all forests together are of `most_local` edges at most, one
    task joins them; beyond that, large-star and small-star rounds do.
    """
    links = _shared.cut(edges.where("a <> b").mapInArrow(_forest, "a bigint, b bigint"))
    if links.count() <= most_local:
        found = links.coalesce(1).mapInArrow(_forest, "a bigint, b bigint").withColumnsRenamed({"a": "_a", "b": "_b"})
    else:
        found = _stars(links).withColumnsRenamed({"a": "_a", "low": "_b"})
    return nodes.join(found, F.col("node") == F.col("_a"), "left").select("node", F.coalesce("_b", "node").alias("component"))


def _stars(edges: DataFrame) -> DataFrame:
    """`(a, low)` for nodes that aren't the smallest of their component."""
    links = _shared.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        two = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = two.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = two.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _shared.cut(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        links = _shared.cut(small.where("a <> b").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.groupBy("a").agg(F.min("b").alias("low"))


def drop_near_duplicates(docs: DataFrame, t: float = 0.6, n: int = 3) -> DataFrame:
    """`docs` with one document, that of smallest doc_id, of each group of documents linked by similarity `t`.

    Groups are the connected components of the join. Rows with a null id, and texts without words, stay. Of rows with
    equal ids and texts in a group, all stay or go together.
    """
    members, sets, linked = similar_sets(docs, t, n)
    named = classes(sets.withColumnRenamed("set", "node"), linked).withColumnRenamed("node", "set")
    lost = members.join(named.select("set", "class_id"), "set").where("doc_id <> class_id").select(F.col("doc_id").alias("_loom_id")).distinct()
    return docs.join(lost, F.col("doc_id") == F.col("_loom_id"), "left_anti")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
sets AS (SELECT doc_id, list(g ORDER BY g) AS s, count(*) AS n FROM grams GROUP BY doc_id),
held AS (SELECT row_number() OVER () AS k, s, any_value(n) AS n, min(doc_id) AS rep, count(*) AS docs FROM sets GROUP BY s),
each AS (SELECT k, n, docs, unnest(s) AS g FROM held),
pairs AS (
  SELECT a.k AS x, b.k AS y, any_value(b.docs) AS docs, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM each a JOIN each b ON a.g = b.g AND a.k <> b.k
  GROUP BY a.k, b.k HAVING count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9),
reach AS (SELECT k AS x, k AS y FROM held UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON p.x = r.y),
named AS (SELECT r.x AS k, min(h.rep) AS class_id FROM reach r JOIN held h ON h.k = r.y GROUP BY r.x),
sums AS (SELECT x AS k, sum(docs) AS docs, max(jaccard) AS nearest FROM pairs GROUP BY x)
SELECT s.doc_id, class_id, h.docs - 1 AS copies, CAST(h.docs - 1 + coalesce(m.docs, 0) AS BIGINT) AS links, CASE WHEN h.docs > 1 THEN 1.0 ELSE nearest END AS nearest
FROM sets s JOIN held h ON h.s = s.s JOIN named USING (k) LEFT JOIN sums m USING (k)
WHERE h.docs > 1 OR m.docs IS NOT NULL
"""
