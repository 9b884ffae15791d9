"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes of the UTF-8 text ends a chunk wherever it is -1 modulo the block size, so an
edit moves only the boundaries near it. Each chunk gives one of 64 signature characters. The block size is 3 * 2**i,
the least for which about 64 chunks cover the text, halved while fewer than 32 result; a second signature has twice
that block size. Signatures of equal block sizes are compared by edit distance where they share seven characters in a
row, after runs of one character are cut to three.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomsearch.llm import _pairs, _shared, _words, ngram_join

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LONG, SHORT, GRAM = 64, 32, 7
TOKENS = 1 << 23  # signature grams of a bucket, about
TILE = 1 << 11  # members of a component that are paired at once with as many others
_OUT = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("sig", pa.string()), ("sig2", pa.string()), ("whole", pa.int64())])


def rolling(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: sum, weighted sum and shifted xor of the last seven bytes."""
    n = len(data)
    wide = np.zeros(n + 6, np.uint32)
    wide[6:] = data
    total, weighted, shifted = (np.zeros(n, np.uint32) for _ in range(3))
    for back in range(7):
        c = wide[6 - back : 6 - back + n]
        total += c
        weighted += c * np.uint32(7 - back)
        shifted ^= c << np.uint32(5 * back)
    return total + weighted + shifted


def _signature(roll: np.ndarray, sums: np.ndarray, down: np.ndarray, block: int, most: int) -> str:
    ends = np.flatnonzero(roll % np.uint32(block) == block - 1)[: most - 1] + 1
    edges = np.concatenate([[0], ends, [len(roll)]]) if not len(ends) or ends[-1] < len(roll) else np.concatenate([[0], ends])
    codes = _words.mix((sums[edges[1:]] - sums[edges[:-1]]) * down[edges[:-1]]) >> np.uint64(58)
    return _ALPHABET[codes.astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> tuple[int, str, str] | None:
    """`(block size, signature, signature at twice the block size)`; None for an empty text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(data)
    if not n:
        return None
    roll = rolling(data)
    up, down = _words._powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    block = 3
    while block * LONG < n:
        block *= 2
    while block > 3 and np.count_nonzero(roll % np.uint32(block) == block - 1) + 1 < LONG // 2:
        block //= 2
    return block, _signature(roll, sums, down, block, LONG), _signature(roll, sums, down, 2 * block, SHORT)


def squeezed(sig: str) -> str:
    """A signature with runs of one character cut to three."""
    return "".join(c for i, c in enumerate(sig) if i < 3 or not c == sig[i - 1] == sig[i - 2] == sig[i - 3])


def _whole(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, f[0], s := squeezed(f[1]), squeezed(f[2]), _whole(t) if len(s) < GRAM else None) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (f := fingerprint(t))]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [[]] * 5, _OUT)], schema=_OUT)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, block, sig, sig2, whole)` of each row with an id and a text that isn't empty.

    `whole` is a hash of the text where the signature has under seven characters, else null.
    """
    return _shared.narrow(docs, id_col, text_col).mapInArrow(_scan, "doc_id bigint, block bigint, sig string, sig2 string, whole bigint")


def _gram_tokens(block: int, sig: str) -> set[int]:
    return {int.from_bytes(hashlib.blake2b(f"{block} {sig[i : i + GRAM]}".encode(), digest_size=8).digest(), "little") >> 6 for i in range(len(sig) - GRAM + 1)}


def _pack(numbers: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _pairs.Packer(numbers)
        for b in batches:
            for key, block, sig, sig2 in zip(*(c.to_pylist() for c in b.columns)):
                grams = _gram_tokens(block, sig) | _gram_tokens(2 * block, sig2)
                if grams:
                    packer.add(key, np.fromiter(grams, np.uint64, len(grams)))
                if packer.full():
                    yield from packer.flush()
        yield from packer.flush()

    return run


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of byte strings of 1 to 64 characters, a column of all pairs at a time (Myers)."""
    x, y = (s.astype("S64").view(np.uint8).reshape(-1, 64) for s in (a, b))
    m, n = np.count_nonzero(x, axis=1), np.count_nonzero(y, axis=1)
    one = np.uint64(1)
    top, score = (m - 1).astype(np.uint64), m.astype(np.int64)
    up, down = np.full(len(m), (1 << 64) - 1, np.uint64), np.zeros(len(m), np.uint64)
    for j in range(int(n.max(initial=0))):
        eq = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64).ravel()
        across = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(across | up), up & across
        score += np.where(j < n, ((more >> top) & one).astype(np.int64) - ((less >> top) & one).astype(np.int64), 0)
        more, less, eq = (more << one) | one, less << one, eq | down
        up, down = less | ~(eq | more), more & eq
    return score


def scores(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Scores of pairs of signatures; -1 under `least` or without seven characters in a row that both have."""
    out = np.full(len(a), -1)
    m, n = np.char.str_len(a), np.char.str_len(b)
    at = np.flatnonzero((np.minimum(m, n) * 100 >= np.maximum(m, n) * least) & (np.minimum(m, n) >= GRAM))
    for i in range(0, len(at), 1 << 12):
        own = at[i : i + (1 << 12)]
        d = distances(a[own], b[own])
        score = np.floor(100 * (1 - d / np.maximum(m, n)[own])).astype(np.int64)
        sure = m[own] - d >= (GRAM - 1) * (d + 1) + 1  # d edits leave d + 1 runs at most
        for k in np.flatnonzero((score >= least) & ~sure):
            x, y = a[own[k]], b[own[k]]
            sure[k] = any(x[c : c + GRAM] in y for c in range(len(x) - GRAM + 1))
        out[own] = np.where((score >= least) & sure, score, -1)
    return out


def _grams(blocks: np.ndarray, sigs: np.ndarray, sigs2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven characters in a row with their block size as one number, and whose they are; each once for its owner."""
    codes, owners = [], []
    for double, given in enumerate((sigs, sigs2)):
        sig = given.astype("S64").view(np.uint8).reshape(-1, LONG)
        size, wide = np.count_nonzero(sig, axis=1), sig.astype(np.uint64)
        level = (np.log2(blocks // 3).round().astype(np.uint64) + np.uint64(double)) << np.uint64(8 * GRAM)
        for at in range(LONG - GRAM + 1):
            own = np.flatnonzero(size >= at + GRAM)
            code = level[own]
            for i in range(GRAM):
                code = code | (wide[own, at + i] << np.uint64(8 * i))
            codes.append(code)
            owners.append(own)
    return np.concatenate(codes), np.concatenate(owners)


def candidates(blocks: np.ndarray, sigs: np.ndarray, sigs2: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that share seven characters at one block size; with `side`, only those of unlike sides."""
    n = len(blocks)
    tok, own = _grams(blocks, sigs, sigs2)
    shared = np.zeros(n * n, bool)
    for found in _pairs._run_pairs(tok, own, np.zeros(len(tok), np.int32), np.zeros(n), np.arange(n) if side is None else side, 0.0, None, n):
        shared[found >> 1] = True
    at = np.flatnonzero(shared)
    return at // n, at % n


def _linked(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = _pairs.Links()

        def settle(rows: list[tuple], across: bool) -> None:
            side, keys, n, blocks = (np.array(c, np.int64) for c in list(zip(*rows))[:4])
            sigs, sigs2 = (np.array([r[i] for r in rows], "S64") for i in (4, 5))
            a, b = candidates(blocks, sigs, sigs2, side if across else None)
            for i in range(0, len(a), 1 << 16):
                x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
                best = np.full(len(x), -1)
                for s, t, where in ((sigs, sigs, blocks[x] == blocks[y]), (sigs2, sigs2, blocks[x] == blocks[y]), (sigs, sigs2, blocks[x] == 2 * blocks[y]), (sigs2, sigs, blocks[y] == 2 * blocks[x])):
                    at = np.flatnonzero(where)
                    best[at] = np.maximum(best[at], scores(s[x[at]], t[y[at]], least))
                at = np.flatnonzero(best >= 0)
                links.add(keys[x[at]], keys[y[at]], n[x[at]], n[y[at]], best[at].astype(np.float64))

        held: list[tuple] = []  # of whole small components, which share no gram
        for (_, i, j), rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:3]):
            own = [r[3:] for r in rows]
            if i != j:
                settle(own, True)
                continue
            if held and len(held) + len(own) > TILE:
                settle(held, False)
                held = []
            held += own
        if held:
            settle(held, False)
        yield from links.rows()

    return run


def tiles(held: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """Rows `(component, i, j, side, ...)` of `held` by tiles: all pairs of `TILE` members of a component with `TILE` others.

    A component of m members has m / TILE copies of each, and is worked on by as many tasks as it has tiles.
    """
    several = groups.groupBy("component").agg(F.count("*").alias("m")).where("m > 1")
    placed = held.join(groups.withColumnRenamed("node", "key"), "key").join(several, "component")
    at = F.floor((F.row_number().over(Window.partitionBy("component").orderBy("key")) - 1) / TILE).cast("int")
    chunk = placed.withColumn("chunk", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / TILE).cast("int"))))
    i, j = F.least("chunk", "other"), F.greatest("chunk", "other")
    rows = chunk.select("component", i.alias("i"), j.alias("j"), F.when(F.col("chunk") == i, 0).otherwise(1).alias("side"), "key", "n", "block", "sig", "sig2")
    return rows.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j")


def matches(docs: DataFrame, least: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, class_id, copies, links, best)` of every document whose fingerprint matches another's.

    The score of two fingerprints is 100 * (1 - edit distance / length of the longer signature), rounded down, the
    best over signatures of equal block sizes (of those that share seven characters); they match from `least` on.
    Equal fingerprints match with 100; where the first signature has under seven characters, which many texts share,
    only equal texts do. `class_id` is the smallest doc_id among the documents that matches connect, `copies` the
    number of other documents with an equal fingerprint, `links` that of all others that match, `best` the greatest
    score to one of them. All matches are counted, whatever their number. Null ids, null and empty texts match
    nothing. Rows with one id and equal fingerprints count as one document; an id with different ones counts once for
    each, with a row each. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    name = F.xxhash64("block", "sig", "sig2", "whole").alias("name")
    members = _shared.cut(fingerprints(docs, id_col, text_col).withColumn("name", name).dropDuplicates(["name", "doc_id"]))
    keyed = members.groupBy("name").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("block", "sig", "sig2")))
    held = _shared.cut(keyed.withColumn("key", F.monotonically_increasing_id()))  # only once this is written are the numbers fixed
    numbers = _pairs.buckets(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(held.count() * (LONG + SHORT) / TOKENS)))
    packed = held.select("key", "block", "sig", "sig2").mapInArrow(_pack(numbers), _pairs.PACKED)
    groups = _shared.cut(ngram_join.components(_pairs.sharing_edges(packed, numbers), held.select(F.col("key").alias("node"))))
    linked = _shared.cut(tiles(held, groups, len(numbers)).mapInArrow(_linked(least), _pairs.LINKS))
    named = ngram_join.classes(held.select(F.col("key").alias("node"), "rep", "n"), linked)
    found = named.join(held.select("name", F.col("key").alias("node")), "node")
    copies = F.col("n") - 1
    top = F.when(copies > 0, F.lit(100)).otherwise(F.col("best").cast("int"))
    return members.select("name", "doc_id").join(found, "name").select("doc_id", "class_id", copies.alias("copies"), (copies + F.col("links")).alias("links"), top.alias("best"))
