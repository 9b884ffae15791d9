"""Set operations on posting lists, and the compact encoding of a list. Tables leave encoding to Parquet; the codec
serves lists that are kept as single values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode_number(value: int) -> bytes:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    if not 0 <= value < 1 << 32:
        raise ValueError("not an unsigned 32-bit number")
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def decode_number(data: bytes, at: int = 0) -> tuple[int, int]:
    """`(value, next offset)`."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 28:
            raise ValueError("malformed number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value >= 1 << 32:
                raise ValueError("malformed number")
            return value, at


Posting = tuple[int, int, list[int]]


def encode_postings(postings: list[Posting]) -> bytes:
    """`(doc, tf, positions)` with ascending documents and positions, as gaps."""
    out, last = bytearray(), -1
    for doc, tf, positions in postings:
        if doc <= last:
            raise ValueError("documents must ascend")
        out += encode_number(doc - max(last, 0)) + encode_number(tf) + encode_number(len(positions))
        before = 0
        for i, p in enumerate(positions):
            if i and p <= before:
                raise ValueError("positions must ascend")
            out += encode_number(p - before)
            before = p
        last = doc
    return bytes(out)


def decode_postings(data: bytes, at: int = 0, stop: int | None = None) -> list[Posting]:
    out, doc = [], 0
    while at < (len(data) if stop is None else stop):
        gap, at = decode_number(data, at)
        tf, at = decode_number(data, at)
        n, at = decode_number(data, at)
        doc, positions, p = doc + gap, [], 0
        for _ in range(n):
            gap, at = decode_number(data, at)
            p += gap
            positions.append(p)
        out.append((doc, tf, positions))
    return out


def skip_table(data: bytes, block: int) -> list[tuple[int, int]]:
    """`(document, offset)` of the first posting of every block."""
    if block < 1:
        raise ValueError("a block has at least one posting")
    out, doc, at, i = [], 0, 0, 0
    while at < len(data):
        start = at
        gap, at = decode_number(data, at)
        doc += gap
        if i % block == 0:
            out.append((doc, start))
        _, at = decode_number(data, at)
        n, at = decode_number(data, at)
        for _ in range(n):
            _, at = decode_number(data, at)
        i += 1
    return out


def intersect_lists(left: list[int], right: list[int], skips: bool = False) -> tuple[list[int], int, int]:
    """Merge of two ascending lists, with jumps of about sqrt(n) if asked; `(common, left steps, right steps)`."""
    step = [max(1, math.isqrt(len(x))) for x in (left, right)]
    i = j = seen_left = seen_right = 0
    out = []
    while i < len(left) and j < len(right):
        seen_left, seen_right = seen_left + 1, seen_right + 1
        if left[i] == right[j]:
            out.append(left[i])
            i, j = i + 1, j + 1
        elif left[i] < right[j]:
            while skips and i + step[0] < len(left) and left[i + step[0]] <= right[j]:
                i, seen_left = i + step[0], seen_left + 1
            if left[i] < right[j]:
                i += 1
        else:
            while skips and j + step[1] < len(right) and right[j + step[1]] <= left[i]:
                j, seen_right = j + step[1], seen_right + 1
            if right[j] < left[i]:
                j += 1
    return out, seen_left, seen_right


def documents_with_all(posts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Documents that have every one of the terms, by one aggregation over their postings."""
    wanted = sorted(set(terms))
    hits = posts.where(F.col("term").isin(*wanted)).groupBy(key).agg(F.count_distinct("term").alias("k"))
    return hits.where(F.col("k") == len(wanted)).select(key)


def position_gaps(positions: DataFrame) -> DataFrame:
    """`(doc_id, field, term, positions)` with positions as gaps, the first from 0."""
    gaps = F.transform(F.col("positions"), lambda p, i: p - F.when(i > 0, F.get("positions", i - 1)).otherwise(0))
    return positions.withColumn("gaps", gaps)


def compressed(posts: DataFrame) -> DataFrame:
    """`(term, part, postings)`: encoded lists of `(term, doc, tf, positions)` rows with numbered documents.

    A term's list is cut by ranges of 65,536 documents, so that no task holds more of it; keep it with `persist()`.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((int(d), int(tf), [int(p) for p in at]) for d, tf, at in zip(frame["doc"], frame["tf"], frame["positions"]))
        return pd.DataFrame([(*key, encode_postings(rows))], columns=["term", "part", "postings"])

    parted = posts.withColumn("part", F.expr("doc div 65536"))
    return parted.groupBy("term", "part").applyInPandas(run, "term string, part bigint, postings binary")
