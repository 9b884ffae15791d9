"""Vectorised splitting of Arrow string columns into hashed words.

A word is a maximal run of ASCII letters, digits, `_` and non-ASCII characters of the lower-cased text. Words are
identified by a 64-bit hash, computed for all words of a chunk at once: prefix sums of byte * BASE**i (mod 2**64)
give the polynomial hash of any byte range after one division by BASE**start, which is exact as BASE is odd.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_tables: list[np.ndarray] = []

_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
_WORD[0x80:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _tables[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, _INVERSE)]
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (in place)."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is many times faster than `np.unique`, which hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass
class Chunk:
    """Words of consecutive documents: `hashes[offsets[i]:offsets[i + 1]]` are those of row `first + i`."""

    first: int
    rows: int
    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    bounds: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.offsets))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of a string array without nulls."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data, bounds


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[Chunk]:
    """Chunks of about `most` bytes; a longer document is a chunk of its own. Null texts count as empty."""
    if not len(texts):
        return
    texts = pc.utf8_lower(texts.fill_null(""))
    data, bounds = buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield split_bytes(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


def split_bytes(data: np.ndarray, bounds: np.ndarray, first: int = 0) -> Chunk:
    n, rows = len(data), len(bounds) - 1
    inside = _WORD[data]
    opens = np.zeros(n + 1, bool)
    closes = np.zeros(n + 1, bool)
    edge = bounds[:-1][bounds[:-1] < n]
    opens[:n] = inside
    opens[1:n] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes[1:] = inside
    closes[1:n] &= ~inside[1:]
    later = edge[edge > 0]
    closes[later] = inside[later - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Chunk(first, rows, hashes, np.searchsorted(starts, bounds, "left"), starts, ends, data, bounds)


_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def ngrams(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, and their offsets by row.

    A row of 1 to n - 1 words has one gram, all its words; a row without words has none.
    """
    h, off = chunk.hashes, chunk.offsets
    count = np.diff(off)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(chunk.rows), size)
    at = off[row] + np.arange(offsets[-1]) - offsets[row]
    out = np.full(len(at), 0x2545F4914F6CDD1D, np.uint64)
    end = off[row + 1]
    for k in range(n):
        there = at + k
        ok = there < end
        word = h[np.where(ok, there, 0)] if len(h) else np.zeros(len(at), np.uint64)
        out = out * _ODD[0] + np.where(ok, word, np.uint64(0)) * _ODD[1 + k % 4]
    return mix(out), offsets


def char_index(data: np.ndarray) -> np.ndarray:
    """For each byte position, and one past the end, the number of characters that start before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
