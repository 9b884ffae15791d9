"""Bloom filters of 64-bit keys, of bounded size, to keep rows that match nothing from a shuffle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsearch.llm import _words


def _places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    x = _words.mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x632BE59BD9B4E019))
    for i in range(3):
        yield ((x >> np.uint64(16 * i)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _words_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            for at in _places(b.column(0).to_numpy(zero_copy_only=False), bits):
                held[at] = True
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        for i in range(0, len(at), 1 << 18):
            own = at[i : i + (1 << 18)]
            yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(words[own])], names=["at", "word"])

    return run


def build(keys: DataFrame, most: int = 27) -> np.ndarray:
    """Packed bits of a filter of the keys in the one column of `keys`: 2**`most` bits, 16 MB, at most.

    Beyond some ten million keys it lets more others pass, which a join then drops.
    """
    bits = int(np.clip(math.ceil(math.log2(max(keys.count(), 1) * 12)), 10, most))
    found = keys.mapInArrow(_words_of(bits), "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros((1 << bits) // 64, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return words.view(np.uint8)


def passes(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = len(held).bit_length() + 2
    out = np.ones(len(keys), bool)
    for at in _places(keys, bits):
        out &= (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out
