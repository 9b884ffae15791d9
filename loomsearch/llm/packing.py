"""Best-fit-decreasing packing of documents into windows of a fixed number of tokens.

Overlong documents are first cut into full windows; what is left of each, and every shorter document, is placed from
long to short into the open window with the least room that holds it, found with a segment tree indexed by remaining
capacity. Documents of one length are interchangeable, so the tree works on the histogram of lengths: a step places
all documents of a length that go into windows of one capacity at once. Its cost depends on the window size only,
and the plan is that of best-fit decreasing over the single documents. Documents then take their places by their rank
among those of their length, which needs no global order.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsearch.llm import _shared

BUCKETS = 1024


class Tree:
    """Finds the smallest capacity, at least that asked for, that has open windows."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.open[i] = there
        while i > 1:
            i //= 2
            now = self.open[2 * i] or self.open[2 * i + 1]
            if self.open[i] == now and i < self.size // 2:
                break
            self.open[i] = now

    def tightest(self, least: int) -> int | None:
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


@dataclass(frozen=True)
class Flow:
    """Items `rank` to `rank + count - 1` of a length go into windows from `window` on, `each` to a window from token `at` on."""

    length: int
    rank: int
    count: int
    window: int
    each: int
    at: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Flow], int]:
    """Best-fit-decreasing flows for `{length: items}`, and the number of windows."""
    tree, windows, flows = Tree(capacity), 0, []
    held: list[deque] = [deque() for _ in range(capacity + 1)]  # by room left: intervals of windows

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            held[room].append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                count = -(-left // each)
                first, windows = windows, windows + count
            else:
                first, count = held[room].popleft()
                if not held[room]:
                    tree.set(room, False)
                each = room // length
            full = min(count, left // each)
            if full:
                flows.append(Flow(length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if count and left and left < each:
                flows.append(Flow(length, rank, left, first, each, capacity - room))
                put(room - left * length, first, 1)
                first, count, left = first + 1, count - 1, 0
            if count:
                held[room].appendleft((first, count))
                tree.set(room, True)
    return flows, windows


def word_count(text: Column) -> Column:
    """Runs of other than white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def tokenizer_lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, tokens)` by a tokenizer file of the `tokenizers` library, as an alternative to words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for b in batches:
            sizes = [len(e.ids) for e in tok.encode_batch(b.column(1).to_pylist(), add_special_tokens=False)]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, tokens bigint")


def pack_lengths(sizes: DataFrame, capacity: int = 2048) -> DataFrame:
    """Packs `(doc_id, tokens)` rows; see `pack`."""
    if capacity < 1:
        raise ValueError("a window holds at least one token")
    spark = sizes.sparkSession
    sized = sizes.where("doc_id is not null and tokens > 0").select("doc_id", "tokens", F.expr(f"tokens div {capacity}").alias("full"), (F.col("tokens") % capacity).alias("rest"), F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket"))
    counts = sized.groupBy("rest", "bucket").agg(F.count("*").alias("n"), F.sum("full").alias("windows"))
    histogram = {int(r["rest"]): r["n"] for r in counts.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    flows, windows = plan(histogram, capacity)

    # ranks: of an item among those of its length, from counts by bucket; likewise for full windows
    ahead = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.where("rest > 0").select("rest", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    rests = sized.where("rest > 0").withColumn("own", F.row_number().over(Window.partitionBy("rest", "bucket").orderBy("doc_id", "full")) - 1)
    ranked = rests.join(bases, ["rest", "bucket"]).withColumn("rank", F.col("base") + F.col("own"))
    table = spark.createDataFrame([(f.length, f.rank, f.count, f.window, f.each, f.at) for f in flows] or [(0, 0, 0, 0, 1, 0)], "rest bigint, low bigint, n bigint, window bigint, each bigint, at bigint")
    placed = ranked.join(table, "rest").where("rank >= low and rank < low + n").withColumn("slot", F.col("rank") - F.col("low"))
    short = placed.select(
        (F.col("window") + F.expr("slot div each")).alias("window_id"), (F.col("at") + (F.col("slot") % F.col("each")) * F.col("rest")).cast("bigint").alias("window_start"),
        "doc_id", F.col("full").alias("piece"), (F.col("full") * capacity).alias("start"), F.col("tokens").alias("end"),
    )

    totals = counts.groupBy("bucket").agg(F.sum("windows").alias("windows"))
    before = totals.select("bucket", F.coalesce(F.sum("windows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    longs = sized.where("full > 0").withColumn("own", F.coalesce(F.sum("full").over(inside), F.lit(0))).join(before, "bucket")
    cut = longs.select("doc_id", "tokens", (F.lit(windows) + F.col("base") + F.col("own")).alias("first"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)).alias("piece"))
    whole = cut.select((F.col("first") + F.col("piece")).alias("window_id"), F.lit(0).cast("bigint").alias("window_start"), "doc_id", "piece", (F.col("piece") * capacity).alias("start"), ((F.col("piece") + 1) * capacity).alias("end"))
    return short.unionByName(whole)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", count=word_count) -> DataFrame:
    """`(window_id, window_start, doc_id, piece, start, end)`: tokens [start, end) of a document, and where they lie.

    `count` gives the tokens of a text column (words if not set). Windows have `capacity` tokens at most; window ids
    are 0, 1, ... without gaps. Null and empty texts and null ids are in no window. Rows with equal ids are packed
    each. Other columns are ignored.
    """
    sizes = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), count(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("tokens"))
    return pack_lengths(_shared.cut(sizes), capacity)  # the texts are read once, the lengths several times
