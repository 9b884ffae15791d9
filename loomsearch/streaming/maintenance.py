"""Incremental upkeep of an index: each version is a set of immutable tables, and changes make the next version.

Tables of a version: `docs(doc_id, path, content, file_size_bytes)` and `tokens(doc_id, path, field, tokens)`. Totals
and norms are aggregates of them and are made anew for each version.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsearch.functions import text
from loomsearch.operators import fields, index
from loomsearch.streaming import event_log


@dataclass(frozen=True)
class Version:
    """One state of the index."""

    docs: DataFrame
    tokens: DataFrame

    def postings(self) -> DataFrame:
        return index.field_frequencies(self.tokens).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))

    def norms(self) -> DataFrame:
        lengths = self.docs.select("doc_id").join(self.tokens.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("length")), "doc_id", "left").fillna(0, ["length"])
        return index.doc_norms(self.postings(), lengths, "doc_id")


def tokens_of(docs: DataFrame, fielded: bool = True, n_grams: int = 1) -> DataFrame:
    """Token arrays of all ten fields, or windows of the content's prose terms for a flat index."""
    if fielded:
        return fields.analyzed_fields(fields.all_fields(docs, "doc_id", "path", "content"))
    flat = index.with_prose_tokens(docs.select("doc_id", "path", F.lit("content").alias("field"), F.coalesce("content", F.lit("")).alias("content")), F.col("content"))
    return flat.select("doc_id", "path", "field", text.word_ngrams(F.col("tokens"), n_grams).alias("tokens"))


def build(docs: DataFrame, fielded: bool = True, n_grams: int = 1) -> Version:
    return Version(docs, tokens_of(docs, fielded, n_grams))


def apply(version: Version, events: DataFrame, current: DataFrame, fielded: bool = True, n_grams: int = 1) -> Version:
    """The next version after `(seq, kind, path)` events, `current(doc_id, path, content, file_size_bytes)` being the files now.

    Only the last event of a path counts. Added and modified files are analysed anew; one that can't be read any more
    is removed, as deleted ones are. Deleting a folder removes what is below it, unless it came back later.
    """
    last = event_log.latest(events)
    fresh = last.where(F.col("kind") != event_log.DELETED).select("path", "seq")
    gone = last.where(F.col("kind") == event_log.DELETED).select(F.col("path").alias("lost"), F.col("seq").alias("lost_seq"))
    # a path and all the folders above it, to find deleted folders by equality
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    known = version.docs.select("path").unionByName(fresh.select("path")).distinct()
    under = known.select("path", F.explode(above).alias("lost")).join(gone, "lost").groupBy("path").agg(F.max("lost_seq").alias("lost_seq"))
    dead = under.join(fresh, "path", "left").where(F.col("seq").isNull() | (F.col("seq") < F.col("lost_seq"))).select("path")
    touched = fresh.select("path").unionByName(dead).distinct()
    alive = fresh.select("path").join(dead, "path", "left_anti")
    new = current.join(alive, "path", "left_semi").select(*version.docs.columns)
    docs = version.docs.join(touched, "path", "left_anti").select(*version.docs.columns).unionByName(new)
    kept = version.tokens.join(touched, "path", "left_anti").select(*version.tokens.columns)
    return Version(docs, kept.unionByName(tokens_of(new, fielded, n_grams).select(*version.tokens.columns)))


@dataclass
class Engine:
    """Readers use the version that is current when they begin; a writer swaps in the next one."""

    spark: SparkSession
    folder: str
    version: Version
    fielded: bool = True
    _writing: Lock = field(default_factory=Lock)

    def update(self, events: DataFrame, current: DataFrame) -> Version:
        """Applies events and writes the new version, which cuts its lineage. The one before stays for its readers."""
        with self._writing:
            nxt = apply(self.version, events, current, self.fielded)
            place = f"{self.folder}/version-{uuid.uuid4().hex}"
            nxt.docs.write.parquet(f"{place}/docs")
            nxt.tokens.write.parquet(f"{place}/tokens")
            self.version = Version(self.spark.read.parquet(f"{place}/docs"), self.spark.read.parquet(f"{place}/tokens"))
            return self.version

    def poll(self, log: str, current: DataFrame) -> int:
        """What a watcher does at each look: changes between the index and the files go to the log and are applied."""
        events = changed_files(self.version.docs, current).orderBy("path").persist()
        n = events.count()
        if n:
            event_log.append_events(events, log)
            self.update(events.withColumn("seq", F.monotonically_increasing_id()), current)
        events.unpersist()
        return n

    def watch(self, log: str, current: Callable[[], DataFrame], seconds: float = 2.0, stop: Callable[[], bool] = lambda: False) -> None:
        """Polls the files until `stop()`. A file whose content stays the same is no change, whatever its time says."""
        while not stop():
            self.poll(log, current())
            time.sleep(seconds)

    def count(self) -> int:
        return self.version.docs.count()

    def follow(self, log: str, checkpoint: str, current):
        """A stream that applies events as they come to the log; `current()` gives the files. Start, then stop, the query."""

        def batch(events: DataFrame, _: int) -> None:
            if not events.isEmpty():
                self.update(events, current())

        return event_log.stream(self.spark, log).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events `(kind, path)` between two listings `(path, content)`: what a watcher would have seen while none ran."""
    a, b = before.select("path", F.xxhash64("content").alias("old")), after.select("path", F.xxhash64("content").alias("new"))
    both = a.join(b, "path", "full")
    kind = F.when(F.col("old").isNull(), event_log.ADDED).when(F.col("new").isNull(), event_log.DELETED).when(F.col("old") != F.col("new"), event_log.MODIFIED)
    return both.select(kind.alias("kind"), "path").where("kind is not null")
