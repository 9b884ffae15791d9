"""Replay of change events: events of users stand for changes of a file each."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomsearch.plans.lexical import table
from loomsearch.streaming import event_log, maintenance


def _events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "signup", event_log.ADDED).when(F.col("event_type") == "error", event_log.DELETED).otherwise(event_log.MODIFIED)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("user/"), "user_id").alias("path"))


def event_replay(spark, sf_dir):
    """What remains after all events, with the last event of each path."""
    return event_log.latest(_events(spark, sf_dir)).where(F.col("kind") != event_log.DELETED)


def event_counts(spark, sf_dir):
    """Events of each kind before replay, and paths whose last event is of the kind."""
    every = _events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("events"))
    last = event_log.latest(_events(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("paths"))
    return every.join(last, "kind", "left").fillna(0, ["paths"])


def apply_events(spark, sf_dir):
    """Documents after the events: customers are the index before, suppliers the files now."""
    path = lambda c: F.concat(F.lit("user/"), c)
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("doc_id"), path(F.col("c_custkey")).alias("path"), F.col("c_name").alias("content"), F.length("c_name").cast("bigint").alias("file_size_bytes"))
    now = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("doc_id"), path(F.col("s_suppkey")).alias("path"), F.col("s_name").alias("content"), F.length("s_name").cast("bigint").alias("file_size_bytes"))
    return maintenance.apply(maintenance.build(before), _events(spark, sf_dir), now).docs


QUERIES = {f.__name__: f for f in (event_replay, event_counts, apply_events)}

_EVENTS = "e AS (SELECT event_id AS seq, 'user/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'file_added' WHEN 'error' THEN 'file_deleted' ELSE 'file_modified' END AS kind FROM events), l AS (SELECT path, arg_max(kind, seq) AS kind, max(seq) AS seq FROM e GROUP BY path)"
ORACLES = {
    "apply_events": f"""WITH {_EVENTS}, a AS (SELECT c_custkey::BIGINT AS doc_id, 'user/' || c_custkey AS path, c_name AS content, length(c_name) AS file_size_bytes FROM customer),
b AS (SELECT s_suppkey::BIGINT AS doc_id, 'user/' || s_suppkey AS path, s_name AS content, length(s_name) AS file_size_bytes FROM supplier)
SELECT * FROM a WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT b.* FROM b SEMI JOIN (SELECT path FROM l WHERE kind <> 'file_deleted') USING (path)""",
    "event_replay": f"WITH {_EVENTS} SELECT * FROM l WHERE kind <> 'file_deleted'",
    "event_counts": f"WITH {_EVENTS} SELECT kind, count(*) AS events, (SELECT count(*) FROM l WHERE l.kind = e.kind) AS paths FROM e GROUP BY kind",
}
