"""Log of changes to a corpus: JSON lines `(kind, path)` in files whose order is that of their sequence numbers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ADDED, MODIFIED, DELETED = "file_added", "file_modified", "file_deleted"
SCHEMA = "seq bigint, kind string, path string"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """`(seq, kind, path)`; blank lines are skipped, a malformed line or unknown kind is an error that names it."""
    try:
        lines = spark.read.text(folder).where("trim(value) <> ''")
    except AnalysisException:
        return empty(spark)
    e = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    parsed = lines.select("value", e.alias("e")).select("value", "e.*")
    good = F.col("kind").isin(ADDED, MODIFIED, DELETED) & F.col("path").isNotNull() & F.col("seq").isNotNull()
    return parsed.select("seq", F.when(good, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("malformed event: "), F.col("value")))).alias("kind"), "path")


def append_events(events: DataFrame, folder: str) -> None:
    """Appends `(kind, path)` rows, numbered on in their order, or `(seq, kind, path)` with numbers of their own."""
    spark = events.sparkSession
    if "seq" not in events.columns:
        last = read_events(spark, folder).agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        numbered = events.select("kind", "path", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
        sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low")).orderBy("_part").collect()  # a row for each task
        starts, at = [], last + 1
        for r in sizes:
            starts.append((r["_part"], at - r["_low"]))
            at += r["_n"]
        shift = spark.createDataFrame(starts, "_part int, _shift bigint")
        events = numbered.join(F.broadcast(shift), "_part").select((F.col("_at") + F.col("_shift")).alias("seq"), "kind", "path")
    events.select("seq", "kind", "path").write.mode("append").json(folder)


def clear_events(spark: SparkSession, folder: str) -> None:
    """Empties the log, as after a snapshot."""
    empty(spark).write.mode("overwrite").json(folder)


def latest(events: DataFrame) -> DataFrame:
    """`(path, kind, seq)`: the last event of each path. A folder that is deleted deletes what was known below it."""
    return events.groupBy("path").agg(F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))


def stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)
