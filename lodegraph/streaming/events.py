"""File-change events: classification, debounce, last event wins; batch and streaming alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def classify(event: Column) -> Column:
    """changed for created, modified and renamed files, deleted for removed ones, null for the rest."""
    return F.when(event.isin("create", "modify", "rename", "changed"), "changed").when(event.isin("remove", "deleted"), "deleted")


def usable(events: DataFrame) -> DataFrame:
    """Events that say something about a file that is indexed."""
    return events.withColumn("action", classify(F.col("action"))).where(F.col("action").isNotNull() & paths.indexable(F.col("path")) & ~paths.hidden(F.col("path")))


def last_wins(events: DataFrame, gap: str) -> DataFrame:
    """start, finish, project, path, action: the last action on each path within a burst of that path.

    Keyed by project and path, so the state is spread, not global.
    """
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "project", "path").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "project", "path", "action", "n")


def bursts(events: DataFrame, gap: str) -> DataFrame:
    """start, n, paths of each burst: events of any project until none came for the gap. One key by its meaning."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), F.lit(0).alias("all")).agg(F.count("*").alias("n"), F.approx_count_distinct("path").alias("paths") if events.isStreaming else F.count_distinct("path").alias("paths")).select(F.col("w.start").alias("start"), "n", "paths")


def per_window(events: DataFrame, length: str) -> DataFrame:
    return events.groupBy(F.window("ts", length).alias("w"), "project", "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "project", "action", "n")


def stream(spark: SparkSession, folder: str, late: str = "10 minutes", per_trigger: int = 100) -> DataFrame:
    """The event log as a stream with a watermark; files that arrive in the folder are its batches."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    action = F.when(F.col("event_type") == "error", "deleted").otherwise("changed")
    return raw.select(F.col("event_id").alias("seq"), "ts", (F.col("user_id") % 5).alias("project"), F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".rs")).alias("path"), action.alias("action")).withWatermark("ts", late)


def once(events: DataFrame) -> DataFrame:
    """A stream without repeated deliveries."""
    return events.dropDuplicatesWithinWatermark(["seq"])


def apply_to(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch of last actions to `apply`, such as an index update."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("project", "path").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"))
        apply(last, epoch)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
