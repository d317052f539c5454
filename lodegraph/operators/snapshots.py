"""Snapshots of an index over time: create, list, compare, trim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("files", "symbols", "dead", "cycles", "entry_points")
SCHEMA = "id string, name string, created_at timestamp, project string, metrics struct<files:long,symbols:long,dead:long,cycles:long,entry_points:long,by_kind:map<string,long>,top_files:array<struct<path:string,symbols:long,dead:long>>>"


def create(rows: DataFrame, cycles: DataFrame, created_at, project: str, name: str | None = None, most: int = 20) -> DataFrame:
    """One snapshot row from symbol rows (with path and dead) and cycle components."""
    total = rows.agg(F.count_distinct("path").alias("files"), F.count("*").alias("symbols"), F.count_if("dead").alias("dead"), F.count_if("is_entry").alias("entry_points"))
    kinds = rows.groupBy("kind").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("by_kind"))
    top = rows.groupBy("path").agg(F.count("*").alias("symbols"), F.count_if("dead").alias("dead")).orderBy(F.desc("symbols"), "path").limit(most)
    top = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("symbols")).alias("o"), "path", "symbols", "dead"))), lambda x: F.struct(x["path"].alias("path"), x["symbols"].alias("symbols"), x["dead"].alias("dead"))).alias("top_files"))
    c = cycles.agg(F.count_distinct("component").alias("cycles"))
    one = total.join(F.broadcast(kinds)).join(F.broadcast(top)).join(F.broadcast(c))  # a row each
    at = F.lit(created_at).cast("timestamp")
    return one.select(F.date_format(at, "yyyyMMdd_HHmmss").alias("id"), F.lit(name).cast("string").alias("name"), at.alias("created_at"), F.lit(project).alias("project"), F.struct(*METRICS, "by_kind", "top_files").alias("metrics"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots of a folder; files that can't be parsed are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)


def newest_first(snaps: DataFrame) -> DataFrame:
    return snaps.orderBy(F.desc("created_at"), F.desc("id"))


def latest(snaps: DataFrame) -> DataFrame:
    return snaps.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def compare(snaps: DataFrame, a: str, b: str) -> DataFrame:
    """b - a of each metric, one row."""
    x, y = (snaps.where(F.col("id") == i).select(*[F.col(m).alias(f"{p}_{m}") for m in METRICS]) for i, p in ((a, "a"), (b, "b")))
    return x.join(F.broadcast(y)).select(*[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(f"{m}_diff") for m in METRICS])


def trend(snaps: DataFrame) -> DataFrame:
    """Each snapshot with its differences from the one before. Snapshots of one project are few."""
    w = Window.orderBy("created_at", "id")
    return snaps.select("id", *METRICS, *[(F.col(m) - F.lag(m).over(w)).alias(f"{m}_diff") for m in METRICS])


def summary(df: DataFrame) -> DataFrame:
    """The changes of a trend as text."""
    def part(m):
        d = F.col(f"{m}_diff")
        return F.when(d > 0, F.concat(F.lit("+"), d.cast("string"), F.lit(f" {m}"))).when(d < 0, F.concat(d.cast("string"), F.lit(f" {m}")))

    return df.select("id", F.concat_ws(", ", *[part(m) for m in METRICS]).alias("summary"))


def newest(snaps: DataFrame, keep: int) -> DataFrame:
    """The rows that stay when only the newest `keep` do."""
    return snaps.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))).where(F.col("rn") <= keep).drop("rn")
