"""Session defaults, the shared folder, and lineage cuts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def builder(app: str = "lodegraph", **conf: str) -> SparkSession.Builder:
    """A builder with the settings that the operators count on; a cluster's own settings win."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without one; then it is a temporary folder."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed to the shared folder, so that loops don't drag their history."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back, for readers that want parts of it more than once."""
    path = f"{shared_dir(df.sparkSession)}/lodegraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodegraph_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more, and the shuffle files that led to them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lodegraph_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    if tables:  # Spark deletes shuffle files when the driver collects its garbage
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def stored_path(df: DataFrame, tag: str) -> str:
    """Where df is written in the shared folder, for those who read it again and again."""
    path = f"{shared_dir(df.sparkSession)}/lodegraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a column that numbers all rows from 1 in an order, which has to be total, without holding them in one task.

    Rows are sorted by ranges; a row's number is its place behind the ranges before, whose sizes are a row each.
    """
    at = "_ranked_at"
    placed = stored(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn(name, (F.col("_before") + place + 1).cast("int")).drop(at, "_part", "_before")
