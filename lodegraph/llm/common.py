"""What every corpus operator shares: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of a table; columns beyond these never enter a plan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only with a local master where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodegraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets later readers use the
    rows more than once without computing them anew.
    """
    path = f"{shared_dir(df.sparkSession)}/lodegraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodegraph_path = path
    _TABLES.append(out)
    return out


#: Rows that Spark hands to a worker at once.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
#: Tables that stored() wrote and that are still there.
_TABLES: list[DataFrame] = []


def so_far() -> int:
    """A mark for drop_since()."""
    return len(_TABLES)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables that were stored after a mark, but for those that are still read."""
    drop(*[t for t in _TABLES[mark:] if all(t is not k for k in keep)])


def fresh(columns: Iterable[str], name: str) -> str:
    """A name that none of the columns has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def free(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of what is written by now; it does so when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def drop(*tables: DataFrame) -> None:
    """Delete tables that stored() wrote and that nothing reads any more, and the shuffle files that led to them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._lodegraph_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        _TABLES[:] = [t for t in _TABLES if t is not df]
    if tables:
        free(tables[0].sparkSession)


def crc_mod(column: str, modulus: int):
    """crc32 of a column's decimal text, modulo modulus; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def held_out(column: str, modulus: int, remainder: int):
    """Whether a row is held out; rows without an id are never held out."""
    return F.coalesce(crc_mod(column, modulus) == remainder, F.lit(False))


def by_size(batches: Iterable[pa.RecordBatch], text_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `most` bytes of text, one row at least."""
    for batch in batches:
        start, held = 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < len(sizes):
            yield batch.slice(start)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, Any]]], schema: str | StructType) -> DataFrame:
    """mapInArrow whose function yields dicts of columns of equal length."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(fields)
    conf = df.sparkSession.conf
    if conf.get(BATCH, "10000") == "10000":  # Spark's default, which is made for narrow rows; texts are wide
        conf.set(BATCH, str(ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) and x.type == f.type else (x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type)) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)
