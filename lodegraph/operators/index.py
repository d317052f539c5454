"""A kept inverted index: segments of postings, bucketed by term, with deletes by path.

Adding writes a segment; deleting writes the paths that go, which hides them in all
segments before; searching reads only the buckets and terms of the query, and the
lengths of documents, never a text. Nothing is changed in place, so a reader of an
older manifest still finds what it names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import search

BUCKETS = 64
FIELDS = ("content", "symbol")
SCHEMAS = {
    "postings": "id string, path string, field string, dl int, term string, tf long, bucket int",
    "docs": "id string, path string, start_line int, end_line int, content int, symbol int",
    "deleted": "path string",
}


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """An index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, steps: list[dict] | None = None):
        self.spark, self.folder, self.steps = spark, folder.rstrip("/"), steps or []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TextIndex:
        """The index as its last manifest has it; raises where none is."""
        from pyspark.errors import AnalysisException

        try:
            last = spark.read.option("recursiveFileLookup", True).json(f"{folder.rstrip('/')}/manifest", "version long, steps string").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            raise FileNotFoundError(f"no index in {folder}") from e
        return cls(spark, folder, json.loads(last.steps))

    def _record(self, step: dict) -> None:
        self.steps = [*self.steps, step]
        self.spark.createDataFrame([(len(self.steps), json.dumps(self.steps))], "version long, steps string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def add(self, chunks: DataFrame) -> None:
        """Add chunks (id, path, content, start_line, end_line, and symbol if there is one). Whoever adds a path again deletes it first."""
        name = uuid.uuid4().hex
        symbol = F.col("symbol") if "symbol" in chunks.columns else F.lit(None).cast("string")
        rows = chunks.select(*[F.col(c).cast("string" if c in ("id", "path") else "int").alias(c) for c in ("id", "path", "start_line", "end_line")], *[search.terms(F.coalesce(c, F.lit(""))).alias(f) for f, c in zip(FIELDS, (F.col("content"), symbol), strict=True)])
        # postings are counted within a row, so a text's terms never leave its task before they are counted
        counted = rows.select("id", "path", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("ts")) for f in FIELDS])).alias("f"))
        counted = counted.select("id", "path", "f.field", F.size("f.ts").alias("dl"), F.explode("f.ts").alias("term")).groupBy("id", "path", "field", "dl", "term").agg(F.count("*").alias("tf"))
        counted.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.folder}/postings/{name}")
        rows.select("id", "path", "start_line", "end_line", *[F.size(f).alias(f) for f in FIELDS]).write.parquet(f"{self.folder}/docs/{name}")
        self._record({"add": name})

    def delete(self, paths: DataFrame) -> None:
        """Hide all chunks of these paths (path) that were added before."""
        name = uuid.uuid4().hex
        paths.select("path").distinct().write.parquet(f"{self.folder}/deleted/{name}")
        self._record({"delete": name})

    def _read(self, table: str, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}/{name}")

    def _live(self, table: str, cut=lambda df: df) -> DataFrame | None:
        out = None
        for step in self.steps:
            if "add" in step:
                part = cut(self._read(table, step["add"]))
                out = part if out is None else out.unionByName(part)
            elif out is not None:
                out = out.join(self._read("deleted", step["delete"]), "path", "left_anti").select(*out.columns)
        return out

    def docs(self) -> DataFrame:
        """id, path, start_line, end_line, and the number of terms of each field, of every chunk that is there."""
        found = self._live("docs")
        return found if found is not None else self.spark.createDataFrame([], SCHEMAS["docs"])

    def search(self, query: str, boost: float = search.SYMBOL_BOOST) -> DataFrame:
        """id, path, score: BM25 of the content plus the boosted one of the symbol's name."""
        weights: dict[str, float] = {}
        for r in search.query_terms(self.spark, query).collect():  # the words of one query
            weights[r.term] = r.weight
        hits = None
        if weights:
            q = self.spark.createDataFrame(list(weights.items()), "term string, weight double").select("*", bucket_of(F.col("term")).alias("bucket"))
            buckets = sorted({r.bucket for r in q.collect()})
            hits = self._live("postings", lambda df: df.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(weights))))
        if hits is None:
            return self.docs().limit(0).select("id", "path", F.lit(0.0).alias("score"))
        docs = self.docs()
        whole = docs.agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in FIELDS])  # one row
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row for each term and field
        rows = hits.join(F.broadcast(q.drop("bucket")), "term").join(F.broadcast(df), ["field", "term"]).join(F.broadcast(whole))
        average = F.when(F.col("field") == "symbol", F.col("symbol")).otherwise(F.col("content"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("dl") / average))
        return rows.groupBy("id", "path").agg(F.sum(part * F.col("weight") * F.when(F.col("field") == "symbol", boost).otherwise(1.0)).alias("score"))
