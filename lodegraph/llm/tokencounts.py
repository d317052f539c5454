"""Token counts from flat token files by a scan for separators.

A flat token file is a run of little-endian ids, documents ending with an
end-of-document id, without an index. Files are read in blocks. Each block's
separators are found by one vector comparison; what a block can't know, the
tokens before its first separator that began in earlier blocks and the number of
documents before it, comes from a prefix scan over the blocks' sums, in two
levels, so that no task holds all blocks of a large file.

Defined results: adjacent separators are empty documents; tokens after a file's
last separator are one more document; an empty file has none. In the query, a
null text counts as empty, repeated rows give repeated results, an empty table
gives no rows, rows without a doc_id show as null, and only doc_id and text are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, common

END = 50256  # free in the vocabulary
WIDTH = "<u2"
BLOCK = 1 << 16  # tokens
SUPER = 1024  # blocks


def blocks_of(files: DataFrame, width: str = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, block, tokens of rows (file, content), as spark.read.format('binaryFile') gives them; a file is up to 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        step = block * np.dtype(width).itemsize
        for batch in batches:
            for i in range(batch.num_rows):
                raw = memoryview(batch.column(1)[i].as_buffer())
                for k in range(0, len(raw), step):
                    yield {"file": [batch.column(0)[i].as_py()], "block": [k // step], "tokens": [bytes(raw[k : k + step])]}

    return common.arrow_map(files.select(F.col("file").cast("string"), F.col("content").cast("binary")), run, "file string, block long, tokens binary")


def read_files(spark: SparkSession, path: str, width: str = WIDTH) -> DataFrame:
    return blocks_of(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), "content"), width)


def lengths(blocks: DataFrame, end: int = END, width: str = WIDTH) -> DataFrame:
    """file, ordinal, n_tokens of every document in blocks (file, block, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), width) for x in batch.column(2)]
            at = [np.flatnonzero(x == end) for x in found]
            yield {"file": batch.column(0), "block": batch.column(1), "n": [len(x) for x in found], "seps": [len(x) for x in at], "head": [int(x[0]) if len(x) else None for x in at], "last": [int(x[-1]) if len(x) else None for x in at], "inner": [(np.diff(x) - 1).astype(np.int32) for x in at]}

    b = common.stored(common.arrow_map(blocks, run, "file string, block long, n long, seps long, head long, last long, inner array<int>"), "blocks")
    b = b.withColumn("super", F.floor(F.col("block") / SUPER))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside, over = before("file", "super", "block"), before("file", "super")
    sums = b.groupBy("file", "super").agg(F.sum("n").alias("sn"), F.sum("seps").alias("ss"))
    sums = sums.select("file", "super", zero(F.sum("sn").over(over)).alias("s_start"), zero(F.sum("ss").over(over)).alias("s_docs"))
    placed = b.join(sums, ["file", "super"]).withColumn("start", F.col("s_start") + zero(F.sum("n").over(inside))).withColumn("docs", F.col("s_docs") + zero(F.sum("seps").over(inside))).withColumn("sep", F.col("start") + F.col("last"))
    placed = common.stored(placed.select("file", "super", "block", "n", "seps", "head", "inner", "start", "docs", "sep"), "placed")
    tops = placed.groupBy("file", "super").agg(F.max("sep").alias("top")).select("file", "super", F.max("top").over(over).alias("s_sep"))
    known = placed.join(tops, ["file", "super"]).withColumn("prior", F.coalesce(F.greatest(F.col("s_sep"), F.max("sep").over(inside)), F.lit(-1)))
    ended = known.where("seps > 0").select("file", "docs", F.posexplode(F.concat(F.array(F.col("start") + F.col("head") - F.col("prior") - 1), F.transform("inner", lambda x: x.cast("long")))).alias("k", "n_tokens"))
    ended = ended.select("file", (F.col("docs") + F.col("k")).alias("ordinal"), "n_tokens")
    rest = placed.groupBy("file").agg(F.max(F.col("start") + F.col("n")).alias("size"), F.max("sep").alias("sep"), F.sum("seps").alias("ordinal"))
    rest = rest.select("file", "ordinal", (F.col("size") - 1 - F.coalesce("sep", F.lit(-1))).alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(rest)


def write_tokens(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents as flat token streams, one for each input partition: blocks, and the ids in their order.

    The blocks don't follow document bounds and hold no index.
    """
    ranks, pattern = bpe.vocabulary(path)
    if END in ranks.values() or max(ranks.values()) >= 1 << 16:
        raise ValueError(f"the vocabulary needs ids of 16 bits without {END}, which ends documents")
    sent, key = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), bpe.digest(ranks, pattern)
    mark = np.array([END], WIDTH).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = bpe.codec(*sent.value, WIDTH, key)
        name, held, size, n, ids = f"part-{TaskContext.get().partitionId():06d}", [], 0, 0, 0
        step = block * 2

        def row(k: int, tokens: bytes | None, doc_ids: list | None) -> dict:
            return {"file": [name], "block": [k], "tokens": pa.array([tokens], pa.binary()), "ids": [doc_ids]}

        for batch in common.by_size(batches, 1):
            for x in codec.encode_batch(batch.column(1).to_pylist()):
                held += [x, mark]
                size += len(x) + 2
            yield row(ids, None, batch.column(0).to_pylist())
            ids += batch.num_rows
            if size >= step:
                raw = b"".join(held)
                for i in range(0, size - step + 1, step):
                    yield row(n, raw[i : i + step], None)
                    n += 1
                held = [raw[size - size % step :]]
                size %= step
        if size:
            yield row(n, b"".join(held), None)

    both = common.stored(common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "file string, block long, tokens binary, ids array<long>"), "tokens")
    order = both.where("ids is not null").select("file", "block", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("block") + F.col("i")).alias("ordinal"), "doc_id")
    return both.where("tokens is not null").select("file", "block", "tokens"), order


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document: its tokens without the separator."""
    blocks, order = write_tokens(common.documents(spark, sf_dir))
    return lengths(blocks).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")
