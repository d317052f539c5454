"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle sets. A containment of
THRESHOLD in a set bounded in size is a Jaccard similarity bounded from below,
so for each partition a document's shingles that occur in any item of it are
taken in their order and cut into overlapping windows of four times the
partition's largest size: a window around a contained item then agrees with it
on one of HASHES MinHash coordinates at least, with a probability beyond
1 - 1e-9. Each candidate is verified by the exact containment of its shingles
in the whole document.

Items go to the executors in blocks of BLOCK bytes of text, each searched for in
all documents; a block's items, hashes and signatures have a size bound that
doesn't depend on the number of documents or items.

Defined results: a null text, or one without a word, neither contains nor is
contained; an item of one to four words is contained where just these words stand
in a row, anywhere in a document; repeated rows give repeated pairs; empty tables
give no rows; only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

THRESHOLD = 0.8
HASHES = 256
BLOCK = 4 << 20
SEEDS = shingles.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set of hashes, each tied to its coordinate; large sets in blocks."""
    out = np.full(HASHES, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 4096):
        out = np.minimum(out, shingles.mix(found[i : i + 4096, None] ^ SEEDS).min(0))
    return shingles.mix(out ^ SEEDS)


class Partition:
    """Items of one size class: their shingles and, sorted, their signatures' values."""

    def __init__(self, items: list[tuple[int, np.ndarray]], largest: int):
        self.window, self.sets = 4 * largest, [x for _, x in items]
        self.items = [i for i, _ in items]
        self.universe = np.unique(np.concatenate(self.sets))
        values = np.concatenate([signature(x) for x in self.sets])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(items)), HASHES)[order]

    def search(self, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, shingles found, shingles of the item) for each item that the hits of one document contain."""
        step, found = self.window // 2, set()
        for i in range(0, max(1, len(hits) - step), step):
            values = np.sort(signature(np.unique(hits[i : i + self.window])))
            low, high = np.searchsorted(self.values, values, "left"), np.searchsorted(self.values, values, "right")
            for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                found.update(self.owner[a:b].tolist())
        there = np.unique(hits)
        for k in sorted(found):
            n = int(np.isin(self.sets[k], there, assume_unique=True).sum())
            if n >= THRESHOLD * len(self.sets[k]):
                yield self.items[k], n, len(self.sets[k])


class Index:
    """The partitions of a block of items, and a filter for the shingles that occur in none."""

    BITS = 22

    def __init__(self, rows: list[tuple[int, str | None]]):
        long = [(i, t) for i, t in rows if shingles.length(t) >= shingles.SIZE]
        sets = [(i, shingles.distinct(t)) for i, t in long]
        #: By the number of words: hashes of items that are shorter than a shingle, sorted, and the items.
        self.short: dict[int, tuple[np.ndarray, list[int]]] = {}
        for size in range(1, shingles.SIZE):
            if own := sorted((int(shingles.sequence(t)[0]), i) for i, t in rows if shingles.length(t) == size):
                self.short[size] = np.array([h for h, _ in own], np.uint64), [i for _, i in own]
        by: dict[int, list] = {}
        for i, x in sets:
            by.setdefault(len(x).bit_length(), []).append((i, x))
        self.partitions = [Partition(items, 1 << k) for k, items in sorted(by.items())]
        self.filter = np.zeros(1 << self.BITS, bool)
        for p in self.partitions:
            self.filter[(p.universe >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def search(self, text: str | None) -> Iterator[tuple[int, int, int]]:
        seq = shingles.sequence(text)
        for size, (hashes, items) in self.short.items() if len(seq) else ():
            there = shingles.distinct(text, size)
            at = np.minimum(np.searchsorted(there, hashes), len(there) - 1)
            yield from ((items[k], 1, 1) for k in np.flatnonzero(there[at] == hashes).tolist())
        seq = seq[self.filter[(seq >> np.uint64(64 - self.BITS)).astype(np.int64)]]
        for p in self.partitions if len(seq) else ():
            at = np.minimum(np.searchsorted(p.universe, seq), len(p.universe) - 1)
            hits = seq[p.universe[at] == seq]
            if len(hits):
                yield from p.search(hits)


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_found, n_item of each document that contains an item."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // BLOCK))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own.collect()]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[dict]:
            index = sent.value
            for batch in common.by_size(batches, 2):
                got = [(i, th, *x) for i, th, t in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for x in index.search(t)]
                if got:
                    yield dict(zip(("doc_id", "th", "item_id", "n_found", "n_item"), map(list, zip(*got, strict=True)), strict=True))

        part = common.arrow_map(rows, run, "doc_id long, th long, item_id long, n_found long, n_item long")
        if blocks > 1:  # one block's index at a time on the driver and the executors
            part = common.stored(part, "matches")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_found, n_item, containment of each document that contains an item."""
    return found(docs, items).drop("th").withColumn("containment", F.round(F.col("n_found") / F.col("n_item"), 6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.documents(spark, sf_dir), common.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that contain no test item, told by doc_id and text: another text under the same doc_id stays."""
    th, hit_id, hit_th = (common.fresh(docs.columns, x) for x in ("th", "hit_id", "hit_th"))
    hits = found(docs, common.table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(hit_id), F.col("th").alias(hit_th)).distinct()
    hits = common.stored(hits, "contaminated")
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    return rows.join(hits, (F.col(th) == F.col(hit_th)) & F.col("doc_id").cast("long").eqNullSafe(F.col(hit_id)), "left_anti").select(*docs.columns)


ORACLE = f"""
WITH w AS (SELECT row_number() OVER () AS r, 'd' AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents
  UNION ALL SELECT row_number() OVER (), 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') FROM benchmark),
size AS (SELECT DISTINCT least(len(w), 5) AS k FROM w WHERE side = 'i' AND len(w) > 0),
s AS (SELECT r, side, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM w, size WHERE len(w) >= k AND (side = 'd' OR k = least(len(w), 5))),
d AS (SELECT DISTINCT r, id, k, s FROM s WHERE side = 'd'),
i AS (SELECT DISTINCT r, id, k, s FROM s WHERE side = 'i'),
n AS (SELECT r, count(*) AS n FROM i GROUP BY r)
SELECT doc_id, item_id, n_found, n AS n_item, round(n_found / n, 6) AS containment FROM (
  SELECT d.id AS doc_id, i.id AS item_id, i.r AS ir, count(*) AS n_found FROM d JOIN i USING (k, s) GROUP BY d.r, d.id, i.r, i.id) JOIN n ON n.r = ir
WHERE n_found >= {THRESHOLD} * n
"""
