"""Quality scores by votes of the nearest labelled texts in a latent semantic space.

Terms of a text are trigrams of byte classes (small and capital letters, digits,
spaces, kinds of signs) and signs of repetition; their square-rooted shares,
weighted by rarity, are projected on the leading singular vectors of a labelled
sample. The sample's vectors are broadcast; every text gets its exact cosine to
each of them, in blocks, and its NEIGHBOURS nearest vote by similarity.

SAMPLE, the number of labelled texts that are fitted, is the documented bound of
the broadcast; everything else covers every row. The score never sees labels,
lang, source or doc_id of the row that is scored.

Defined results: a null or empty text, or any where nothing could be learned, gets
the sample's share of label 1, or 0.5 without one; null labels and null doc_ids
teach nothing; several labels of a document are averaged; repeated rows give
repeated results; an empty table gives no rows; only doc_id, text and quality are
read. Of neighbours as near as each other, to DECIMALS of the cosine, the first of
the sample's order (by a hash of doc_id) vote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE, DIMENSIONS, NEIGHBOURS, POWER = 6000, 48, 15, 4.0
DECIMALS = 5
CLASSES = 16
SIGNS = 6
TERMS = CLASSES**3 + SIGNS
SIGN_WEIGHT = 1.5


def _classes() -> np.ndarray:
    out = np.full(256, 15, np.uint16)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".", b",;:", b"!", b"?", b"|", b"*", b"#$%&@", b"\"'()[]{}", b"<>/\\=+-_~^`")):
        out[list(chars)] = k
    out[192:] = 14
    return out


CLASS = _classes()


def terms(text: str | None) -> np.ndarray:
    """Square-rooted shares of a text's terms; all zero for an empty text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    c = CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    if len(c) >= 3:
        out[: CLASSES**3] = np.sqrt(np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=CLASSES**3) / (len(c) - 2))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if words:
        n = len(words)
        threes = set(zip(words, words[1:], words[2:], strict=False))
        same = sum(map(str.__eq__, words, words[1:]))
        letters = sum(map(str.isalpha, text))
        signs = (same / n, 1 - len(threes) / max(1, n - 2), max(0.0, 0.5 - len(set(words)) / n), 1 - len(set(lines)) / len(lines), min(1.0, sum(map(len, words)) / n / 40), letters / len(text))
        out[-SIGNS:] = SIGN_WEIGHT * np.sqrt(np.clip(signs, 0, 1))
    return out


class Space:
    """Projection and labelled vectors, fitted on a bounded sample."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        if not len(labels):
            return
        self.weight = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
        x = rows * self.weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        k = min(DIMENSIONS, *x.shape)
        q = np.linalg.qr(x @ np.random.default_rng(0).standard_normal((x.shape[1], k + 16), np.float32))[0]
        for _ in range(3):
            q = np.linalg.qr(x @ (x.T @ q))[0]
        self.axes = np.linalg.svd(q.T @ x, full_matrices=False)[2][:k].T.copy()
        self.vectors = self.project(rows)

    def project(self, rows: np.ndarray) -> np.ndarray:
        v = (rows * self.weight) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.share)
        for i in range(0, len(texts) if len(self.labels) else 0, 256):
            rows = np.stack([terms(t) for t in texts[i : i + 256]])
            cos = np.round(self.project(rows) @ self.vectors.T, DECIMALS)
            k = min(NEIGHBOURS, cos.shape[1])
            last = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
            ties = cos == last
            free = k - (cos > last).sum(1, keepdims=True)
            near = np.nonzero((cos > last) | (ties & (np.cumsum(ties, 1) <= free)))[1].reshape(len(rows), k)
            sim = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(float) ** POWER
            votes, total = (sim * self.labels[near]).sum(1), sim.sum(1)
            some = (rows.any(1)) & (total > 0)
            out[i : i + 256][some] = votes[some] / total[some]
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Space:
    """A space from up to `sample` labelled documents that aren't held out; the choice is by a hash of doc_id."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~common.held_out("doc_id", 3, 1))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.avg("quality").alias("q")).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 1):
            rows = [terms(t) for t in batch.column(1).to_pylist()]
            yield {"l_id": batch.column(0), "q": batch.column(2), "x": [r.astype(np.float16).tobytes() for r in rows]}

    # the ids are at most `sample`, so they may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("l_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "l_id").select("l_id", "text", "q")
    got = common.arrow_map(rows, run, "l_id long, q double, x binary").orderBy(F.xxhash64("l_id"), "l_id", "x").limit(sample).collect()
    return Space(np.array([np.frombuffer(r.x, np.float16) for r in got], np.float32).reshape(len(got), TERMS), np.array([float(r.q >= 0.5) for r in got]))


def scores(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 1, 2 << 20):
            yield {"doc_id": batch.column(0), "score": sent.value.score(batch.column(1).to_pylist())}

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = scores(docs, fit(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality")))
    return out.select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
