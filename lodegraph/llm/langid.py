"""Language identification as multilingual mixture inference.

Each language has smoothed counts of hashed byte trigrams of lower-cased words,
gathered from every training document. In a document each word has a likelihood
under each language; expectation-maximisation over the words estimates the
document's language proportions; nested language sets, largest proportion first,
are compared by penalised likelihood, growing as long as it rises, and the
prediction is the largest member of the set that wins.

Defined results: `und` with score 0 for null texts, texts without a letter, and
where nothing was learned; a null lang teaches nothing; rows with a null doc_id
are never held out; repeated rows give repeated results; an empty table gives no
rows. Only doc_id, text and lang are read. Ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BINS = 1 << 16
MAX_LANGS = 256  # the broadcast model has BINS numbers for each language
ROUNDS, REFINE = 8, 4
MAJORITY = 0.5
PENALTY = 4.0  # nats for each further language, beside half a logarithm of the words
FLOOR = 1e-7
LETTER = regex.compile(r"\p{L}")
TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bins of all words of all texts, the first bin of each word, and each word's text."""
    parts = [t.lower().encode("utf-8", "replace").translate(TABLE) for t in texts]
    buf = np.frombuffer(b"  " + b"  ".join(parts) + b"  ", np.uint8)
    ends = np.cumsum([len(p) + 2 for p in parts]) if parts else np.zeros(0, np.int64)
    word = buf != 32
    use = word.copy()
    use[1:] |= word[:-1]  # a word's end counts as a gram of it
    at = np.flatnonzero(use)
    x = buf.astype(np.uint32)
    h = x[at] * np.uint32(0x9E3779B1) + x[at - 1] * np.uint32(0x85EBCA6B) + x[at - 2] * np.uint32(0xC2B2AE35)
    first = np.flatnonzero(word[at] & ~word[at - 1])
    return ((h ^ (h >> np.uint32(15))) >> np.uint32(5)) & np.uint32(BINS - 1), first, np.searchsorted(ends, at[first], "left")


def learn(docs: DataFrame, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each bin in each, from all the rows given.

    The driver gets at most BINS sums for each language; the number of languages is checked.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[str, np.ndarray] = {}
        for batch in common.by_size(batches, 1, 2 << 20):
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                bins, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                got = np.bincount(bins, minlength=BINS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            for i in range(0, len(at), 4096):
                yield {"lang": [lang] * len(at[i : i + 4096]), "bin": at[i : i + 4096].astype(np.int32), "n": got[at[i : i + 4096]]}

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    sums = common.stored(common.arrow_map(rows, count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")), "langid")
    langs = sorted(r.lang for r in sums.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages; raise MAX_LANGS if executors can hold the model")
    counts = np.zeros((BINS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    for r in sums.toLocalIterator():
        counts[r.bin, place[r.lang]] = r.n
    return langs, np.log((counts + 0.5) / (counts.sum(0) + 0.5 * BINS)).astype(np.float32)


def mixture(share: np.ndarray, like: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each document after some rounds of EM from `share`, and the log likelihood of its words under them."""
    starts = np.searchsorted(doc, np.arange(len(share)), "left")
    words = np.diff(np.append(starts, len(doc)))[:, None]
    for _ in range(rounds):
        r = share[doc] * like
        r /= r.sum(1, keepdims=True)
        share = np.add.reduceat(r, starts, axis=0) / words
    return share, np.add.reduceat(np.log((share[doc] * like).sum(1)), starts)


def infer(texts: list[str], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: the predicted language, its proportion, the size of the set. Texts need a word."""
    bins, first, doc = grams(texts)
    n_docs, n_langs = len(texts), logp.shape[1]
    like = np.add.reduceat(logp[bins], first, axis=0)
    like = np.maximum(np.exp(like - like.max(1, keepdims=True)), FLOOR)
    words = np.bincount(doc, minlength=n_docs)
    full, _ = mixture(np.full((n_docs, n_langs), 1 / n_langs, np.float32), like, doc, ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    chosen, size, rows, best = order[:, 0].copy(), np.ones(n_docs, np.int64), np.arange(n_docs), np.full(n_docs, -np.inf)
    for m in range(1, n_langs + 1):  # larger sets for the documents whose last set was better than the one before
        of = np.zeros(n_docs, bool)
        of[rows] = True
        at = np.flatnonzero(of[doc])
        share = np.zeros((len(rows), n_langs), np.float32)
        np.put_along_axis(share, order[rows, :m], 1, axis=1)
        if m > 1:
            share *= full[rows] + np.float32(1e-6)
            share /= share.sum(1, keepdims=True)
        share, fit = mixture(share, like[at], (np.cumsum(of) - 1)[doc[at]], REFINE if m > 1 else 0)
        fit = fit - (m - 1) * (PENALTY + 0.5 * np.log(words[rows]))
        better = fit > best[rows]
        rows, share, fit = rows[better], share[better], fit[better]
        best[rows], size[rows], chosen[rows] = fit, m, share.argmax(1)
        if not len(rows):
            break
    return chosen, full[np.arange(n_docs), chosen], size


def _predictions(texts: list[str | None], langs: list[str], logp: np.ndarray) -> tuple[list, list, list]:
    some = [i for i, t in enumerate(texts) if langs and t and LETTER.search(t)]
    pred, score, size = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    if some:
        for i, c, s, m in zip(some, *(x.tolist() for x in infer([texts[i] for i in some], logp)), strict=True):
            pred[i], score[i], size[i] = langs[c], min(1.0, max(0.0, s)), m
    return pred, score, size


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score, n_langs of every row, by a learned model of checked size."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 1, 1 << 20):
            pred, score, size = _predictions(batch.column(1).to_pylist(), *sent.value)
            yield {"doc_id": batch.column(0), "lang_pred": pred, "score": score, "n_langs": size}

    return common.arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double, n_langs int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = common.held_out("doc_id", 4, 2)
    langs, logp = learn(docs.where(~out))
    return identify(docs, langs, logp).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "n_langs")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: Collection[str] | None = None, majority: float = MAJORITY) -> DataFrame:
    """The rows of docs in one of the languages to keep (None: any that is learned); the others go.

    A text is in a language that makes up `majority` of it at least, so texts without a
    letter and texts that mix languages without one that prevails go. A null lang is
    filled in by the prediction; other columns, and known values of lang, stay.
    """
    langs, logp = learn(docs.where(~common.held_out("doc_id", 4, 2)))
    sent, names = spark.sparkContext.broadcast((langs, logp)), list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, names.index("text"), 1 << 20):
            pred, score, _ = _predictions(batch.column(names.index("text")).to_pylist(), *sent.value)
            kept = [i for i, (x, s) in enumerate(zip(pred, score, strict=True)) if x != "und" and s >= majority and (keep is None or x in keep)]
            if kept:
                cols = dict(zip(names, batch.take(pa.array(kept)).columns, strict=True))
                yield cols | {"lang": pc.coalesce(cols["lang"], pa.array([pred[i] for i in kept], cols["lang"].type))}

    return common.arrow_map(docs, run, docs.schema)
