"""Exact substring de-duplication by longest-previous-factor arrays.

A string of `length` bytes repeats if it starts at two places of the corpus. Each
such window belongs to its minimizer, the smallest hash of the grams in it, so
equal windows meet under one key wherever they stand. Neighbouring windows of one
minimizer form a piece of text. Equal pieces repeat as a whole and are only
counted. Where one minimizer has pieces that differ, or one piece may hold its
minimizer twice, the pieces are joined and their windows put in suffix order to a
depth of `length`, by ranks of doubled and tripled depth. Common prefixes of
neighbours follow from the same ranks; previous and next smaller positions in
suffix order, found by jumping pointers, give each window's longest previous
factor: the longest string, up to `length`, that also starts at an earlier place.
A window whose factor reaches `length` is a later copy; what is the earlier place
of one shows as a neighbour with a common prefix of `length`.

A minimizer with more than HOT bytes of differing pieces isn't ordered in one
task: 128-bit hashes of its windows are dealt out and counted. Equal pieces, too,
are told by 128-bit hashes.

Defined results: null texts count as empty; texts under `length` bytes keep all;
windows never cross texts; rows of equal doc_id and text share their result (two
of them are each other's copies; under keep_first both keep what first stands in
them); rows without a doc_id take part; an empty table gives no rows; only doc_id
and text are read. Long texts are worked on in overlapping segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

#: Bytes of a repeated string for the query; and for passages of over 50 words, in the pipeline and in a further column.
LENGTH, PASSAGE = 400, 240
SEGMENT = 1 << 16
RUN = 4096
HOT = 1 << 23  # takes about 70 bytes of memory a byte
CHUNK = 1 << 18
LARGE = 1 << 21  # ranks of so many places fit 21 bits, so that three make one sort key
_bytes = [shingles.mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * i + 1)) for i in (1, 2)]
_BASE = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def _pow(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def gram_hashes(buf: np.ndarray, sizes: tuple[int, ...], which: int = 0) -> np.ndarray:
    """Hashes of all strings whose length is the sum of sizes (falling powers of two), by doubling."""
    level, at, done = _bytes[which][buf], 1, {}
    while True:
        if at in sizes:
            done[at] = level
        if at >= sizes[0]:
            break
        level = level[:-at] * _pow(_BASE[which], at) + level[at:]
        at *= 2
    n = len(buf) - sum(sizes) + 1
    out, offset = np.zeros(n, np.uint64), 0
    for s in sizes:
        out = out * _pow(_BASE[which], s) + done[s][offset : offset + n]
        offset += s
    return shingles.mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    at, n = 1, len(x) - width + 1
    while at * 2 <= width:
        x = np.minimum(x[:-at], x[at:])
        at *= 2
    return np.minimum(x[:n], x[width - at : width - at + n])


def gram_of(length: int) -> int:
    """Bytes of a minimizer's gram: long ones meet by chance in fewer texts, short ones make fewer pieces."""
    return 1 << max(2, (length // 5).bit_length() - 1)


def pieces(text: bytes, length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Arrays of minimizer, first window, windows, whether it may hold its minimizer twice, and digests of a text's pieces, by segment."""
    buf, gram, view = np.frombuffer(text, np.uint8), gram_of(length), memoryview(text)
    for a in range(0, len(buf) - length + 1, SEGMENT):
        h = gram_hashes(buf[a : a + SEGMENT + length - 1], (gram,))
        m = sliding_min(h, length - gram + 1)
        starts = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        n = np.diff(np.append(starts, len(m)))
        if n.max() > RUN:
            parts = -(-n // RUN)
            step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            ends = np.repeat(starts + n, parts)
            starts = np.repeat(starts, parts) + step * RUN
            n = np.minimum(ends - starts, RUN)
        v = m[starts]
        low, times = np.unique(h[h <= v.max()], return_counts=True)
        twice = times[np.searchsorted(low, v)] > 1
        starts += a
        yield v.view(np.int64), starts, n, twice, [xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(starts.tolist(), (starts + n + (length - 1)).tolist(), strict=True)]


def suffix_order(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts in suffix order (by bytes to a depth of `length`, then by place), and the common prefix of each with the one before, up to `length`."""
    sizes = np.array([len(t) - length + 1 for t in texts])
    buf = np.frombuffer(b"".join(texts) + bytes(length + 8), np.uint8)
    x, at = buf.astype(np.uint64), 1
    while at < 8:
        x = (x[:-at] << np.uint64(8 * at)) | x[at:]
        at *= 2
    levels, depth = [(8, _rank(x))], 8
    del x
    while depth * 2 <= length:
        rank = levels[-1][1]
        if depth * 3 <= length and len(buf) < LARGE:
            both = rank[: -2 * depth].astype(np.uint64) << np.uint64(42)
            both |= rank[depth:-depth].astype(np.uint64) << np.uint64(21)
            both |= rank[2 * depth :]
            depth *= 3
        else:
            both = rank[:-depth].astype(np.uint64) << np.uint64(32)
            both |= rank[depth:]
            depth *= 2
        levels.append((depth, _rank(both)))
        del both
    rank, offsets = levels[-1][1], np.cumsum([0, *[len(t) for t in texts]])[:-1]
    window = (np.repeat(offsets - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())).astype(np.int32)
    if length >= 8:
        key = rank[window].astype(np.uint64) << np.uint64(32)
        key |= rank[window + np.int32(length - depth)]
    else:
        key = np.zeros(len(window), np.uint64)
        for k in range(length):
            key = (key << np.uint64(8)) | buf[window + np.int32(k)]
    order = np.argsort(key, kind="stable").astype(np.int32)
    common_ = np.full(len(order), length, np.int16)
    common_[:1] = 0
    key = key[order]
    differ = (1 + np.flatnonzero(key[1:] != key[:-1])).astype(np.int32)
    del key
    for i in range(0, len(differ), CHUNK):  # a part at a time, for memory's sake
        at = differ[i : i + CHUNK]
        a, b = window[order[at - 1]], window[order[at]]
        got = np.zeros(len(at), np.int32)
        for depth, rank in reversed(levels):
            for _ in range(2):
                ok = np.flatnonzero(got + depth <= length)
                got[ok[rank[a[ok] + got[ok]] == rank[b[ok] + got[ok]]]] += depth
        on = np.arange(len(at))
        for _ in range(7):
            on = on[buf[a[on] + got[on]] == buf[b[on] + got[on]]]
            got[on] += 1
        common_[at] = np.minimum(got, length)
    return order, common_


def _rank(x: np.ndarray) -> np.ndarray:
    """The place of each value among the distinct ones."""
    order = np.argsort(x)
    new = np.zeros(len(x), bool)
    part = x[order]
    np.not_equal(part[1:], part[:-1], out=new[1:])
    del part
    out = np.empty(len(x), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32)
    return out


def smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each place i of an order: the common prefix with its previous smaller position, 0 where there is none.

    shared[i] is the common prefix of i with i - 1. Pointers jump over larger positions, all at once.
    """
    at, low = np.arange(-1, len(position) - 1, dtype=np.int32), shared.copy()
    on = np.arange(1, len(position), dtype=np.int32)
    while len(on := on[position[at[on]] > position[on]]):
        via = at[on]
        low[on], at[on] = np.minimum(low[on], low[via]), at[via]
        on = on[at[on] >= 0]
    low[at < 0] = 0
    return low


def factors(texts: list[bytes], length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window of each text, in the order of the texts: the longest previous factor, and the longest string that it shares with any other window; both up to `length`."""
    order, shared = suffix_order(texts, length)
    before = smaller(order, shared)
    back = np.append(shared[1:], shared[:0].dtype.type(0))  # with the one behind
    after = smaller(order[::-1], back[::-1])[::-1]
    lpf, other = np.empty(len(order), np.int16), np.empty(len(order), np.int16)
    lpf[order], other[order] = np.maximum(before, after), np.maximum(shared, back)
    cuts = np.cumsum([len(t) - length + 1 for t in texts])[:-1]
    return list(zip(np.split(lpf, cuts), np.split(other, cuts), strict=True))


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    d = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True))


def bodies(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), off (0), body (bytes) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.lit(0).alias("off"), text.cast("binary").alias("body"))


def _beside(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """rows with what found has for their doc_id and th."""
    other = found.withColumnsRenamed({"doc_id": "o_id", "th": "o_th"})
    return rows.join(other, (rows["th"] == other["o_th"]) & rows["doc_id"].eqNullSafe(other["o_id"]), how).drop("o_id", "o_th")


def spans(source: DataFrame, keep_first: bool, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, th, spans (arrays of first and end byte, may overlap) of the rows of bodies() or regions() that lose bytes; written."""
    sizes = tuple(1 << k for k in reversed(range(length.bit_length())) if length >> k & 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 3, 1 << 20):
            ids, found = [], []
            for i in range(batch.num_rows):
                for got in pieces(batch.column(3)[i].as_py(), length):
                    ids.append(np.full(len(got[0]), i))
                    found.append(got)
            if found:
                v, start, n, twice = (np.concatenate([x[k] for x in found]) for k in range(4))
                row = np.concatenate(ids)
                off = batch.column(2).to_numpy()[row]
                keys = batch.select([0, 1]).take(pa.array(row))
                yield {"doc_id": keys.column(0), "th": keys.column(1), "v": v, "start": (off + start).astype(np.int32), "n": n.astype(np.int32), "twice": twice, "dig": [d for x in found for d in x[4]]}

    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "start")
    all_pieces = common.stored(common.arrow_map(source.where(F.octet_length("body") >= length), cut, "doc_id long, th long, v long, start int, n int, twice boolean, dig binary"), "pieces")
    distinct = common.stored(all_pieces.groupBy("v", "dig").agg(F.count("*").alias("times"), F.min(at).alias("at"), F.first("n").alias("n"), F.max("twice").alias("twice")), "distinct")
    common.free(source.sparkSession)
    keys = distinct.groupBy("v").agg(F.count("*").alias("kinds"), F.max("twice").alias("twice"), F.sum(F.col("n") + (length - 1)).alias("size")).where("kinds > 1 or twice").select("v", (F.col("size") > hot).alias("hot"))
    # what has to be held against other text: one place of each distinct piece
    wanted = distinct.join(keys, "v").select(F.col("at.doc_id").alias("doc_id"), F.col("at.th").alias("th"), F.struct("hot", "v", F.col("at.start").alias("start"), "n").alias("p"))
    wanted = common.stored(wanted.groupBy("doc_id", "th").agg(F.collect_list("p").alias("ps")), "wanted")
    repeated = common.stored(distinct.where("times > 1").select("v", "dig", "at"), "repeated")
    common.drop(distinct)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("hot", "v", "doc_id", "th", "start", "n", "piece", "a", "b")
        for batch in common.by_size(batches, 3, 1 << 18):
            out = []
            for i, th, off, body, ps in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                for p in ps:
                    if not off <= p["start"] < off + len(body):
                        continue  # it lies in another region of the text
                    piece = body[p["start"] - off : p["start"] - off + p["n"] + length - 1]
                    if p["hot"]:
                        buf = np.frombuffer(piece, np.uint8)
                        out.append((True, p["v"], i, th, p["start"], p["n"], None, *(gram_hashes(buf, sizes, w).view(np.int64).tolist() for w in (0, 1))))
                    else:
                        out.append((False, p["v"], i, th, p["start"], p["n"], piece, None, None))
            if out:
                yield dict(zip(names, map(list, zip(*out, strict=True)), strict=True))

    found = _beside(source, wanted, "inner").select("doc_id", "th", "off", "body", "ps")
    fetched = common.stored(common.arrow_map(found, fetch, "hot boolean, v long, doc_id long, th long, start int, n int, piece binary, a array<long>, b array<long>"), "fetched")
    common.free(source.sparkSession)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple] = []

        def settle(held: list[tuple]) -> Iterator[dict]:
            # repeated rows bring the same piece more than once: it is one place
            held = list(dict.fromkeys(held))
            out = []
            for (_, i, th, start, piece), (lpf, other) in zip(held, factors([x[4] for x in held], length), strict=True):
                out += [(i, th, start + s, start + e - 1 + length) for s, e in runs((lpf if keep_first else other) >= length)]
            if out:
                yield dict(zip(("doc_id", "th", "s", "e"), map(list, zip(*out, strict=True)), strict=True))

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if size + len(row[4]) > CHUNK and held and row[0] != held[-1][0]:
                    yield from settle(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield from settle(held)

    plain = fetched.where("not hot").select("v", "doc_id", "th", "start", "piece")
    by_order = common.arrow_map(plain.repartition("v").sortWithinPartitions("v", F.col("doc_id").isNull(), "doc_id", "th", "start"), order, "doc_id long, th long, s int, e int")
    windows = fetched.where("hot").select("doc_id", "th", "start", F.posexplode(F.arrays_zip("a", "b")).alias("i", "h")).select("doc_id", "th", (F.col("start") + F.col("i")).alias("start"), "h.a", "h.b").distinct()
    by_hash = windows.join(windows.groupBy("a", "b").agg(F.count("*").alias("times"), F.min(at).alias("at")).where("times > 1"), ["a", "b"])
    whole = all_pieces.join(repeated, ["v", "dig"])
    if keep_first:
        by_hash, whole = by_hash.where(~at.eqNullSafe(F.col("at"))), whole.where(~at.eqNullSafe(F.col("at")))
    by_hash = by_hash.select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + length).alias("e"))
    whole = whole.select("doc_id", "th", F.col("start").alias("s"), (F.col("start") + F.col("n") + (length - 1)).alias("e"))
    out = common.stored(whole.unionByName(by_order).unionByName(by_hash).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    common.drop(all_pieces, wanted, repeated, fetched)
    return out


def regions(source: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """doc_id, th, off, body of the runs of at least `length` bytes in what spans() found; repeated strings of that length all lie in such runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 2):
            out = [(i, th, s, body[s:e]) for i, th, body, xs in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True) for s, e in runs(mask(len(body), [(x["s"], x["e"]) for x in xs])) if e - s >= length]
            if out:
                yield dict(zip(("doc_id", "th", "off", "body"), map(list, zip(*out, strict=True)), strict=True))

    return common.arrow_map(_beside(source, found, "inner").select("doc_id", "th", "body", "spans"), run, "doc_id long, th long, off int, body binary")


def mask(n: int, found: list[tuple[int, int]]) -> np.ndarray:
    d = np.zeros(n + 1, np.int32)
    if found:
        s, e = np.array(found).T
        np.add.at(d, s, 1)
        np.add.at(d, e, -1)
    return np.cumsum(d[:-1]) > 0


def removed(docs: DataFrame, keep_first: bool = False, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), n_passage of every row.

    n_passage: the bytes covered by repeated strings of `passage` bytes (at most
    `length`), which are searched first, so that the longer ones are searched for
    among them only; null without a passage.
    """
    source = bodies(docs)
    if passage is None:
        found = spans(source, keep_first, length).withColumn("short", F.lit(None).cast("array<struct<s int, e int>>"))
    else:
        short = spans(source, False, passage)
        within = common.stored(regions(source, short, length), "regions")
        long = spans(within, keep_first, length)
        common.drop(within)
        found = _beside(short.withColumnRenamed("spans", "short"), long, "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 1):
            out = []
            for i, body, found, short in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                m = mask(len(body), [(x["s"], x["e"]) for x in found or ()])
                covered = None if passage is None else int(mask(len(body), [(x["s"], x["e"]) for x in short or ()]).sum())
                out.append((i, len(body), int(m.sum()), len(runs(m)), np.frombuffer(body, np.uint8)[~m].tobytes() if found else body, covered))
            yield dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage"), map(list, zip(*out, strict=True)), strict=True))

    both = _beside(source, found, "left").select("doc_id", "body", "spans", "short")
    return common.arrow_map(both, apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of what is left without strings of LENGTH bytes, and n_passage for the shorter ones, which stay."""
    out = removed(common.table(spark, sf_dir, "documents", "doc_id", "text"), passage=PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage")


def whole_characters(raw: np.ndarray, m: np.ndarray) -> np.ndarray:
    """m, with runs shortened to whole UTF-8 characters."""
    for s, e in runs(m):
        while s < e and raw[s] & 0xC0 == 0x80:
            m[s], s = False, s + 1
        if e < len(raw) and raw[e] & 0xC0 == 0x80:
            while e > s:
                e -= 1
                m[e] = False
                if raw[e] & 0xC0 == 0xC0:
                    break
    return m


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with later copies of repeated strings of PASSAGE bytes cut from their texts, whole characters only; texts emptied so go."""
    th, o_id, o_th, cuts = (common.fresh(docs.columns, x) for x in ("th", "o_id", "o_th", "cuts"))
    found = spans(bodies(docs), True, PASSAGE).toDF(o_id, o_th, cuts)
    key = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = key.join(found, (F.col(th) == F.col(o_th)) & F.col("doc_id").cast("long").eqNullSafe(F.col(o_id)), "left")
    k, schema = docs.columns.index("text"), docs.schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, k):
            texts = []
            for t, found in zip(batch.column(k).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if found:
                    raw = np.frombuffer(t.encode(), np.uint8)
                    t = raw[~whole_characters(raw, mask(len(raw), [(x["s"], x["e"]) for x in found]))].tobytes().decode()
                    texts.append((bool(t), t))
                else:
                    texts.append((True, t))
            kept = batch.take(pa.array([i for i, x in enumerate(texts) if x[0]], pa.int32()))
            cols = dict(zip(schema.names, kept.columns, strict=False))
            yield cols | {"text": [t for keep, t in texts if keep]}

    return common.arrow_map(both.select(*schema.names, cuts), apply, schema)
