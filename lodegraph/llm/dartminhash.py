"""Near-duplicate groups by DartMinHash signatures and banded joining.

Darts: each element of a weighted set has an unending, hashed Poisson process of
darts over weight and rank. The elements are a text's shingles, and a shingle's
weight is how often it stands in the text. A document throws the darts below its
elements' weights and below a rank that yields enough of them, sends each dart to
one of K coordinates, and keeps the earliest for each coordinate. Two documents
agree on a coordinate with the probability of their weighted Jaccard similarity.

Joining: documents with the same weighted set form one class at once. The classes'
signatures are cut into bands; in each bucket of equal bands every member is held
against one leader, the one that meets the most others in all its buckets, which
is the likely origin of a group of copies. A similarity of at least THRESHOLD
(checked on the whole weighted sets) links two classes. Buckets that hold several
groups afterwards are settled in one pass: the members outside a bucket's largest
group are held against all its members of other groups, block against block.
Members are dealt out over tasks by hash and leaders by block, so that neither a
row for each pair is made nor a bucket gathered in one task; a block reports no
more links than join its groups. No link between different groups is lost.

Defined results: null texts and texts without a word are each a class of their
own; repeated rows fall in one class; an empty table gives no rows; rows without
a doc_id take part, and a class of such rows only shows null. Only doc_id and text
are read. The class id is the smallest doc_id of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, shingles

THRESHOLD = 0.8
ROWS, BANDS = 5, 24
COORDINATES = ROWS * BANDS
#: Leaders of a block, and elements of the members that a task is dealt and of a block's leaders.
LEADERS, DEALT, BLOCK = 64, 1 << 18, 1 << 17
GATHER = 1 << 16  # elements that are looked up at once
#: Cumulated probabilities of 0, 1, 2, ... darts in a cell of area 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 13)]))


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES, weights: np.ndarray | None = None) -> np.ndarray:
    """(n, k) earliest darts of n weighted sets; elements are grouped by owner, every owner has one at least.

    Weights are non-negative; a weight above 1 is cut into slabs of height 1, and
    of the last slab only the darts under the weight count.
    """
    weights = np.ones(len(elements)) if weights is None else np.asarray(weights, float)
    total = np.bincount(owner, weights, n)
    out = np.full((n, k), np.iinfo(np.uint64).max)
    flat = out.reshape(-1)
    need = np.arange(n)[total > 0]
    darts = k * np.log(k) + 2 * k
    low = np.zeros(n)
    while len(need):
        high = np.zeros(n)
        high[need] = darts / total[need]
        on = np.flatnonzero(high[owner] > 0)
        slabs = np.ceil(weights[on]).astype(np.int64)
        levels = np.ceil(high[owner[on]]).astype(np.int64)
        first = np.floor(low[owner[on]]).astype(np.int64)
        cells = slabs * (levels - first)
        cell = np.repeat(on, cells)
        step = np.arange(len(cell)) - np.repeat(np.cumsum(cells) - cells, cells)
        span = np.repeat(levels - first, cells)
        slab, level = step // span, step % span + np.repeat(first, cells)
        seed = shingles.mix(elements[cell] ^ shingles.mix((slab.astype(np.uint64) << np.uint64(32)) + level.astype(np.uint64) + np.uint64(1)))
        count = np.searchsorted(POISSON, (seed >> np.uint64(11)) / 2.0**53, "right")
        d = 0
        while len(cell := cell[(keep := count > d)]):
            seed, slab, level, count = seed[keep], slab[keep], level[keep], count[keep]
            h = shingles.mix(seed + np.uint64((d + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
            rank = level + (h >> np.uint64(32)) / 2.0**32
            h2 = shingles.mix(h)
            height = slab + (h2 >> np.uint64(32)) / 2.0**32
            own = owner[cell]
            hit = (rank < high[own]) & (rank >= low[own]) & (height < weights[cell])
            at = own[hit] * k + (h2[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % k
            # the rank decides, and the hash names the dart
            np.minimum.at(flat, at, (np.minimum(rank[hit] * 2.0**24, 2.0**40 - 1).astype(np.uint64) << np.uint64(24)) | (h[hit] & np.uint64(0xFFFFFF)))
            d += 1
        low[need] = high[need]
        need = need[(out[need] == np.iinfo(np.uint64).max).any(1)]
        darts *= 2
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bands) 64-bit keys of the bands, different for each band."""
    n, k = sig.shape
    cut = sig.reshape(n, k // rows, rows)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64), (n, k // rows)).copy()
    for i in range(rows):
        key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ cut[:, :, i])
    return key


def weighted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles, sorted, and how often each stands in it."""
    return np.unique(shingles.sequence(text), return_counts=True)


def expanded(found: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A weighted set as a plain one, sorted: each shingle as many times as its weight, told apart by number.

    The Jaccard similarity of two such sets is the weighted one.
    """
    if not len(times) or times.max() == 1:
        return found
    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    flat = np.repeat(found, times)
    return np.sort(np.where(number == 0, flat, shingles.mix(flat + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))))


def set_key(found: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(found.tobytes())


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), text of every row."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def sketch(rows: DataFrame) -> DataFrame:
    """doc_id, th, k (hash of the weighted set; null without words), bands, size of the set of every row of keyed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 2, 1 << 20):
            found = [weighted(t) for t in batch.column(2).to_pylist()]
            some = [i for i, x in enumerate(found) if len(x[0])]
            keys, bands, sizes = [None] * len(found), [None] * len(found), [int(x[1].sum()) for x in found]
            if some:
                owner = np.repeat(np.arange(len(some)), [len(found[i][0]) for i in some])
                sig = signatures(np.concatenate([found[i][0] for i in some]), owner, len(some), weights=np.concatenate([found[i][1] for i in some]))
                for i, b in zip(some, band_keys(sig).view(np.int64).tolist(), strict=True):
                    keys[i], bands[i] = set_key(expanded(*found[i])), b
            yield {"doc_id": batch.column(0), "th": batch.column(1), "k": keys, "bands": bands, "n": sizes}

    return common.arrow_map(rows, run, "doc_id long, th long, k string, bands array<long>, n int")


def sets_of(rows: DataFrame) -> DataFrame:
    """id, expanded set of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in common.by_size(batches, 1, 1 << 20):
            yield {"id": batch.column(0), "s": [expanded(*weighted(t)).view(np.int64).tolist() for t in batch.column(1).to_pylist()]}

    return common.arrow_map(rows.select("id", "text"), run, "id long, s array<long>")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, c: the smallest id reachable over links (a, b) from each node (id, c so far), by min-label hops with shortcuts."""
    labels = nodes
    while True:
        ends = links.join(labels.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb")
        hooks = common.stored(ends.select(F.greatest("ca", "cb").alias("c"), F.least("ca", "cb").alias("to")).groupBy("c").agg(F.min("to").alias("to")), "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # shorten chains of hooks before labels follow them
            via = hooks.join(hooks.select(F.col("c").alias("to"), F.col("to").alias("further")), "to", "left")
            if via.where("further is not null").isEmpty():
                break
            hooks = common.stored(via.select("c", F.coalesce("further", "to").alias("to")), "hooks")
        labels = common.stored(labels.join(hooks, "c", "left").select("id", F.coalesce("to", "c").alias("c")), "labels")


class Leaders:
    """Up to LEADERS expanded sets, and how many elements others share with each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        self.universe, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.holds = np.zeros((len(self.universe), len(sets)), np.int32)
        self.holds[at, np.repeat(np.arange(len(sets)), self.sizes)] = 1

    def shared(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes), np.int64)
        for i in range(0, len(found), GATHER):
            part = found[i : i + GATHER]
            at = np.minimum(np.searchsorted(self.universe, part), len(self.universe) - 1)
            out += self.holds[at[self.universe[at] == part]].sum(0)
        return out

    def alike(self, found: np.ndarray) -> np.ndarray:
        """Which leaders are as like to a set as THRESHOLD asks."""
        if not ((self.sizes >= THRESHOLD * len(found)) & (len(found) >= THRESHOLD * self.sizes)).any():
            return np.zeros(0, np.int64)
        both = self.shared(found)
        return np.flatnonzero(both >= THRESHOLD * (self.sizes + len(found) - both))


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Links (a, b) that join the groups of each block, from rows (at, lead, c, s) in the order of at, leaders first."""
    now, sets, labels, blocks, up = None, [], [], None, {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        links = []
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum([0, *pc.list_value_length(batch.column(3)).to_pylist()]).tolist()
        for i, (at, lead, c) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            if at != now:
                now, sets, labels, blocks, up = at, [], [], None, {}
            found = flat[ends[i] : ends[i + 1]]
            if lead:
                sets.append(found.copy())
                labels.append(c)
                continue
            if blocks is None:
                blocks = [(k, Leaders(sets[k : k + LEADERS])) for k in range(0, len(sets), LEADERS)]
            for k, block in blocks:
                for j in block.alike(found).tolist():
                    a, b = top(c), top(labels[k + j])
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        links.append((c, labels[k + j]))
        if links:
            yield dict(zip("ab", map(list, zip(*links, strict=True)), strict=True))


def across(bucket: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between groups that share buckets: of who is outside a bucket's largest group with all others there."""
    now = common.stored(bucket.join(labels.select("id", "c"), "id"), "grouped")
    size = now.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    mixed = size.groupBy("key").agg(F.count("*").alias("groups"), F.max_by("c", F.struct("m", "c")).alias("largest"), F.sum("n").alias("all_n"), (F.sum("m") - F.max("m")).alias("out_m"), F.sum("n").alias("out_n")).where("groups > 1")
    parts = lambda n, most: F.ceil(F.col(n) / F.lit(most))
    mixed = mixed.select("key", "largest", parts("all_n", DEALT).alias("deals"), F.greatest(parts("out_m", LEADERS), F.least(parts("out_n", BLOCK), F.col("out_m"))).alias("blocks"))
    rows = common.stored(now.join(mixed, "key"), "mixed")
    pick = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lead = rows.where("c <> largest").select("id", "c", "key", pick("blocks").alias("block"), every("deals").alias("deal"), F.lit(True).alias("lead"))
    held = rows.select("id", "c", "key", pick("deals").alias("deal"), every("blocks").alias("block"), F.lit(False).alias("lead"))
    both = lead.unionByName(held).join(sets, "id").select(F.struct("key", "deal", "block").alias("at"), F.col("lead"), "c", "s")
    both = both.select(F.concat_ws(":", "at.key", "at.deal", "at.block").alias("at"), "lead", "c", "s")
    return common.arrow_map(both.repartition("at").sortWithinPartitions("at", F.desc("lead")), settle, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, th, class_id (smallest doc_id of the group), w_id and w_th (its first row) of every row; all but doc_id and th null without words."""
    mark, source = common.so_far(), keyed(docs)
    rows = common.stored(sketch(source), "sketch")
    # one row for each distinct weighted set, with its first row
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    texts = rows.where("k is not null").groupBy("k").agg(F.min(place).alias("first"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    texts = common.stored(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    members = texts.select("id", "n", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    bucket = common.stored(members.join(shared, "key"), "buckets")
    # who meets the most others is the likely origin of a group of copies, and leads
    mass = common.stored(bucket.groupBy("id").agg(F.sum("m").alias("mass")), "mass")
    lead = common.stored(bucket.join(mass, "id").groupBy("key").agg(F.max(F.struct("mass", "id", "n")).alias("l")).select("key", F.col("l.id").alias("lead"), F.col("l.n").alias("ln")), "leaders")
    close = F.least("n", "ln") >= THRESHOLD * F.greatest("n", "ln")  # else the sets can't be as like
    pairs = bucket.join(lead, "key").where((F.col("id") != F.col("lead")) & close).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
    heads = mass.select("id").join(texts.select("id", "first"), "id").select("id", F.col("first.doc_id").alias("h_id"), F.col("first.th").alias("h_th"))
    found = source.join(heads, (source["th"] == heads["h_th"]) & source["doc_id"].eqNullSafe(heads["h_id"])).select("id", "text")
    sets = common.stored(sets_of(found).dropDuplicates(["id"]), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    links = common.stored(both.where(inter >= THRESHOLD * (F.size("sa") + F.size("sb") - inter)).select("a", "b"), "links")
    labels = components(mass.select("id", F.col("id").alias("c")), links)
    labels = components(labels, common.stored(across(bucket.select("key", "id", "n"), labels, sets), "links"))
    firsts = texts.select("k", "id", "first").join(labels, "id", "left").select("k", "first", F.coalesce("c", "id").alias("c"))
    ids = firsts.groupBy("c").agg(F.min("first").alias("w"))
    named = common.stored(firsts.join(ids, "c").select("k", F.col("w.doc_id").alias("class_id"), F.col("w.doc_id").alias("w_id"), F.col("w.th").alias("w_th")), "named")
    common.drop_since(mark, rows, named)
    return rows.join(named, "k", "left").select("doc_id", "th", "class_id", "w_id", "w_th")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, class_id of every row."""
    return classes(docs).select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one of the smallest doc_id, rows without a doc_id last.

    Rows go one by one, by doc_id and text: another text under the same doc_id
    stays. Rows without a word stay all.
    """
    mark = common.so_far()
    found = classes(docs.select("doc_id", "text")).where("w_th is not null")
    wins = (F.col("th") == F.col("w_th")) & F.col("doc_id").eqNullSafe(F.col("w_id"))
    th, g_id, g_th, wins_, times = (common.fresh(docs.columns, x) for x in ("th", "g_id", "g_th", "wins", "times"))
    judged = common.stored(found.groupBy("doc_id", "th").agg(F.max(wins).alias("wins"), F.count("*").alias("times")).where("not wins or times > 1").toDF(g_id, g_th, wins_, times), "judged")
    common.drop_since(mark, judged)
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    same = (F.col(th) == F.col(g_th)) & F.col("doc_id").cast("long").eqNullSafe(F.col(g_id))
    alone = rows.join(judged, same, "left_anti").select(*docs.columns)
    again = judged.where(F.col(wins_))
    if again.isEmpty():
        return alone
    return alone.unionByName(rows.join(again, same, "left_semi").dropDuplicates([th, "doc_id"]).select(*docs.columns))
