"""Walks over directed edges: reach with paths, and strongly connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop, ranked, stored

SEEDS = 64  # seeds of a block: the bits of a long
LOCAL = 5_000_000  # edges and symbols up to which every worker holds the graph of a walk
SMALL = 100_000  # edges up to which components are found on the driver


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None, backward: bool = False) -> DataFrame:
    """seed, node, depth, pred, line, chain for every node within max_depth steps of each seed (seeds have depth 0); None: however far.

    A level loop for all seeds at once. Of several predecessors the smallest id counts, and of
    several lines the smallest, so the result doesn't depend on order. chain runs from the
    reached node to the seed when walking backward, from the seed to the node otherwise.
    """
    a, b = ("to_symbol", "from_symbol") if backward else ("from_symbol", "to_symbol")
    steps = edges.groupBy(F.col(a).alias("at"), F.col(b).alias("next")).agg(F.min("line").alias("eline"))
    steps = cut(steps.where("at is not null and next is not null"))
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("long").alias("pred"), F.lit(None).cast("int").alias("line"), F.array("seed").alias("chain")).distinct()
    seen = front = cut(seen)
    for d in count(1) if max_depth is None else range(1, max_depth + 1):
        go = front.join(steps, front["node"] == steps["at"]).select("seed", F.col("next").alias("node"), F.struct(F.col("at").alias("pred"), F.col("eline").alias("line"), "chain").alias("p"))
        new = go.groupBy("seed", "node").agg(F.min("p").alias("p")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        chain = F.concat(F.array("node"), F.col("p.chain")) if backward else F.concat(F.col("p.chain"), F.array("node"))
        front = cut(new.select("seed", "node", F.lit(d).alias("depth"), F.col("p.pred").alias("pred"), F.col("p.line").alias("line"), chain.alias("chain")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if d % 16 == 0:  # so that the plan of a long walk stays small
            seen = cut(seen)
    return seen


def numbered(seeds: DataFrame) -> DataFrame:
    """seed, block, bit: a place for every seed among blocks of SEEDS, in the order of their ids."""
    at = ranked(seeds.select("seed").distinct(), "no", "seed")
    return stored(at.select("seed", F.floor((F.col("no") - 1) / SEEDS).alias("block"), ((F.col("no") - 1) % SEEDS).alias("bit")), "seeds")


def bits(mask: Column) -> Column:
    """The places of the bits that are set in a mask."""
    return F.filter(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda i: F.call_function("getbit", mask, i) == 1)


def spread(edges: DataFrame, places: DataFrame, max_depth: int | None, backward: bool = False) -> Iterator[tuple[int, DataFrame]]:
    """(depth, state) level by level, up to max_depth or, with None, however far; at last the state in which nothing is new.

    state: node, block, and as masks over the block's seeds those that have reached the node (seen) and
    those whose shortest distance is this depth (new). A row stands for up to SEEDS pairs of seed and
    node. A state is deleted when the next but one is asked for, so two are there at a time.
    """
    yield from leveled(stepped(edges, backward), places, max_depth)


def stepped(edges: DataFrame, backward: bool = False) -> DataFrame:
    """at, next: the distinct edges in the direction of a walk, in the shared folder."""
    a, b = ("to_symbol", "from_symbol") if backward else ("from_symbol", "to_symbol")
    return stored(edges.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("at"), F.col(b).alias("next")).distinct(), "steps")


def leveled(steps: DataFrame, places: DataFrame, max_depth: int | None) -> Iterator[tuple[int, DataFrame]]:
    """spread() over stepped(), which is deleted at the end."""
    mask = F.expr("shiftleft(1L, bit)")
    state, old = stored(places.select(F.col("seed").alias("node"), "block", mask.alias("seen"), mask.alias("new")), "level"), None
    for d in count():
        yield d, state
        if old is not None:
            drop(old)
        if d == max_depth or state.where("new <> 0").isEmpty():
            drop(steps)
            return
        come = state.where("new <> 0").join(steps, F.col("node") == F.col("at")).groupBy(F.col("next").alias("node"), "block").agg(F.bit_or("new").alias("come"))
        both = state.select("node", "block", "seen", F.lit(0).cast("long").alias("come")).unionByName(come.withColumn("seen", F.lit(0).cast("long")))
        both = both.groupBy("node", "block").agg(F.bit_or("seen").alias("s"), F.bit_or("come").alias("c"))
        s, c = F.col("s"), F.col("c")
        old, state = state, stored(both.select("node", "block", s.bitwiseOR(c).alias("seen"), c.bitwiseAND(F.bitwise_not(s)).alias("new")), "level")


def farthest(edges: DataFrame, seeds: DataFrame, backward: bool = False, local: int = LOCAL) -> DataFrame:
    """seed, depth: the largest of the shortest distances from each seed, however far.

    A graph of up to `local` edges, which is checked, is walked by each task for its own seeds; a larger one level by level.
    """
    steps = stepped(edges, backward)
    if steps.count() <= local:
        return by_seeds(steps, seeds, None, farthest_of, "depth int")
    places, out = numbered(seeds), None
    for d, state in leveled(steps, places, None):
        level = stored(state.where("new <> 0").groupBy("block").agg(F.bit_or("new").alias("new")).withColumn("depth", F.lit(d)), "levels")
        out = level if out is None else out.unionByName(level)
        if d % 16 == 15:  # so that the plan of a long walk stays small
            out = stored(out, "levels")
    drop(state)
    return out.select("block", "depth", F.explode(bits(F.col("new"))).alias("bit")).groupBy("block", "bit").agg(F.max("depth").alias("depth")).join(places, ["block", "bit"]).select("seed", "depth")


def surroundings(edges: DataFrame, seeds: DataFrame, max_depth: int, backward: bool = False) -> tuple[DataFrame, DataFrame]:
    """Who is reached within max_depth steps: node, block and masks own (the node is the seed), direct (one step) and far (more); and numbered(seeds)."""
    return near(stepped(edges, backward), seeds, max_depth)


def near(steps: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """surroundings() over stepped()."""
    places, none = numbered(seeds), F.lit(0).cast("long")
    kinds, parts = ("own", "direct"), []
    for d, state in leveled(steps, places, max_depth):
        if d < len(kinds):
            parts.append(stored(state.where("new <> 0").select("node", "block", none.alias("seen"), *[(F.col("new") if i == d else none).alias(k) for i, k in enumerate(kinds)]), "near"))
    out = state.select("node", "block", "seen", *[none.alias(k) for k in kinds])
    for p in parts:
        out = out.unionByName(p)
    out = out.groupBy("node", "block").agg(*[F.bit_or(k).alias(k) for k in ("seen", *kinds)])
    return out.select("node", "block", *kinds, F.col("seen").bitwiseAND(F.bitwise_not(F.col("own").bitwiseOR(F.col("direct")))).alias("far")), places


# -- walks inside a task ------------------------------------------------------


def array(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def starts(at: np.ndarray, nodes: int) -> np.ndarray:
    """Where each node's rows begin among rows in the order of nodes, and where the last one's end."""
    return np.searchsorted(at, np.arange(nodes + 1, dtype=at.dtype))


def rows_of(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each of the nodes has, and the places of all of them."""
    first = start[at]
    n = start[at + 1] - first
    return n, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def packed(steps: DataFrame, symbols: DataFrame | None) -> dict[str, np.ndarray]:
    """The graph as arrays: sorted nodes, what follows each of them by place, and the file and entry mark of each symbol by node."""
    found = steps.select("at", "next").toArrow()
    at, to = array(found["at"]), array(found["next"])
    ids, g = [np.unique(at), np.unique(to)], {}
    if symbols is not None:
        rows = symbols.where("symbol_id is not null").select("symbol_id", "file_id", F.coalesce("is_entry", F.lit(False)).alias("is_entry")).toArrow()
        own = array(rows["symbol_id"])
        ids.append(own)
    nodes = g["nodes"] = np.unique(np.concatenate(ids))
    at, to = (np.searchsorted(nodes, x).astype(np.int32) for x in (at, to))
    order = np.argsort(at)
    g["next"], g["start"] = to[order], starts(at[order], len(nodes))
    if symbols is not None:
        own = np.searchsorted(nodes, own).astype(np.int32)
        order = np.argsort(own)
        files = rows["file_id"].combine_chunks().dictionary_encode()
        g["file"] = files.indices.fill_null(-1).to_numpy(zero_copy_only=False)[order]  # -1: null, which is no file
        g["files"], g["is_entry"] = np.int64(len(files.dictionary)), array(rows["is_entry"])[order]
        g["symbol"] = starts(own[order], len(nodes))
    return g


def by_seeds(steps: DataFrame, seeds: DataFrame, symbols: DataFrame | None, what: Callable, columns: str) -> DataFrame:
    """seed and what(graph, places of up to SEEDS seeds) for all seeds. Each task walks the whole graph, which is broadcast, for its own seeds; steps are deleted."""
    spark = seeds.sparkSession
    graph = spark.sparkContext.broadcast(packed(steps, symbols))
    drop(steps)
    seeds = stored(seeds.select("seed").distinct(), "seeds")
    blocks = ceil(seeds.count() / SEEDS)
    tasks = max(1, min(blocks, max(4 * spark.sparkContext.defaultParallelism, blocks // SEEDS)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = graph.value
        for batch in batches:
            for i in range(0, len(batch), SEEDS):
                ids = batch.column(0).slice(i, SEEDS)
                values = array(pa.chunked_array([ids.drop_null()]))
                place = np.searchsorted(g["nodes"], values)
                known = place < len(g["nodes"])
                known[known] = g["nodes"][place[known]] == values[known]
                all_ = np.full(len(ids), -1)
                all_[np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))[known]] = place[known]
                keep, out = what(g, all_)
                yield pa.RecordBatch.from_arrays([ids.filter(pa.array(keep)), *[pa.array(x[keep]) for x in out]], names=names)

    schema = f"seed {seeds.schema['seed'].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in schema.split(", ")]
    out = stored(seeds.repartitionByRange(tasks, "seed").sortWithinPartitions("seed").mapInArrow(walk, schema), "by_seeds")
    graph.destroy()
    drop(seeds)
    return out


def levels(g: dict[str, np.ndarray], seeds: np.ndarray, max_depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, nodes, masks) level by level: in a node's mask stand the seeds whose shortest distance is this depth. A seed without a place (-1) reaches nothing."""
    start, to, seen = g["start"], g["next"], np.zeros(len(g["nodes"]), np.uint64)
    mask = np.left_shift(np.uint64(1), np.arange(len(seeds), dtype=np.uint64))[seeds >= 0]
    at = seeds[seeds >= 0]
    for d in count():
        if not len(at):
            return
        yield d, at, mask
        if d == max_depth:
            return
        seen[at] |= mask
        n, rows = rows_of(start, at)
        nodes, come = to[rows], np.repeat(mask, n)
        order = np.argsort(nodes)
        nodes, come = nodes[order], come[order]
        first = np.flatnonzero(np.diff(nodes, prepend=-1))
        at = nodes[first]
        mask = (np.bitwise_or.reduceat(come, first) if len(first) else come) & ~seen[at]
        at, mask = at[mask != 0], mask[mask != 0]


def counted(masks: np.ndarray, rows: int = 1 << 16) -> np.ndarray:
    """How many of the masks each of SEEDS bits is set in."""
    out = np.zeros(SEEDS, np.int64)
    for i in range(0, len(masks), rows):
        some = np.ascontiguousarray(masks[i : i + rows]).astype("<u8").view(np.uint8).reshape(-1, 8)
        out += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def farthest_of(g: dict[str, np.ndarray], seeds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For all seeds: the largest shortest distance."""
    far = np.zeros(SEEDS, np.int32)
    for d, _, mask in levels(g, seeds, None):
        far[counted(np.bitwise_or.reduce(mask, keepdims=True)) > 0] = d
    return np.ones(len(seeds), bool), [far[: len(seeds)]]


def impact_of(max_depth: int, with_target: bool) -> Callable:
    """For the seeds that reach a symbol: direct, transitive, entries, files."""

    def sums(g: dict[str, np.ndarray], seeds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        own, direct, far, entries = (np.zeros(SEEDS, np.int64) for _ in range(4))
        files = np.zeros(g["files"] + 1, np.uint64)  # the last one: no file
        for d, at, mask in levels(g, seeds, max_depth):
            if d == 0 and not with_target:
                continue
            n, rows = rows_of(g["symbol"], at)
            mask = np.repeat(mask, n)
            (own, direct, far)[min(d, 2)][:] += counted(mask)
            entries += counted(mask[g["is_entry"][rows]])
            np.bitwise_or.at(files, g["file"][rows], mask)
        k = len(seeds)
        return (own + direct + far)[:k] > 0, [x[:k] for x in (direct, far, entries, counted(files[:-1]))]

    return sums


def impact_sums(steps: DataFrame, symbols: DataFrame, seeds: DataFrame, max_depth: int, with_target: bool) -> DataFrame:
    """seed, direct, transitive, entries, files of who is reached within max_depth steps, for seeds that reach a symbol."""
    return by_seeds(steps, seeds, symbols, impact_of(max_depth, with_target), "direct long, transitive long, entries long, files long")


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """node, component (its smallest node) of the strongly connected components of edges (a, b) with two nodes or more.

    Few edges, which is checked, go through Tarjan's algorithm on the driver; more are coloured level by level.
    """
    e = edges.select("a", "b").where("a <> b").distinct()
    if e.limit(small + 1).count() <= small:
        found = tarjan([(r.a, r.b) for r in e.collect()])
        return edges.sparkSession.createDataFrame(found, f"node {edges.schema['a'].dataType.simpleString()}, component {edges.schema['a'].dataType.simpleString()}")
    return coloured(e)


def tarjan(edges: list[tuple]) -> list[tuple]:
    """(node, smallest node of its component) for components of two nodes or more, without recursion."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, stack, on, found = {}, {}, [], set(), []
    for root in sorted(out):
        work = [(root, iter(out[root]))] if root not in index else []
        while work:
            node, rest = work[-1]
            if node not in index:
                index[node] = low[node] = len(index)
                stack.append(node)
                on.add(node)
            for nxt in rest:
                if nxt not in index:
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    at = stack.index(node)
                    group, stack[at:] = stack[at:], []
                    on.difference_update(group)
                    if len(group) > 1:
                        found += [(x, min(group)) for x in group]
    return found


def coloured(edges: DataFrame) -> DataFrame:
    """Components by colouring: the largest ancestor colours a node, and who reaches the colour's root within it is its component."""
    left, found = cut(edges), None
    while True:
        while True:  # nodes without an edge in or out are in no cycle
            trimmed = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            if trimmed.count() == left.count():
                break
            left = trimmed
        if left.isEmpty():
            break
        colour = cut(left.select(F.col("a").alias("n")).union(left.select("b")).distinct().withColumn("c", F.col("n")))
        while True:
            into = left.join(colour.toDF("a", "ca"), "a").groupBy(F.col("b").alias("n")).agg(F.max("ca").alias("m"))
            new = cut(colour.join(into, "n", "left").select("n", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("moved")))
            colour = new.select("n", "c")
            if new.where("moved").isEmpty():
                break
        inside = left.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb")
        inside = cut(inside.select("a", "b", F.col("ca").alias("c")))
        member = front = cut(colour.where("n = c"))
        while not front.isEmpty():
            front = cut(front.toDF("b", "c").join(inside, ["b", "c"]).select(F.col("a").alias("n"), "c").distinct().join(member, ["n", "c"], "left_anti"))
            member = member.unionByName(front)
        member = cut(member)
        found = member if found is None else found.unionByName(member)
        left = cut(left.join(member.select(F.col("n").alias("a")), "a", "left_anti").join(member.select(F.col("n").alias("b")), "b", "left_anti").select("a", "b"))
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    groups = found.groupBy("c").agg(F.min("n").alias("component"), F.count("*").alias("k")).where("k > 1")
    return found.join(groups, "c").select(F.col("n").alias("node"), "component")
