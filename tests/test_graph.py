"""Literal graphs: paths, dead code, components, enclosing symbols, updates."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import extract, graph, incremental, resolve, trace
from lodegraph.plans import registry
from lodegraph.plans.symbol_queries import NAME
from lodegraph.sources import adapters

SYMBOLS = "symbol_id long, name string, file_id long, kind string, is_entry boolean, is_exported boolean, start_line int, end_line int"


def symbols(spark, rows):
    return spark.createDataFrame([(i, n, 1, "function", e, False, 10 * i + 1, 10 * i + 9) for i, n, e in rows], SYMBOLS)


def edges(spark, rows):
    return spark.createDataFrame(rows, "from_symbol long, to_symbol long, line int")


def test_chain(spark):
    s = symbols(spark, [(0, "main", True), (1, "a", False), (2, "b", False), (3, "target", False)])
    e = edges(spark, [(0, 1, 5), (1, 2, 15), (2, 3, 25)])
    got = {(r.target, r.depth): list(r.chain) for r in trace.entry_paths(s, e, s.where("symbol_id > 0").select("symbol_id")).collect()}
    assert got == {(1, 1): [0, 1], (2, 2): [0, 1, 2], (3, 3): [0, 1, 2, 3]}
    assert trace.entry_paths(s, e, s.where("symbol_id = 3").select("symbol_id"), max_depth=3).count() == 0
    assert trace.entry_paths(s, e, s.where("symbol_id = 99").select("symbol_id")).count() == 0


def distances(pairs, seed):
    """Node to its shortest distance from the seed, however far."""
    out, front = {seed: 0}, [seed]
    while front:
        front = list(dict.fromkeys(b for a in front for b in pairs.get(a, ()) if b not in out))
        out |= dict.fromkeys(front, out[max(out, key=out.get)] + 1)
    return out


def neighbours(rows):
    out = {}
    for a, b in rows:
        out.setdefault(a, set()).add(b)
    return out


def test_depth_has_no_limit(spark):
    s = symbols(spark, [(i, f"f{i}", i in (0, 50)) for i in range(60)])
    e = edges(spark, [(i, i + 1, 1) for i in range(59)] + [(59, 40, 1)])
    assert [tuple(r) for r in trace.call_depths(s, e).collect()] == [(59, 39.0)]


def test_depth_query_walks_all(spark):
    sf = "/root/testdata/sf0.01"
    calls = neighbours((r.from_symbol, r.to_symbol) for r in adapters.edges(spark, sf).collect())
    far = [max(distances(calls, r.symbol_id).values()) for r in adapters.symbols(spark, sf).where("is_entry").collect()]
    got = registry.queries()["t17_depth"](spark, sf).first()
    assert max(far) > 10 and (got.max_depth, got.avg_depth) == (max(far), round(sum(far) / len(far), 4))


def test_impact_query_walks_fifty_steps(spark):
    sf = "/root/testdata/sf0.01"
    callers = neighbours((r.to_symbol, r.from_symbol) for r in adapters.edges(spark, sf).collect())
    of = {r.symbol_id: r for r in adapters.symbols(spark, sf).collect()}
    want, far = {}, 0
    for t in (i for i, r in of.items() if r.name == NAME):
        found = {n: d for n, d in distances(callers, t).items() if 0 < d <= 50 and n in of}
        far = max([far, *found.values()])
        if found:
            direct = sum(d == 1 for d in found.values())
            want[t] = (direct, len(found) - direct, len({of[n].file_id for n in found}), sum(of[n].is_entry for n in found))
    got = {r.symbol_id: (r.direct, r.transitive, r.files, r.entries) for r in registry.queries()["w14_impact"](spark, sf).collect()}
    assert far > 10 and got == want


def test_dead(spark):
    s = symbols(spark, [(0, "main", True), (1, "used", False), (2, "dead", False)])
    none = spark.createDataFrame([], "token_id long, symbol_id long, kind string")
    assert [r.symbol_id for r in trace.dead(s, edges(spark, [(0, 1, 5)]), none).collect()] == [2]


def closure(pairs):
    reach = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for _ in reach:
        for a in reach:
            reach[a] |= {c for b in list(reach[a]) for c in reach.get(b, ())}
    out = {}
    for a in reach:
        own = {b for b in reach[a] if a in reach.get(b, ())} | {a}
        if len(own) > 1:
            out[a] = min(own)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_both_ways(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(20)})
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = closure(pairs)
    assert dict(graph.tarjan(pairs)) == want
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    assert {r.node: r.component for r in graph.coloured(df).collect()} == want


def test_components_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert graph.components(empty).count() == 0
    assert graph.coloured(empty).count() == 0


def test_enclosing_against_plain_loops(spark):
    rng = random.Random(5)
    sym = [(i, f"s{i}", rng.randrange(2), "function", False, False, (a := rng.randrange(1, 3000)), a + rng.choice([3, 70, 2500])) for i in range(60)]
    at = [(i, rng.randrange(2), rng.randrange(1, 3000)) for i in range(200)]
    got = {r.token_id: r.symbol_id for r in resolve.enclosing(spark.createDataFrame(at, "token_id long, file_id long, line int"), spark.createDataFrame(sym, SYMBOLS)).collect()}
    want = {}
    for i, f, line in at:
        hits = [(s[7] - s[6], s[0]) for s in sym if s[2] == f and s[6] <= line <= s[7]]
        if hits:
            want[i] = min(hits)[1]
    assert got == want


FILES = "file_id long, path string, language string, content string"


def test_update_equals_rebuild(spark):
    a = (1, "a.js", "javascript", "function foo() {\n  bar();\n}\n")
    b = (2, "b.js", "javascript", "function bar() {\n  return new Thing(foo());\n}\nfunction baz() { foo(); }\n")
    a2 = (1, "a.js", "javascript", "function qux() {\n  bar();\n  baz();\n}\n")
    c = (3, "c.js", "javascript", "class Thing {\n}\nfunction foo() { qux(); }\n")
    index = extract.build(spark.createDataFrame([a, b], FILES))
    got = incremental.update_graph(index, spark.createDataFrame([a2, c], FILES), spark.createDataFrame([], "file_id long"))
    want = extract.build(spark.createDataFrame([a2, b, c], FILES))
    for k in ("symbols", "tokens", "refs", "edges"):
        cols = sorted(want[k].columns)
        assert sorted(map(tuple, got[k].select(cols).collect())) == sorted(map(tuple, want[k].select(cols).collect())), k
    less = incremental.update_graph(want, spark.createDataFrame([], FILES), spark.createDataFrame([(3,)], "file_id long"))
    assert sorted(r.name for r in less["symbols"].collect()) == ["bar", "baz", "qux"]
    assert sorted((r.from_symbol, r.to_symbol) for r in less["edges"].collect()) == sorted((r.from_symbol, r.to_symbol) for r in extract.build(spark.createDataFrame([a2, b], FILES))["edges"].collect())


def test_constructions_are_counted_before_names_meet_symbols(spark, sf):
    s = spark.createDataFrame([(i, n, 1, "class", False, False, 1, 9) for i, n in ((1, "A"), (2, "A"), (3, "B"), (4, "C"))], SYMBOLS)
    t = spark.createDataFrame([(1, "A", "type"), (2, "A", "type"), (3, "B", "type"), (4, "C", "call"), (5, None, "type")], "token_id long, name string, kind string")
    assert sorted(map(tuple, resolve.construction_ref_counts(t, s).collect())) == [(1, 2), (2, 2), (3, 1)]
    plan = registry.queries()["b7_construction_refs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [name" in plan[plan.index("Join") :]


def many_seeds(spark):
    """A random graph, 150 of its symbols as seeds (more than a block holds), and what they call."""
    rng = random.Random(8)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(260)]
    s = symbols(spark, [(i, f"f{i}", i % 4 != 0) for i in range(200)])
    e = edges(spark, [(a, b, 1) for a, b in pairs + pairs[:20]] + [(None, 3, 1), (3, None, 1)])
    return s, e, neighbours(pairs)


def test_farthest_of_many_seeds(spark):
    s, e, calls = many_seeds(spark)
    seeds = s.where("is_entry").select(F.col("symbol_id").alias("seed"))
    got = {r.seed: r.depth for r in graph.farthest(e, seeds).collect()}
    assert got == {i: max(distances(calls, i).values()) for i in range(200) if i % 4}
    *_, (_, last) = graph.spread(e, graph.numbered(seeds), None)
    pairs = sum(len(distances(calls, i)) for i in got)
    assert last.count() < pairs / 10, "a row stands for a block of seeds, not for a pair"


@pytest.mark.parametrize("with_target", [True, False])
def test_impact_of_many_seeds(spark, with_target):
    s, e, calls = many_seeds(spark)
    callers = neighbours((b, a) for a, bs in calls.items() for b in bs)
    got = {r.symbol_id: (r.direct, r.transitive, r.files, r.entries) for r in trace.impact(s, e, s.where("is_entry"), 4, with_target).collect()}
    want = {}
    for i in (i for i in range(200) if i % 4):
        found = {n: d for n, d in distances(callers, i).items() if (0 if with_target else 1) <= d <= 4}
        if found:
            want[i] = (sum(d == 1 for d in found.values()), sum(d > 1 for d in found.values()), 1, sum(n % 4 != 0 for n in found))
    assert got == want
    rows, _ = graph.surroundings(e, s.where("is_entry").select(F.col("symbol_id").alias("seed")), 4, True)
    assert set(rows.columns) == {"node", "block", "own", "direct", "far"}, "masks of seeds, no chains"


def test_resolve_writes_no_tokens(spark, sf):
    """Call edges need neither token ids nor other tokens, so the query reads the tables as they are."""
    df = registry.queries()["b4_resolve"](spark, sf)
    assert {f.rsplit("/", 1)[0].removeprefix("file://") for f in df.inputFiles()} == {sf}
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()


def jobs_of(spark, make):
    """What make() gives, and how many jobs it took."""
    sc = spark.sparkContext
    before = set(sc.statusTracker().getJobIdsForGroup("walk"))
    sc.setJobGroup("walk", "walk")
    try:
        return make(), len(set(sc.statusTracker().getJobIdsForGroup("walk")) - before)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def long_chain(spark):
    """150 symbols in a row, the last of which calls the hundredth."""
    return symbols(spark, [(i, f"f{i}", i in (0, 50)) for i in range(150)]), edges(spark, [(i, i + 1, 1) for i in range(149)] + [(149, 100, 1)])


def test_depth_takes_no_job_for_a_level(spark):
    s, e = long_chain(spark)
    got, jobs = jobs_of(spark, lambda: [tuple(r) for r in trace.call_depths(s, e).collect()])
    assert got == [(149, 124.0)] and jobs < 40


@pytest.mark.parametrize("local", [0, graph.LOCAL])
def test_farthest_both_ways(spark, local):
    s, e, calls = many_seeds(spark)
    seeds = s.where("is_entry").select(F.col("symbol_id").alias("seed")).unionByName(spark.createDataFrame([(900,), (None,), (1,)], "seed long"))
    got = sorted((str(r.seed), r.depth) for r in graph.farthest(e, seeds, local=local).collect())
    assert got == sorted([(str(i), max(distances(calls, i).values())) for i in range(200) if i % 4] + [("900", 0), ("None", 0)])
    none = edges(spark, [])
    assert {r.depth for r in graph.farthest(none, seeds, local=local).collect()} == {0}
    assert graph.farthest(e, seeds.limit(0), local=local).count() == 0


def test_impact_takes_no_job_for_a_level(spark):
    s, e = long_chain(spark)
    got, jobs = jobs_of(spark, lambda: [tuple(r) for r in trace.impact(s, e, s.where("symbol_id = 149"), 120, False).collect()])
    assert got == [(149, 1, 119, 1, 1, "low")] and jobs < 40


@pytest.mark.parametrize("with_target", [True, False])
def test_impact_both_ways_with_odd_symbols(spark, with_target):
    """Symbols of no file, without an entry mark, twice in the table, or without an edge; callers and targets that are no symbols."""
    rng = random.Random(9)
    rows = [(i, f"f{i}", rng.choice([None, 1, 2, 3]), "function", rng.choice([None, True, False]), False, 1, 9) for i in [*range(100), *range(0, 100, 7), 500]]
    s = spark.createDataFrame([*rows, (None, "none", 1, "function", True, False, 1, 9)], SYMBOLS)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(160)]
    seeds = [*range(90), 110, 500, 900]
    want = {}
    for t in seeds:
        found = [(d, r) for n, d in distances(neighbours((b, a) for a, b in pairs), t).items() if (0 if with_target else 1) <= d <= 4 for r in rows if r[0] == n]
        if found:
            want[t] = (sum(d == 1 for d, _ in found), sum(d > 1 for d, _ in found), len({r[2] for _, r in found} - {None}), sum(bool(r[4]) for _, r in found))
    targets = spark.createDataFrame([(t,) for t in [*seeds, *seeds[:3]]], "symbol_id long")
    for local in (0, graph.LOCAL):
        got = {r.symbol_id: (r.direct, r.transitive, r.files, r.entries) for r in trace.impact(s, edges(spark, [(a, b, 1) for a, b in pairs]), targets, 4, with_target, local).collect()}
        assert got == want, local


def called(spark):
    """Symbols of two names, over several tiles, one without a name; calls in them, some twice on a line, one of an unknown name, one outside."""
    s = spark.createDataFrame([(i, "hot" if i % 3 else "warm" if i else None, 1, "function", False, False, 10 * i + 1, 10 * i + 9) for i in range(2000)], SYMBOLS)
    t = [(10 * i + 5, "hot") for i in range(1000)] + [(10 * i + 5, "warm") for i in range(0, 1000, 50)] * 2 + [(25, "none"), (25, None), (10, "hot")]
    return s, spark.createDataFrame([(k, n, 1, line, 1, "call") for k, (line, n) in enumerate(t)], "token_id long, name string, file_id long, line int, col int, kind string")


def test_call_edge_table_equals_counts(spark):
    s, t = called(spark)
    got = resolve.call_edge_table(t, s)
    want = resolve.call_edge_counts(t, s)
    assert got.dtypes == want.dtypes and got.count() == want.count() > 3 * resolve.TILE
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert {(r.to_symbol, r.n) for r in got.where("from_symbol = 50 and to_symbol % 3 = 0").collect()} == {(i, 2) for i in range(3, 2000, 3)}
    assert resolve.call_edge_table(t.limit(0), s).count() == resolve.call_edge_table(t, s.limit(0)).count() == 0


def test_resolve_query_writes_small_files(spark, tmp_path, monkeypatch):
    s, t = called(spark)
    monkeypatch.setattr(adapters, "symbols", lambda *_: s)
    monkeypatch.setattr(adapters.tokens, "plan", lambda *_: t)
    registry.queries()["b4_resolve"](spark, "").write.parquet(str(tmp_path / "out"))
    size, rows = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")), spark.read.parquet(str(tmp_path / "out")).count()
    assert rows > 1_000_000 and size / rows < 0.4
