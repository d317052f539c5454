"""Queries that walk the call graph, and roll-ups over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as D
from ..operators import graph as G
from ..operators import trace as T
from ..session import ranked
from ..sources import adapters as A
from .registry import ORACLE, QUERIES, query
from .symbol_queries import CROSS, NAME, ROWS, cross, rows

DEPTH = 10
IMPACT_DEPTH = 50  # of the graph view, whose callers go further up than those of the command line


def walk(a: str, b: str, seeds: str, depth: int) -> str:
    return f"""walk AS (SELECT symbol_id AS seed, symbol_id AS node, 0 AS d FROM symbols WHERE {seeds} UNION SELECT seed, {a}, d + 1 FROM walk JOIN edges ON {b} = node WHERE d < {depth}),
dist AS (SELECT seed, node, min(d)::INT AS depth FROM walk GROUP BY ALL)"""


BY_NAME = f"name = '{NAME}'"
UP, DOWN = (walk(*ab, BY_NAME, DEPTH) for ab in (("from_symbol", "to_symbol"), ("to_symbol", "from_symbol")))
#: Chains by the smallest predecessor of the level before.
CHAINS = """, pre AS (SELECT n.seed, n.node, n.depth, min(p.node) AS pred FROM dist n JOIN edges e ON e.{a} = n.node JOIN dist p ON p.seed = n.seed AND p.node = e.{b} AND p.depth = n.depth - 1 GROUP BY ALL),
chains AS (SELECT seed, node, 0 AS depth, node::VARCHAR AS chain FROM dist WHERE depth = 0 UNION ALL SELECT p.seed, p.node, p.depth, {join} FROM chains c JOIN pre p ON p.seed = c.seed AND p.pred = c.node AND p.depth = c.depth + 1)"""
UP_CHAINS = UP.replace(f"d < {DEPTH}", f"d < {DEPTH - 1}") + CHAINS.format(a="from_symbol", b="to_symbol", join="p.node || '>' || c.chain")
UP_FULL = UP + CHAINS.format(a="from_symbol", b="to_symbol", join="p.node || '>' || c.chain")
DOWN_FULL = DOWN + CHAINS.format(a="to_symbol", b="from_symbol", join="c.chain || '>' || p.node")
RISK = "CASE WHEN entries > 10 OR files > 50 THEN 'critical' WHEN entries > 5 OR files > 20 THEN 'high' WHEN direct > 5 OR files > 5 THEN 'medium' ELSE 'low' END AS risk"


def targets(spark, sf):
    return A.symbols(spark, sf).where(F.col("name") == NAME).select("symbol_id")


def chain(c="chain"):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ">")


def paths(spark, sf):
    return T.entry_paths(A.symbols(spark, sf), A.edges(spark, sf), targets(spark, sf), DEPTH)


@query("t1_paths", "SELECT seed AS target, node AS entry, depth FROM chains JOIN symbols ON symbol_id = node WHERE is_entry", UP_CHAINS)
def t1(spark, sf):
    return paths(spark, sf).select("target", "entry", "depth")


@query("t1_chain", "SELECT seed AS target, node AS entry, chain FROM chains JOIN symbols ON symbol_id = node WHERE is_entry", UP_CHAINS)
def t1c(spark, sf):
    return paths(spark, sf).select("target", "entry", chain().alias("chain"))


@query("t3_path_summary", "SELECT seed AS target, count(DISTINCT node) AS entries, min(depth) AS min_depth, max(depth) AS max_depth, count(*) FILTER (depth <= 1) AS direct FROM chains JOIN symbols ON symbol_id = node WHERE is_entry GROUP BY 1", UP_CHAINS)
def t3(spark, sf):
    return paths(spark, sf).groupBy("target").agg(F.count_distinct("entry").alias("entries"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"), F.count_if(F.size("chain") <= 2).alias("direct"))


@query("t4_trace_steps", "SELECT target, entry, step, name FROM (SELECT seed AS target, node AS entry, unnest(string_split(chain, '>'))::BIGINT AS s, generate_subscripts(string_split(chain, '>'), 1)::INT AS step FROM chains JOIN symbols ON symbol_id = node WHERE is_entry) JOIN symbols ON symbol_id = s", UP_CHAINS)
def t4(spark, sf):
    steps = paths(spark, sf).select("target", "entry", F.posexplode("chain").alias("i", "s"))
    return steps.join(A.symbols(spark, sf), F.col("s") == F.col("symbol_id")).select("target", "entry", (F.col("i") + 1).alias("step"), "name")


@query("t8_callers", "SELECT seed AS root, node AS terminal, depth, chain FROM chains WHERE depth > 0 AND node NOT IN (SELECT to_symbol FROM edges)", UP_FULL)
def t8(spark, sf):
    return T.terminal_paths(A.edges(spark, sf), targets(spark, sf), DEPTH, True).select("root", "terminal", "depth", chain().alias("chain"))


@query("t9_callees", "SELECT seed AS root, node AS terminal, depth, chain FROM chains WHERE depth > 0 AND node NOT IN (SELECT from_symbol FROM edges)", DOWN_FULL)
def t9(spark, sf):
    return T.terminal_paths(A.edges(spark, sf), targets(spark, sf), DEPTH, False).select("root", "terminal", "depth", chain().alias("chain"))


IMPACT = "SELECT *, {risk} FROM (SELECT seed AS symbol_id, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive, count(DISTINCT file_id) AS files, count(*) FILTER (is_entry) AS entries FROM dist JOIN symbols ON symbol_id = node {where} GROUP BY 1)"


@query("t10_impact", IMPACT.format(risk=RISK, where=""), UP)
def t10(spark, sf):
    return T.impact(A.symbols(spark, sf), A.edges(spark, sf), targets(spark, sf), DEPTH)


@query("w14_impact", IMPACT.format(risk=RISK, where="WHERE depth > 0"), walk("from_symbol", "to_symbol", BY_NAME, IMPACT_DEPTH))
def w14(spark, sf):
    return T.impact(A.symbols(spark, sf), A.edges.once(spark, sf), targets(spark, sf), IMPACT_DEPTH, False)


@query("t10_impact_names", """SELECT DISTINCT CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS what, CASE WHEN depth = 1 THEN name || ' (' || path || ':' || start_line || ')' ELSE name || ' (depth ' || depth || ')' END AS shown, depth
FROM (SELECT node, min(depth) AS depth FROM dist WHERE depth > 0 GROUP BY 1) JOIN symbols ON symbol_id = node JOIN files USING (file_id)""", UP)
def t10n(spark, sf):
    return T.impact_names(A.symbols(spark, sf), A.edges(spark, sf), A.files(spark, sf), f"src/any.rs:{NAME}", DEPTH)


@query("w9_callers_depth", "SELECT seed AS symbol_id, node AS caller, depth FROM dist WHERE depth > 0", UP)
def w9(spark, sf):
    r = G.reach(A.edges(spark, sf), targets(spark, sf).select(F.col("symbol_id").alias("seed")), DEPTH, backward=True)
    return r.where("depth > 0").select(F.col("seed").alias("symbol_id"), F.col("node").alias("caller"), "depth")


#: Shortest distances without a limit: a pair of seed and node is a key, and comes once.
FAR = """far(seed, node, depth) USING KEY (seed, node) AS (SELECT symbol_id, symbol_id, 0 FROM symbols WHERE is_entry
  UNION SELECT f.seed, e.to_symbol, min(f.depth) + 1 FROM far f JOIN edges e ON e.from_symbol = f.node WHERE NOT EXISTS (SELECT 1 FROM recurring.far r WHERE r.seed = f.seed AND r.node = e.to_symbol) GROUP BY 1, 2)"""


@query("w14_paths", "SELECT target, place, entry, depth, chain FROM (SELECT seed AS target, node AS entry, depth, chain, row_number() OVER (PARTITION BY seed ORDER BY depth, node)::INT AS place FROM chains JOIN symbols ON symbol_id = node WHERE is_entry) WHERE place <= 5", UP_CHAINS)
def w14p(spark, sf):
    return T.best_paths(A.symbols(spark, sf), A.edges(spark, sf), targets(spark, sf), DEPTH).withColumn("chain", chain())


@query("t17_depth", "SELECT coalesce(max(m), 0)::INT AS max_depth, round(coalesce(avg(m), 0), 4) AS avg_depth FROM (SELECT seed, max(depth) AS m FROM far GROUP BY 1)", FAR)
def t17(spark, sf):
    return T.call_depths(A.symbols(spark, sf), A.edges.once(spark, sf))


SCC = """clo AS (SELECT a, b FROM file_edges UNION SELECT clo.a, e.b FROM clo JOIN file_edges e ON clo.b = e.a),
scc AS (SELECT x.a AS node, min(least(x.a, x.b)) AS component FROM clo x JOIN clo y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY 1)"""
FIRST = "firsts AS (SELECT file_id, arg_min(name, symbol_id) AS shown FROM symbols GROUP BY 1)"


def scc(spark, sf):
    return G.components(A.file_edges(spark, sf))


@query("t12_scc", "SELECT node, component FROM scc", SCC)
def t12(spark, sf):
    return scc(spark, sf)


@query("w10_cycle_count", "SELECT count(DISTINCT component) AS cycles FROM scc", SCC)
def w10(spark, sf):
    return scc(spark, sf).agg(F.count_distinct("component").alias("cycles"))


@query("w11_cycle_files", "SELECT path FROM scc JOIN files ON file_id = node", SCC)
def w11(spark, sf):
    return scc(spark, sf).join(A.files(spark, sf), F.col("node") == F.col("file_id")).select("path")


@query("w15_cycles", """SELECT component, count(*) AS size, CASE WHEN count(*) > 5 THEN 'critical' WHEN count(*) > 3 THEN 'high' ELSE 'medium' END AS severity, string_agg(node::VARCHAR, ',' ORDER BY node) AS members, string_agg(shown, ',' ORDER BY node) AS display FROM scc JOIN firsts ON file_id = node GROUP BY 1""", f"{SCC}, {FIRST}")
def w15(spark, sf):
    return D.cycles_table(scc(spark, sf), A.symbols(spark, sf))


@query("c10_cycles_by_size", "SELECT component, n AS size, CASE WHEN n >= 6 THEN 'critical' WHEN n >= 4 THEN 'high' ELSE 'medium' END AS severity, row_number() OVER (ORDER BY n DESC, component)::INT AS rank FROM (SELECT component, count(*) AS n FROM scc GROUP BY 1)", SCC)
def c10(spark, sf):
    n = scc(spark, sf).groupBy("component").agg(F.count("*").alias("size")).withColumn("severity", D.severity(F.col("size")))
    return ranked(n, "rank", F.desc("size"), "component")


@query("c10_cycles_by_name", "SELECT component, shown FROM (SELECT component, arg_min(shown, node) AS shown FROM scc JOIN firsts ON file_id = node GROUP BY 1) ORDER BY lower(shown), component LIMIT 5", f"{SCC}, {FIRST}")
def c10a(spark, sf):
    t = D.ordered_cycles(D.cycles_table(scc(spark, sf), A.symbols(spark, sf)), "alpha").limit(5)
    return t.select("component", F.substring_index("display", ",", 1).alias("shown"))


@query("t12_cycle_paths", """SELECT seed AS component, chain || '>' || seed AS chain FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS rn FROM chains JOIN edges2 ON a = node AND b = seed) WHERE rn = 1""",
       SCC + """, edges2 AS (SELECT e.a, e.b, x.component AS c FROM file_edges e JOIN scc x ON x.node = e.a JOIN scc y ON y.node = e.b AND y.component = x.component),
walk AS (SELECT DISTINCT component AS seed, component AS node, 0 AS d FROM scc UNION SELECT seed, b, d + 1 FROM walk JOIN edges2 ON a = node AND c = seed WHERE d < 100), dist AS (SELECT seed, node, min(d) AS depth FROM walk GROUP BY ALL),
pre AS (SELECT n.seed, n.node, n.depth, min(p.node) AS pred FROM dist n JOIN edges2 e ON e.b = n.node JOIN dist p ON p.seed = n.seed AND p.node = e.a AND p.depth = n.depth - 1 GROUP BY ALL),
chains AS (SELECT seed, node, 0 AS depth, node::VARCHAR AS chain FROM dist WHERE depth = 0 UNION ALL SELECT p.seed, p.node, p.depth, c.chain || '>' || p.node FROM chains c JOIN pre p ON p.seed = c.seed AND p.pred = c.node AND p.depth = c.depth + 1)""")
def t12p(spark, sf):
    return T.cycle_paths(A.file_edges(spark, sf), scc(spark, sf)).select("component", chain().alias("chain"))


@query("c2_cycle_state", "SELECT symbol_id FROM rows WHERE file_id IN (SELECT node FROM scc) AND contains(lower(name), 'red')", f"{ROWS}, {SCC}")
def c2c(spark, sf):
    return D.matching(D.with_cycles(rows(spark, sf), scc(spark, sf)), "red state:cycle").select("symbol_id")


NODES = f"""{ROWS}, {CROSS}, {SCC}, nodes AS (SELECT r.file_id, path, count(*) AS symbols, count(*) FILTER (dead) AS dead, count(*) FILTER (is_entry) AS exports, coalesce(any_value(i.n), 0) AS imports, r.file_id IN (SELECT node FROM scc) AS in_cycle
 FROM rows r LEFT JOIN (SELECT from_file, count(*) AS n FROM cross_edges GROUP BY 1) i ON i.from_file = r.file_id GROUP BY r.file_id, path ORDER BY symbols DESC, r.file_id LIMIT 100)"""


def nodes(spark, sf):
    return D.file_nodes(rows(spark, sf), cross(spark, sf), scc(spark, sf))


@query("w3_nodes", "SELECT * FROM nodes", NODES)
def w3(spark, sf):
    return nodes(spark, sf)


@query("w1_stats", """SELECT (SELECT count(*) FROM files) AS files, count(*) AS symbols, count(*) FILTER (dead) AS dead, (SELECT count(DISTINCT component) FROM scc) AS cycles, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'method') AS methods,
 count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'variable') AS variables, count(*) FILTER (kind = 'interface') AS interfaces, count(*) FILTER (kind = 'type_alias') AS types FROM rows""", f"{ROWS}, {SCC}")
def w1(spark, sf):
    kinds = (("function", "functions"), ("method", "methods"), ("class", "classes"), ("variable", "variables"), ("interface", "interfaces"), ("type_alias", "types"))
    r = rows(spark, sf).agg(F.count("*").alias("symbols"), F.count_if("dead").alias("dead"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in kinds])
    one = scc(spark, sf).agg(F.count_distinct("component").alias("cycles"))
    return r.join(F.broadcast(A.files(spark, sf).agg(F.count("*").alias("files")))).join(F.broadcast(one))


@query("w3_dead_nodes", "SELECT r.file_id, count(*) FILTER (dead) AS dead FROM rows r GROUP BY 1 HAVING count(*) FILTER (dead) > 0 ORDER BY count(*) DESC, r.file_id LIMIT 100", ROWS)
def w3d(spark, sf):
    return D.file_nodes(rows(spark, sf), cross(spark, sf), scc(spark, sf), state="dead").select("file_id", "dead")


@query("w3_edges", "SELECT from_file, to_file, count(*) AS weight FROM cross_edges WHERE from_file IN (SELECT file_id FROM nodes) AND to_file IN (SELECT file_id FROM nodes) GROUP BY ALL", NODES)
def w3e(spark, sf):
    return D.file_links(cross(spark, sf), nodes(spark, sf))


@query("c14_matrix", """SELECT a, b, count(*) AS w FROM (SELECT from_file AS a, to_file AS b FROM kept UNION ALL SELECT to_file, from_file FROM kept) GROUP BY ALL""",
       f"{NODES}, first AS (SELECT file_id FROM nodes ORDER BY symbols DESC, file_id LIMIT 40), kept AS (SELECT * FROM cross_edges WHERE from_file IN (SELECT file_id FROM first) AND to_file IN (SELECT file_id FROM first))")
def c14(spark, sf):
    return D.matrix(cross(spark, sf), nodes(spark, sf))


TREE = f"""{ROWS}, {SCC}, per AS (SELECT file_id, path, count(*) AS value, count(*) FILTER (dead) AS dead, file_id IN (SELECT node FROM scc) AS in_cycle FROM rows GROUP BY ALL),
tree AS (SELECT p AS path, len(string_split(p, '/'))::INT AS depth, sum(value)::BIGINT AS value, sum(dead)::BIGINT AS dead, count(*) AS files, bool_or(in_cycle) AS in_cycle, floor(100 * (sum(value) - sum(dead)) / sum(value))::BIGINT AS health
 FROM (SELECT *, array_to_string(string_split(path, '/')[1:n], '/') AS p FROM (SELECT *, unnest(range(1, len(string_split(path, '/')) + 1)) AS n FROM per)) GROUP BY 1)"""


@query("w4_rollup", "SELECT * FROM tree", TREE)
def w4(spark, sf):
    return D.rollup(rows(spark, sf), scc(spark, sf))


@query("w4_base", "SELECT * FROM (SELECT path, depth, value, dead, files, in_cycle, health FROM tree) WHERE starts_with(path, 'src/core/a/')", TREE)
def w4b(spark, sf):
    return D.rollup(rows(spark, sf), scc(spark, sf), "src/core/a").where(F.col("path").startswith("src/core/a/"))


@query("w5_totals", "SELECT count(DISTINCT file_id) AS files, count(*) AS symbols, count(*) FILTER (dead) AS dead, count(DISTINCT file_id) FILTER (file_id IN (SELECT node FROM scc)) AS cycle_files, floor(100 * count(*) FILTER (NOT dead) / count(*))::BIGINT AS health FROM rows", f"{ROWS}, {SCC}")
def w5(spark, sf):
    return D.totals(rows(spark, sf), scc(spark, sf))


@query("w8_symbol", "SELECT symbol_id, name, path, refs, callers, callees, dead, is_entry, file_id IN (SELECT node FROM scc) AS in_cycle FROM rows WHERE symbol_id IN (77, 3, 10)", f"{ROWS}, {SCC}")
def w8(spark, sf):
    return D.with_cycles(rows(spark, sf).where(F.col("symbol_id").isin(77, 3, 10)), scc(spark, sf)).select("symbol_id", "name", "path", "refs", "callers", "callees", "dead", "is_entry", "in_cycle")


@query("w6_tree", "SELECT path, depth, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY depth = 4, lower(path))::INT AS place FROM tree", TREE)
def w6(spark, sf):
    from pyspark.sql.window import Window

    t = D.rollup(rows(spark, sf), scc(spark, sf))
    w = Window.partitionBy(F.regexp_replace("path", "/?[^/]*$", "")).orderBy(F.col("depth") == 4, F.lower("path"))
    return t.select("path", "depth", F.row_number().over(w).alias("place"))


@query("c7_files", "SELECT path, count(*) AS symbols, sum(refs)::BIGINT AS refs_in, sum(callees)::BIGINT AS refs_out, count(*) FILTER (is_entry) AS entries, count(*) FILTER (dead) AS dead, count(*) FILTER (file_id IN (SELECT node FROM scc)) AS in_cycle FROM rows GROUP BY 1", f"{ROWS}, {SCC}")
def c7(spark, sf):
    return D.files_table(rows(spark, sf), scc(spark, sf))


@query("c16_hierarchy", "SELECT path, value FROM tree WHERE depth <= 3", TREE)
def c16(spark, sf):
    return D.rollup(rows(spark, sf), scc(spark, sf)).where("depth <= 3").select("path", "value")


@query("c21_cycles_of_symbol", "SELECT symbol_id, component FROM symbols JOIN scc ON node = file_id WHERE name = '" + NAME + "'", SCC)
def c21(spark, sf):
    return A.symbols(spark, sf).where(F.col("name") == NAME).join(scc(spark, sf), F.col("file_id") == F.col("node")).select("symbol_id", "component")


@query("t22_summary", "SELECT (SELECT count(*) FROM symbols WHERE " + BY_NAME + ") || ' symbols, ' || count(*) || ' paths, ' || count(DISTINCT node) || ' entry points' AS summary FROM chains JOIN symbols ON symbol_id = node WHERE is_entry", UP_CHAINS)
def t22(spark, sf):
    n = targets(spark, sf).agg(F.count("*").alias("s"))
    p = paths(spark, sf).agg(F.count("*").alias("p"), F.count_distinct("entry").alias("e"))
    return n.join(F.broadcast(p)).select(F.format_string("%d symbols, %d paths, %d entry points", "s", "p", "e").alias("summary"))


@query("t24_path_text", "SELECT target, entry, string_agg(name, ' -> ' ORDER BY step) AS shown FROM (SELECT seed AS target, node AS entry, unnest(string_split(chain, '>'))::BIGINT AS s, generate_subscripts(string_split(chain, '>'), 1)::INT AS step FROM chains JOIN symbols ON symbol_id = node WHERE is_entry) JOIN symbols ON symbol_id = s GROUP BY ALL", UP_CHAINS)
def t24(spark, sf):
    from ..operators import export as O

    steps = t4(spark, sf).groupBy("target", "entry").agg(F.array_sort(F.collect_list(F.struct("step", "name"))).alias("xs"))
    return steps.select("target", "entry", O.chain_text(F.transform("xs", lambda x: x["name"])).alias("shown"))


#: The analyses of one name or of the whole, and the queries that give their rows.
ANALYSES = {"trace": "t1_paths", "refs": "t5_refs", "callers": "t8_callers", "callees": "t9_callees", "writes": "t6_writes", "type": "t6_types", "impact": "t10_impact", "dead": "t18_dead", "flow": "t13_flow", "module": "t11_exports", "cycles": "w15_cycles", "scope": "t15_scope", "stats": "t16_kinds"}


@query("t22_counts", "\nUNION ALL\n".join(f"SELECT '{name}' AS operation, count(*) AS n FROM ({ORACLE[q]})" for name, q in ANALYSES.items()))
def t22c(spark, sf):
    """The number of rows that each analysis has."""
    parts = [QUERIES[q](spark, sf).agg(F.lit(name).alias("operation"), F.count("*").alias("n")) for name, q in ANALYSES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
