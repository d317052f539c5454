"""Queries over symbols, tokens, references and call edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard as D
from ..operators import resolve as R
from ..operators import trace as T
from ..sources import adapters as A
from .registry import query

NAME = "blue bolt"
SIMPLE = "CASE WHEN {k} IN ('call', 'construction') THEN 'call' WHEN {k} IN ('write', 'type_annotation', 'import', 'export') THEN {k} ELSE 'read' END"
REFS = f"""ids AS (SELECT symbol_id FROM symbols WHERE name = '{NAME}'),
known AS (SELECT token_id, file_id, line, col, {SIMPLE.format(k='rk')} AS kind FROM (SELECT token_id, min(kind) AS rk FROM refs WHERE symbol_id IN (SELECT symbol_id FROM ids) GROUP BY 1) JOIN tokens USING (token_id)),
found AS (SELECT * FROM known UNION ALL SELECT token_id, file_id, line, col, CASE WHEN kind = 'call' THEN 'call' ELSE 'read' END FROM tokens t WHERE name = '{NAME}' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.file_id = t.file_id AND k.line = t.line AND k.col = t.col))"""
DEAD = "dead AS (SELECT * FROM symbols WHERE NOT is_entry AND symbol_id NOT IN (SELECT to_symbol FROM edges) AND symbol_id NOT IN (SELECT symbol_id FROM refs))"
ROWS = DEAD + """, rows AS (SELECT s.*, path, coalesce(r.n, 0) AS refs, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, d.symbol_id IS NOT NULL AS dead FROM symbols s JOIN files USING (file_id)
  LEFT JOIN (SELECT symbol_id, count(*) AS n FROM refs GROUP BY 1) r USING (symbol_id) LEFT JOIN (SELECT to_symbol AS symbol_id, count(*) AS n FROM edges GROUP BY 1) i USING (symbol_id)
  LEFT JOIN (SELECT from_symbol AS symbol_id, count(*) AS n FROM edges GROUP BY 1) o USING (symbol_id) LEFT JOIN dead d USING (symbol_id))"""
ENCLOSING = "enc AS (SELECT token_id, symbol_id, name FROM (SELECT t.token_id, s.symbol_id, s.name, row_number() OVER (PARTITION BY t.token_id ORDER BY s.end_line - s.start_line, s.symbol_id) AS rn FROM tokens t JOIN symbols s ON s.file_id = t.file_id AND t.line BETWEEN s.start_line AND s.end_line) WHERE rn = 1)"


def rows(spark, sf):
    return D.symbol_rows(A.symbols(spark, sf), A.edges(spark, sf), A.refs(spark, sf), A.files(spark, sf))


def cross(spark, sf):
    return D.cross_edges(A.symbols(spark, sf), A.edges(spark, sf))


CROSS = "cross_edges AS (SELECT a.file_id AS from_file, b.file_id AS to_file FROM edges JOIN symbols a ON a.symbol_id = from_symbol JOIN symbols b ON b.symbol_id = to_symbol WHERE a.file_id <> b.file_id)"


@query("l1_by_name", f"SELECT symbol_id, name FROM symbols WHERE name = '{NAME}'")
def l1(spark, sf):
    return A.symbols(spark, sf).where(F.col("name") == NAME).select("symbol_id", "name")


@query("l2_substring", "SELECT symbol_id, name FROM symbols WHERE contains(lower(name), 'olt')")
def l2(spark, sf):
    return A.symbols(spark, sf).where(F.lower("name").contains("olt")).select("symbol_id", "name")


@query("l3_tokens_by_name", f"SELECT token_id FROM tokens WHERE name = '{NAME}'")
def l3(spark, sf):
    return A.tokens(spark, sf).where(F.col("name") == NAME).select("token_id")


@query("l4_token_substring", "SELECT token_id FROM tokens WHERE contains(lower(name), 'red')")
def l4(spark, sf):
    return A.tokens(spark, sf).where(F.lower("name").contains("red")).select("token_id")


@query("l5_by_id", "SELECT s.symbol_id, s.name, f.path FROM symbols s JOIN files f USING (file_id) WHERE symbol_id IN (3, 77)")
def l5(spark, sf):
    return A.symbols(spark, sf).where(F.col("symbol_id").isin(3, 77)).join(A.files(spark, sf), "file_id").select("symbol_id", "name", "path")


@query("l7_callers", "SELECT to_symbol AS symbol_id, count(*) AS n_sites, count(DISTINCT from_symbol) AS n_distinct FROM edges GROUP BY 1")
def l7(spark, sf):
    return A.edges(spark, sf).groupBy(F.col("to_symbol").alias("symbol_id")).agg(F.count("*").alias("n_sites"), F.count_distinct("from_symbol").alias("n_distinct"))


@query("l8_callees", "SELECT from_symbol AS symbol_id, count(*) AS n_sites, count(DISTINCT to_symbol) AS n_distinct FROM edges GROUP BY 1")
def l8(spark, sf):
    return A.edges(spark, sf).groupBy(F.col("from_symbol").alias("symbol_id")).agg(F.count("*").alias("n_sites"), F.count_distinct("to_symbol").alias("n_distinct"))


@query("l9_references", "SELECT symbol_id, token_id, file_id, line FROM refs JOIN tokens USING (token_id)")
def l9(spark, sf):
    return A.refs(spark, sf).join(A.tokens(spark, sf), "token_id").select("symbol_id", "token_id", "file_id", "line")


@query("l10_call_references", "SELECT symbol_id, count(*) AS n FROM refs WHERE kind = 'call' GROUP BY 1")
def l10(spark, sf):
    return A.refs(spark, sf).where("kind = 'call'").groupBy("symbol_id").agg(F.count("*").alias("n"))


@query("l11_entry_points", "SELECT symbol_id FROM symbols WHERE is_entry")
def l11(spark, sf):
    return A.symbols(spark, sf).where("is_entry").select("symbol_id")


@query("l12_in_file", "SELECT 'symbol' AS what, symbol_id AS id FROM symbols WHERE file_id = 5 UNION ALL SELECT 'token', token_id FROM tokens WHERE file_id = 5")
def l12(spark, sf):
    s = A.symbols(spark, sf).where("file_id = 5").select(F.lit("symbol").alias("what"), F.col("symbol_id").alias("id"))
    return s.unionByName(A.tokens(spark, sf).where("file_id = 5").select(F.lit("token").alias("what"), F.col("token_id").alias("id")))


@query("l13_refs_in_context", f"SELECT token_id, r.symbol_id, t.line, t.col, e.name AS scope FROM refs r JOIN tokens t USING (token_id) LEFT JOIN enc e USING (token_id)", ENCLOSING)
def l13(spark, sf):
    t = A.refs(spark, sf).select("token_id", "symbol_id").join(A.tokens(spark, sf), "token_id")
    e = R.enclosing(t.select("token_id", "file_id", "line"), A.symbols(spark, sf)).select("token_id", F.col("name").alias("scope"))
    return t.join(e, "token_id", "left").select("token_id", "symbol_id", "line", "col", "scope")


@query("l14_refs_of_kind", "SELECT kind, count(*) AS n, count(DISTINCT symbol_id) AS symbols FROM refs GROUP BY 1")
def l14(spark, sf):
    return A.refs(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("symbol_id").alias("symbols"))


@query("b3_entry_rule", "SELECT symbol_id FROM symbols JOIN files USING (file_id) WHERE kind IN ('function', 'method') AND (is_exported OR contains(path, '_9') )")
def b3(spark, sf):
    s = A.symbols(spark, sf).join(A.files(spark, sf), "file_id").withColumn("path", F.replace("path", F.lit("_9"), F.lit("_test9")))
    return s.where(R.is_entry(F.col("kind"), F.col("name"), F.col("path"), F.col("is_exported"))).select("symbol_id")


@query("b4_resolve", "SELECT e.symbol_id AS from_symbol, s.symbol_id AS to_symbol, t.line, count(*) AS n FROM tokens t JOIN symbols s ON s.name = t.name JOIN enc e USING (token_id) WHERE t.kind = 'call' AND e.symbol_id <> s.symbol_id GROUP BY ALL", ENCLOSING)
def b4(spark, sf):
    return R.call_edge_table(A.tokens.plan(spark, sf), A.symbols(spark, sf))


@query("b5_call_refs", "SELECT s.symbol_id, count(*) AS n FROM tokens t JOIN symbols s ON s.name = t.name JOIN enc e USING (token_id) WHERE t.kind = 'call' GROUP BY 1", ENCLOSING)
def b5(spark, sf):
    return R.call_ref_counts(A.tokens(spark, sf), A.symbols(spark, sf))


@query("b6_enclosing", "SELECT token_id, symbol_id FROM enc", ENCLOSING)
def b6(spark, sf):
    return R.enclosing(A.tokens(spark, sf).select("token_id", "file_id", "line"), A.symbols(spark, sf)).select("token_id", "symbol_id")


@query("b7_construction_refs", "SELECT s.symbol_id, count(*) AS n FROM tokens t JOIN symbols s USING (name) WHERE t.kind = 'type' GROUP BY 1")
def b7(spark, sf):
    return R.construction_ref_counts(A.tokens(spark, sf), A.symbols(spark, sf))


@query("b10_tables", "SELECT 'edges' AS name, count(*) AS n FROM edges UNION ALL SELECT 'tokens', count(*) FROM tokens UNION ALL SELECT 'refs', count(*) FROM refs")
def b10(spark, sf):
    """The kept tables, written anew."""
    out = None
    for name, df in A.build(spark, sf).items():
        one = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("b13_delete_by_path", "SELECT file_id FROM docfiles WHERE NOT contains(path, 'src1')")
def b13(spark, sf):
    gone = A.documents(spark, sf).where(F.col("path").contains("src1")).select("path")
    return A.documents(spark, sf).join(gone, "path", "left_anti").select("file_id")


@query("b16_remove_files", """SELECT (SELECT count(*) FROM symbols WHERE file_id NOT IN (SELECT file_id FROM files WHERE contains(path, 'cli'))) AS symbols, (SELECT count(*) FROM tokens WHERE file_id NOT IN (SELECT file_id FROM files WHERE contains(path, 'cli'))) AS tokens,
 (SELECT count(*) FROM refs WHERE symbol_id NOT IN (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE contains(path, 'cli'))) AND token_id NOT IN (SELECT token_id FROM tokens WHERE file_id IN (SELECT file_id FROM files WHERE contains(path, 'cli')))) AS refs,
 (SELECT count(*) FROM edges WHERE from_symbol NOT IN (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE contains(path, 'cli'))) AND to_symbol NOT IN (SELECT symbol_id FROM symbols WHERE file_id IN (SELECT file_id FROM files WHERE contains(path, 'cli')))) AS edges""")
def b16(spark, sf):
    left = R.without_files(A.files(spark, sf).where(F.col("path").contains("cli")).select("file_id"), A.symbols(spark, sf), A.tokens(spark, sf), A.refs(spark, sf), A.edges(spark, sf))
    out = None
    for k in ("symbols", "tokens", "refs", "edges"):
        one = left[k].agg(F.count("*").alias(k))
        out = one if out is None else out.join(F.broadcast(one))
    return out


@query("b17_next_ids", f"SELECT max(symbol_id) + 1 AS next_symbol, (SELECT max(token_id) + 1 FROM tokens) AS next_token FROM symbols")
def b17(spark, sf):
    return A.symbols(spark, sf).agg((F.max("symbol_id") + 1).alias("next_symbol")).join(F.broadcast(A.tokens(spark, sf).agg((F.max("token_id") + 1).alias("next_token"))))


@query("b18_index_stats", """SELECT (SELECT count(*) FROM files) AS files, count(*) AS symbols, count(*) FILTER (is_entry) AS entry_points, count(DISTINCT name) AS names, sum(strlen(name))::BIGINT AS name_bytes, (SELECT count(*) FROM tokens) AS tokens, (SELECT count(*) FROM refs) AS refs, (SELECT count(*) FROM edges) AS edges FROM symbols""")
def b18(spark, sf):
    return R.index_stats(A.files(spark, sf), A.symbols(spark, sf), A.tokens(spark, sf), A.refs(spark, sf), A.edges(spark, sf))


def found(spark, sf, kind=None):
    return T.references(NAME, A.symbols(spark, sf), A.tokens(spark, sf), A.refs(spark, sf), kind)


@query("t5_refs", "SELECT * FROM found", REFS)
def t5(spark, sf):
    return found(spark, sf)


@query("t5_list", """SELECT token_id, path, line, col, kind, e.name AS enclosing FROM (SELECT f.*, path FROM found f JOIN files USING (file_id) WHERE contains(path, 'core') ORDER BY path, line, col, token_id LIMIT 50) LEFT JOIN enc e USING (token_id)""", f"{REFS}, {ENCLOSING}")
def t5l(spark, sf):
    return T.reference_list(NAME, A.symbols(spark, sf), A.tokens(spark, sf), A.refs(spark, sf), A.files(spark, sf), path="core", limit=50).drop("context")


@query("t5_by_kind", "SELECT kind, count(*) AS n FROM found GROUP BY 1", REFS)
def t5k(spark, sf):
    return found(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("t5_by_file", "SELECT path, count(*) AS n FROM found JOIN files USING (file_id) GROUP BY 1", REFS)
def t5f(spark, sf):
    return found(spark, sf).groupBy("file_id").agg(F.count("*").alias("n")).join(A.files(spark, sf), "file_id").select("path", "n")


@query("t6_writes", "SELECT token_id, line FROM found WHERE kind = 'write'", REFS)
def t6(spark, sf):
    return found(spark, sf, "write").select("token_id", "line")


@query("t6_types", "SELECT token_id, line FROM found WHERE kind = 'type_annotation'", REFS)
def t6t(spark, sf):
    return found(spark, sf, "type_annotation").select("token_id", "line")


@query("t7_refs_enclosing", "SELECT f.token_id, e.name AS enclosing FROM found f LEFT JOIN enc e USING (token_id)", f"{REFS}, {ENCLOSING}")
def t7(spark, sf):
    f = found(spark, sf)
    return f.join(R.enclosing(f.select("token_id", "file_id", "line"), A.symbols(spark, sf)).select("token_id", F.col("name").alias("enclosing")), "token_id", "left").select("token_id", "enclosing")


@query("t11_exports", "SELECT path, symbol_id, name, kind FROM symbols JOIN files USING (file_id) WHERE is_exported AND contains(path, 'core/a')")
def t11(spark, sf):
    return T.exports(A.symbols(spark, sf), A.files(spark, sf), "core/a")


@query("t11_imported_by", """SELECT DISTINCT path FROM tokens JOIN files USING (file_id) WHERE kind = 'import' AND NOT contains(path, 'core/a/file_24') AND name IN (SELECT name FROM symbols JOIN files USING (file_id) WHERE is_exported AND contains(path, 'core/a/file_24'))""")
def t11i(spark, sf):
    return T.imported_by(A.symbols(spark, sf), A.tokens(spark, sf), A.files(spark, sf), "core/a/file_24")


@query("t11_dependencies", "SELECT DISTINCT name FROM tokens JOIN files USING (file_id) WHERE kind = 'import' AND contains(path, 'core/a/file_24')")
def t11d(spark, sf):
    return T.dependencies(A.tokens(spark, sf), A.files(spark, sf), "core/a/file_24")


@query("t13_flow", f"SELECT rn AS step, CASE WHEN rn = 1 THEN 'define' WHEN kind = 'call' THEN 'pass_to_function' ELSE 'read' END AS action, path, line, col FROM (SELECT *, (row_number() OVER (ORDER BY path, line, col, token_id))::INT AS rn FROM tokens JOIN files USING (file_id) WHERE name = '{NAME}')")
def t13(spark, sf):
    return T.flow(NAME, A.tokens(spark, sf), A.files(spark, sf))


@query("t15_scope", """SELECT 'enclosing' AS role, name, start_line AS defined_at FROM e UNION ALL
SELECT CASE WHEN kind IN ('variable', 'constant') THEN 'local' ELSE 'parameter' END, name, start_line FROM s WHERE end_line < 700 AND (kind IN ('variable', 'constant') OR (kind IN ('function', 'method') AND name <> (SELECT name FROM e)))
UNION ALL SELECT 'import', name, line FROM tokens WHERE kind = 'import' AND file_id = (SELECT file_id FROM f)""",
       """f AS (SELECT file_id FROM files WHERE contains(path, 'api/b') ORDER BY path LIMIT 1), s AS (SELECT symbols.* FROM symbols JOIN f USING (file_id)),
e AS (SELECT * FROM s WHERE 700 BETWEEN start_line AND end_line ORDER BY end_line - start_line, symbol_id LIMIT 1)""")
def t15(spark, sf):
    return T.scope(A.symbols(spark, sf), A.tokens(spark, sf), A.files(spark, sf), "api/b", 700)


@query("t16_kinds", "SELECT kind, count(*) AS n FROM symbols GROUP BY 1")
def t16(spark, sf):
    return A.symbols(spark, sf).groupBy("kind").agg(F.count("*").alias("n"))


@query("t16_extensions", "SELECT lower(ext) AS ext, count(*) AS n FROM paths GROUP BY 1")
def t16e(spark, sf):
    from ..functions import paths

    ext = F.coalesce(F.nullif(paths.extension(F.col("path")), F.lit("")), F.lit("unknown"))
    return A.paths(spark, sf).groupBy(ext.alias("ext")).agg(F.count("*").alias("n"))


@query("t16_top_refs", "SELECT name, count(*) AS n FROM refs JOIN symbols USING (symbol_id) GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def t16r(spark, sf):
    n = A.refs(spark, sf).groupBy("symbol_id").agg(F.count("*").alias("k"))
    return n.join(A.symbols(spark, sf), "symbol_id").groupBy("name").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query("t16_largest", "SELECT path, count(*) AS n FROM symbols JOIN files USING (file_id) GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def t16l(spark, sf):
    return A.symbols(spark, sf).groupBy("file_id").agg(F.count("*").alias("n")).join(A.files(spark, sf), "file_id").orderBy(F.desc("n"), "path").limit(10).select("path", "n")


@query("t18_dead", "SELECT symbol_id, name, kind, file_id, start_line FROM dead", DEAD)
def t18(spark, sf):
    return T.dead(A.symbols(spark, sf), A.edges(spark, sf), A.refs(spark, sf)).select("symbol_id", "name", "kind", "file_id", "start_line")


@query("t19_dead_by_kind", "SELECT kind, count(*) AS n FROM dead GROUP BY 1", DEAD)
def t19(spark, sf):
    return T.dead(A.symbols(spark, sf), A.edges(spark, sf), A.refs(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("t19_dead_filtered", "SELECT symbol_id, path FROM dead JOIN files USING (file_id) WHERE contains(path, 'src') AND contains(lower(kind), 'fun') AND regexp_matches(name, '^[a-m].*') ORDER BY path, start_line, symbol_id LIMIT 50", DEAD)
def t19f(spark, sf):
    d = T.dead(A.symbols(spark, sf), A.edges(spark, sf), A.refs(spark, sf)).join(A.files(spark, sf), "file_id")
    return T.universal(d, "src", "FUN", "^[a-m].*").orderBy("path", "start_line", "symbol_id").limit(50).select("symbol_id", "path")


@query("t20_potential_callers", """SELECT dead_id, caller, 'same file' AS reason FROM (SELECT d.symbol_id AS dead_id, s.symbol_id AS caller, row_number() OVER (PARTITION BY d.symbol_id ORDER BY s.symbol_id) AS rn FROM dead d JOIN symbols s ON s.file_id = d.file_id AND s.kind IN ('function', 'method') AND s.symbol_id <> d.symbol_id) WHERE rn <= 3
UNION ALL SELECT d.symbol_id, e.symbol_id, 'entry point' FROM dead d, (SELECT symbol_id FROM symbols WHERE is_entry ORDER BY symbol_id LIMIT 2) e WHERE e.symbol_id <> d.symbol_id
UNION ALL SELECT dead_id, token_id, 'same name' FROM (SELECT d.symbol_id AS dead_id, t.token_id, row_number() OVER (PARTITION BY d.symbol_id ORDER BY t.file_id, t.line, t.token_id) AS rn FROM dead d JOIN tokens t ON t.name = d.name AND NOT (t.file_id = d.file_id AND t.line = d.start_line)) WHERE rn <= 2""", DEAD)
def t20(spark, sf):
    return T.potential_callers(T.dead(A.symbols(spark, sf), A.edges(spark, sf), A.refs(spark, sf)), A.symbols(spark, sf), A.tokens(spark, sf))


@query("t21_filter", "SELECT symbol_id FROM symbols JOIN files USING (file_id) WHERE contains(path, 'web') AND contains(kind, 'struct') AND regexp_matches(name, 'r.d')")
def t21(spark, sf):
    return T.universal(A.symbols(spark, sf).join(A.files(spark, sf), "file_id"), "web", "Struct", "r.d").select("symbol_id")


@query("t23_group_by", "SELECT path, kind, count(*) AS n FROM symbols JOIN files USING (file_id) GROUP BY ALL")
def t23(spark, sf):
    return A.symbols(spark, sf).groupBy("file_id", "kind").agg(F.count("*").alias("n")).join(A.files(spark, sf), "file_id").select("path", "kind", "n")


@query("w2_list", "SELECT symbol_id, refs, callers, callees, dead FROM rows WHERE kind = 'method' AND dead AND contains(lower(name), 'e') ORDER BY symbol_id LIMIT 200", ROWS)
def w2(spark, sf):
    return D.symbol_list(rows(spark, sf), "method", "dead", "E").select("symbol_id", "refs", "callers", "callees", "dead")


@query("w7_file", "SELECT symbol_id, name, start_line, refs, dead FROM rows WHERE path = 'src/api/b/file_1.py'", ROWS)
def w7(spark, sf):
    return rows(spark, sf).where("path = 'src/api/b/file_1.py'").select("symbol_id", "name", "start_line", "refs", "dead")


@query("w12_callees", "SELECT from_symbol, s.symbol_id, s.name, line FROM edges JOIN symbols s ON s.symbol_id = to_symbol")
def w12(spark, sf):
    return A.edges(spark, sf).join(A.symbols(spark, sf), F.col("to_symbol") == F.col("symbol_id")).select("from_symbol", "symbol_id", "name", "line")


@query("w13_refs", "SELECT r.symbol_id, path || ':' || line || ' - ' || name AS context, upper(r.kind[1]) || r.kind[2:] AS kind FROM refs r JOIN tokens USING (token_id) JOIN files USING (file_id)")
def w13(spark, sf):
    r = A.refs(spark, sf).select("token_id", "symbol_id", F.col("kind").alias("k")).join(A.tokens(spark, sf), "token_id").join(A.files(spark, sf), "file_id")
    return r.select("symbol_id", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" - "), "name").alias("context"), F.concat(F.upper(F.substring("k", 1, 1)), F.expr("substring(k, 2)")).alias("kind"))


@query("c2_filter", "SELECT symbol_id FROM rows WHERE (contains(lower(name), 'bolt') OR contains(lower(path), 'bolt')) AND kind IN ('function', 'struct') AND callers >= 1 AND callees <= 9 AND regexp_matches(path, '(?i)^src/.*/b/') AND NOT is_entry", ROWS)
def c2(spark, sf):
    return D.matching(rows(spark, sf), "bolt kind:function kind:struct kind:nothing callers:>1 callees:<9 file:src/**/b/ entry:false state:odd").select("symbol_id")


@query("c2_dead_state", "SELECT symbol_id FROM rows WHERE dead OR refs = 0", ROWS)
def c2d(spark, sf):
    return D.matching(rows(spark, sf), "state:dead").select("symbol_id")


@query("c5_sort", "SELECT symbol_id, refs FROM rows ORDER BY refs DESC, symbol_id LIMIT 100", ROWS)
def c5(spark, sf):
    return rows(spark, sf).orderBy(F.desc("refs"), "symbol_id").limit(100).select("symbol_id", "refs")


@query("c8_entry_table", "SELECT symbol_id FROM rows WHERE is_entry OR (callers = 0 AND refs = 0)", ROWS)
def c8(spark, sf):
    return D.entry_table(rows(spark, sf)).select("symbol_id")


@query("c9_connections", """SELECT a.name AS "from", b.name AS "to", 'call' AS kind, count(*) AS count, count(DISTINCT a.file_id) AS files FROM edges JOIN symbols a ON a.symbol_id = from_symbol JOIN symbols b ON b.symbol_id = to_symbol GROUP BY ALL""")
def c9(spark, sf):
    return D.connections(A.edges(spark, sf), A.symbols(spark, sf))


@query("c9_loose", """SELECT name AS "from", '(various)' AS "to", 'reference' AS kind, arg_min(callers + callees, symbol_id)::BIGINT AS count, 1::BIGINT AS files FROM rows WHERE callers > 0 OR callees > 0 GROUP BY name""", ROWS)
def c9f(spark, sf):
    return D.loose_connections(rows(spark, sf))


@query("c6_sort", "SELECT symbol_id, name FROM rows ORDER BY lower(name) DESC, symbol_id LIMIT 100", ROWS)
def c6(spark, sf):
    return D.sorted_table(rows(spark, sf), "name", False, True).limit(100).select("symbol_id", "name")


@query("c21_detail", """SELECT kind, n, files FROM (SELECT kind, count(*) AS n FROM (SELECT r.kind FROM refs r JOIN tokens t USING (token_id) WHERE symbol_id = 77 ORDER BY t.file_id, t.line, token_id LIMIT 20) GROUP BY 1)
JOIN (SELECT r.kind, count(DISTINCT t.file_id) AS files FROM refs r JOIN tokens t USING (token_id) WHERE symbol_id = 77 GROUP BY 1) USING (kind)""")
def c21d(spark, sf):
    return D.detail(A.refs(spark, sf), A.tokens(spark, sf), 77)


@query("c20_labels", "SELECT symbol_id, CASE WHEN length(name) <= 8 THEN name ELSE left(name, 6) || '..' END AS label FROM symbols")
def c20l(spark, sf):
    return A.symbols(spark, sf).select("symbol_id", D.short_label(F.col("name"), 50).alias("label"))


@query("o4_refs_csv", """SELECT path || ',' || line || ',' || col || ',' || kind || ',,' || coalesce(e.name, '') AS value FROM found JOIN files USING (file_id) LEFT JOIN enc e USING (token_id)""", f"{REFS}, {ENCLOSING}")
def o4r(spark, sf):
    from ..operators import export as O

    r = T.reference_list(NAME, A.symbols(spark, sf), A.tokens(spark, sf), A.refs(spark, sf), A.files(spark, sf))
    return O.csv_rows(O.table_of("refs", r.withColumnsRenamed({"path": "file", "col": "column", "enclosing": "enclosing_symbol"})))


@query("c11_health", "SELECT *, CASE WHEN pct >= 70 THEN 'good' WHEN pct >= 40 THEN 'fair' ELSE 'poor' END AS class FROM (SELECT path, count(*) AS total, count(*) FILTER (dead) AS dead, floor(100.0 * count(*) FILTER (NOT dead) / count(*) + 0.5)::BIGINT AS pct FROM rows GROUP BY path HAVING count(*) >= 3) ORDER BY pct, path LIMIT 5", ROWS)
def c11(spark, sf):
    return D.health(rows(spark, sf))


@query("c12_top_refs", "SELECT symbol_id, refs FROM rows ORDER BY refs DESC, symbol_id LIMIT 5", ROWS)
def c12(spark, sf):
    return rows(spark, sf).orderBy(F.desc("refs"), "symbol_id").limit(5).select("symbol_id", "refs")


@query("c13_dead_share", "SELECT round(100.0 * count(*) FILTER (dead) / count(*), 4)::DOUBLE AS dead_pct, round(100.0 * count(*) FILTER (NOT dead) / count(*), 4)::DOUBLE AS health_pct FROM rows", ROWS)
def c13(spark, sf):
    return rows(spark, sf).agg(F.round(100.0 * F.count_if("dead") / F.count("*"), 4).cast("double").alias("dead_pct"), F.round(100.0 * F.count_if(~F.col("dead")) / F.count("*"), 4).cast("double").alias("health_pct"))


@query("c15_roles", """SELECT file, role, n_in, n_out FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n_in + n_out DESC, file) AS rn FROM (
SELECT file, CASE WHEN n_in = 0 THEN 'entry' WHEN n_out = 0 THEN 'leaf' ELSE 'internal' END AS role, n_in, n_out FROM (SELECT file, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT from_file AS file, 1 AS o, 0 AS i FROM d UNION ALL SELECT to_file, 0, 1 FROM d) GROUP BY file))) WHERE rn <= 20""",
       f"{CROSS}, d AS (SELECT DISTINCT from_file, to_file FROM cross_edges)")
def c15(spark, sf):
    return D.roles(cross(spark, sf))


LINKED = f"""{CROSS}, d AS (SELECT DISTINCT from_file, to_file FROM cross_edges), deg AS (SELECT file, CASE WHEN n_in = 0 THEN 1 WHEN n_out = 0 THEN 3 ELSE 2 END AS pos, n_in + n_out AS n FROM (SELECT file, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT from_file AS file, 1 AS o, 0 AS i FROM d UNION ALL SELECT to_file, 0, 1 FROM d) GROUP BY file)),
kept AS (SELECT file, pos FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY n DESC, file) AS rn FROM deg) WHERE rn <= 20)"""


@query("c15_links", "SELECT from_file, to_file, count(*) AS weight FROM cross_edges JOIN kept x ON x.file = from_file JOIN kept y ON y.file = to_file WHERE abs(x.pos - y.pos) = 1 GROUP BY ALL", LINKED)
def c15l(spark, sf):
    return D.role_links(cross(spark, sf), D.roles(cross(spark, sf)))


@query("c17_tree_counts", "SELECT (SELECT count(*) FROM files) AS files, count(*) AS symbols, count(*) FILTER (dead) AS dead FROM rows", ROWS)
def c17(spark, sf):
    return rows(spark, sf).agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("symbols"), F.count_if("dead").alias("dead"))
