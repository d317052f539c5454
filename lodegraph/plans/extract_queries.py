"""Queries over extracted source text, incremental updates and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as O
from ..operators import extract as X
from ..operators import incremental as I
from ..operators import lines as L
from ..operators import resolve as R
from ..operators import snapshots as Z
from ..sources import adapters as A
from .registry import query
from .text_queries import CHUNKS


def page_files(spark, sf):
    """Pages as source files: their scripts hold declarations and calls. The table is one small file, dealt out because extraction is work."""
    return A.read(spark, sf, "pages").repartition(spark.sparkContext.defaultParallelism).select(F.col("page_id").alias("file_id"), F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), F.col("html").alias("content"))


def words(names) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(names)) + ")"


HTML = f"""called AS (SELECT page_id, unnest(regexp_extract_all(html, '([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1)) AS name FROM pages),
calls AS (SELECT * FROM called WHERE name NOT IN {words(X.KEYWORDS)} AND name NOT IN {words(X.JAVASCRIPT_BUILTINS)}),
named AS (SELECT page_id, unnest(regexp_extract_all(html, '[a-zA-Z_][a-zA-Z0-9_]*')) AS name FROM pages),
words AS (SELECT * FROM named WHERE length(name) > 1 AND name NOT IN {words(X.KEYWORDS)}),
built AS (SELECT page_id, unnest(regexp_extract_all(html, '\\bnew\\s+([A-Za-z_$][0-9A-Za-z_$]+)', 1)) AS name FROM pages)"""


@query("x8_extract", f"""SELECT page_id AS file_id, 'call' AS what, count(*) AS n FROM calls GROUP BY 1 UNION ALL SELECT page_id, 'token', count(*) FROM words GROUP BY 1
UNION ALL SELECT page_id, 'type', count(*) FROM built WHERE name NOT IN {words(X.KEYWORDS)} AND name NOT IN {words(X.JAVASCRIPT_BUILTINS)} GROUP BY 1 UNION ALL SELECT page_id, 'scope', 1 FROM pages WHERE trim(html) <> ''""", HTML)
def x8(spark, sf):
    """Rows of all pages by kind, but for declarations and imports, which cross lines: those have golden files in the tests."""
    return X.extract(page_files(spark, sf)).where("what not in ('symbol', 'import')").groupBy("file_id", "what").agg(F.count("*").alias("n"))


@query("x17_calls", "SELECT page_id AS file_id, name, count(*) AS n FROM calls GROUP BY ALL", HTML)
def x17(spark, sf):
    return X.extract(page_files(spark, sf)).where("what = 'call'").groupBy("file_id", "name").agg(F.count("*").alias("n"))


@query("x20_tokens", "SELECT name, count(*) AS n FROM words GROUP BY 1", HTML)
def x20(spark, sf):
    return X.extract(page_files(spark, sf)).where("what = 'token'").groupBy("name").agg(F.count("*").alias("n"))


@query("x19_file_scopes", "SELECT file_id, 1 AS start_line, greatest(max(line), 1)::INT AS end_line FROM lines GROUP BY 1")
def x19(spark, sf):
    return L.lines(A.documents(spark, sf)).groupBy("file_id").agg(F.lit(1).alias("start_line"), F.greatest(F.max("line"), F.lit(1)).alias("end_line"))


@query("x23_columns", "SELECT file_id, line, strlen(substring(text, 1, strpos(text, ' ') - 1))::INT AS col FROM lines WHERE contains(text, ' ')")
def x23(spark, sf):
    t = L.lines(A.documents(spark, sf)).where(F.col("text").contains(" "))
    return t.select("file_id", "line", F.octet_length(F.substring(F.col("text"), F.lit(1), F.instr("text", " ") - 1)).alias("col"))


@query("b9_build")
def b9(spark, sf):
    """Sizes of the graph that the pages' scripts give."""
    g = X.build(page_files(spark, sf))
    return R.index_stats(page_files(spark, sf), g["symbols"], g["tokens"], g["refs"], g["edges"], g["scopes"])


@query("b8_scopes", """SELECT s.symbol_id AS scope_id, (SELECT arg_min(p.symbol_id, p.end_line - p.start_line) FROM symbols p WHERE p.file_id = s.file_id AND p.symbol_id <> s.symbol_id AND p.start_line <= s.start_line AND p.end_line >= s.end_line) AS parent_id FROM symbols s""")
def b8(spark, sf):
    s = A.symbols(spark, sf).select(F.col("symbol_id").alias("scope_id"), "file_id", "kind", "start_line", "end_line")
    return X.scope_parents(s).select("scope_id", "parent_id")


@query("r5_update_chunks", """SELECT id FROM chunks WHERE NOT contains(path, '/de/') AND NOT contains(path, '/fr/')
UNION ALL SELECT path || ':1:1' FROM docfiles WHERE contains(path, '/fr/')""", CHUNKS)
def r5(spark, sf):
    """German documents go, French ones are cut to one line."""
    d = A.documents(spark, sf)
    changed = d.where(F.col("path").contains("/fr/")).withColumn("content", F.lit("une ligne"))
    gone = d.where(F.col("path").contains("/de/")).select("path")
    return I.update_chunks(L.chunks(d), changed, gone).select("id")


@query("r6_replace_files", "SELECT file_id, CASE WHEN contains(path, '/fr/') THEN 'x' ELSE content END AS content FROM docfiles WHERE NOT contains(path, '/de/')")
def r6(spark, sf):
    d = A.documents(spark, sf)
    return I.replace_files(d, d.where(F.col("path").contains("/fr/")).withColumn("content", F.lit("x")), d.where(F.col("path").contains("/de/")).select("path")).select("file_id", "content")


@query("o3_json", "SELECT '{\"symbol_id\":' || symbol_id || ',\"name\":\"' || name || '\"}' AS value FROM symbols")
def o3(spark, sf):
    return O.json_rows(A.symbols(spark, sf).select("symbol_id", "name"))


@query("o4_csv", """SELECT doc_id || ',' || CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS value FROM documents""")
def o4(spark, sf):
    return O.csv_rows(A.read(spark, sf, "documents").select("doc_id", "text"))


@query("o5_dot", "SELECT DISTINCT '  \"' || a || '\" -> \"' || b || '\";' AS value FROM file_edges")
def o5(spark, sf):
    return O.dot_rows(A.file_edges(spark, sf), "a", "b").distinct()


@query("o6_markdown", "SELECT '| ' || file_id || ' | ' || path || ' |' AS value FROM paths")
def o6(spark, sf):
    return O.markdown_rows(A.paths(spark, sf).select("file_id", "path"))


@query("o7_preview", "SELECT id, array_to_string(list_transform(string_split(content, chr(10))[1:3], lambda x: CASE WHEN length(x) > 80 THEN substring(x, 1, 77) || '...' ELSE x END), chr(10)) AS shown FROM chunks", CHUNKS)
def o7(spark, sf):
    return L.chunks(A.documents(spark, sf)).select("id", O.preview(F.col("content")).alias("shown"))


@query("z6_snapshot_after_update", "SELECT count(DISTINCT path) AS files, count(*) AS symbols FROM symbols JOIN files USING (file_id) WHERE NOT contains(path, 'cli')")
def z6(spark, sf):
    s = A.symbols(spark, sf).join(A.files(spark, sf), "file_id").where(~F.col("path").contains("cli")).withColumn("dead", F.lit(False))
    return Z.create(s, A.file_edges(spark, sf).select(F.col("a").alias("component")), "2024-01-02 03:04:05", "p").select("metrics.files", "metrics.symbols")
