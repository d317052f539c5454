"""From extracted rows to a graph: enclosing symbols, call edges, references, entry points, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = 64  # lines
TILE = 256  # symbols of a name that a call site meets at a time
SHARES, TASKS = 4, 256  # shares of a name's call sites, and tasks at least, when names fan out


def around_lines(lines: DataFrame, symbols: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """file_id, line, symbol_id, name of the smallest symbol around each (file_id, line), the smallest id on ties.

    An interval join as an equi-join: symbols of ordinary length are listed under each block of
    lines that they touch; the few that span many blocks go by file and are cut to the wanted
    lines. Distinct lines are resolved once.
    """
    lines = lines.select("file_id", "line").distinct().withColumn("k", F.floor(F.col("line") / bucket))
    span = symbols.select("file_id", "symbol_id", "name", "start_line", "end_line", F.floor(F.col("start_line") / bucket).alias("k0"), F.floor(F.col("end_line") / bucket).alias("k1"))
    short = span.where("k1 - k0 <= 16").withColumn("k", F.explode(F.sequence("k0", "k1")))
    long = span.where("k1 - k0 > 16")
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "symbol_id", "name")).alias("s")
    hits = lines.join(short.drop("k0", "k1"), ["file_id", "k"]).where(inside).groupBy("file_id", "line").agg(best)
    more = lines.join(long.drop("k0", "k1"), "file_id").where(inside).groupBy("file_id", "line").agg(best)
    one = hits.unionByName(more).groupBy("file_id", "line").agg(F.min("s").alias("s"))
    return one.select("file_id", "line", F.col("s.symbol_id").alias("symbol_id"), F.col("s.name").alias("name"))


def enclosing(at: DataFrame, symbols: DataFrame, key: str = "token_id", bucket: int = BUCKET) -> DataFrame:
    """key, symbol_id, name of the smallest symbol around each (key, file_id, line)."""
    return at.select(key, "file_id", "line").join(around_lines(at, symbols, bucket), ["file_id", "line"]).select(key, "symbol_id", "name")


def call_sites(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """name, caller, line, n: calls of a name inside a symbol, by line. Counted before any name meets the symbols that bear it."""
    t = tokens.where("kind = 'call'").groupBy("file_id", "line", "name").agg(F.count("*").alias("n"))
    e = around_lines(t, symbols).select("file_id", "line", F.col("symbol_id").alias("caller"))
    return t.join(e, ["file_id", "line"]).groupBy("name", "caller", "line").agg(F.sum("n").alias("n"))


def call_edge_counts(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_symbol, to_symbol, line, n call sites; each call goes to every symbol of its name, never to its caller."""
    targets = symbols.select("name", F.col("symbol_id").alias("target"))
    return call_sites(tokens, symbols).join(targets, "name").where("caller <> target").select(F.col("caller").alias("from_symbol"), F.col("target").alias("to_symbol"), "line", "n")


def call_edge_table(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_edge_counts() for results far larger than the tables, in an order that files keep small.

    A row of up to TILE symbols of a name meets one call site after the other, so that caller, line and n stay the same for
    TILE rows and the symbols repeat after as many: runs and repeats, which Parquet stores in a few hundredths of a byte. A
    share of a name's sites meets all of its symbols in one task, and few names in a task keep its dictionary small. The
    number of tasks is given, since adaptive execution knows the size before the fan-out only.
    """
    whole = symbols.where("name is not null and symbol_id is not null").groupBy("name", F.expr("symbol_id div 1048576").alias("part")).agg(F.sort_array(F.collect_list("symbol_id")).alias("ids"))
    some = lambda i: F.slice("ids", i * TILE + 1, TILE)
    tiles = whole.select("name", F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(ids) - 1) div {TILE} as int)")), some)).alias("tile"))
    tiles = tiles.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    sites = call_sites(tokens, symbols).withColumn("share", F.pmod(F.hash("caller", "line"), F.lit(SHARES)))
    tasks = max(TASKS, int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # in a merge join each row of the left side meets all rows of the right side in turn
    met = tiles.repartition(tasks, "name", "share").hint("merge").join(sites.repartition(tasks, "name", "share"), ["name", "share"])
    return met.select(F.col("caller").alias("from_symbol"), F.explode("tile").alias("to_symbol"), "line", "n").where("from_symbol <> to_symbol")


def call_edges(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """from_symbol, to_symbol, line: a row for each call site, no self edges."""
    c = call_edge_counts(tokens, symbols)
    return c.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("from_symbol", "to_symbol", "line")


def call_ref_counts(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, n: calls inside any symbol; recursion counts."""
    n = call_sites(tokens, symbols).groupBy("name").agg(F.sum("n").alias("n"))
    return symbols.select("name", "symbol_id").join(n, "name").select("symbol_id", "n")


def call_refs(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """token_id, symbol_id, kind of calls inside a symbol; recursion counts."""
    t = tokens.where("kind = 'call'")
    inside = t.join(around_lines(t, symbols).select("file_id", "line"), ["file_id", "line"], "left_semi").select("token_id", "name")
    return inside.join(symbols.select("name", "symbol_id"), "name").select("token_id", "symbol_id", F.lit("call").alias("kind"))


def construction_refs(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    return tokens.where("kind = 'type'").join(symbols.select("name", "symbol_id"), "name").select("token_id", "symbol_id", F.lit("construction").alias("kind"))


def construction_ref_counts(tokens: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, n: constructions of its name, counted by name before the name meets the symbols that bear it."""
    n = tokens.where("kind = 'type'").groupBy("name").agg(F.count("*").alias("n"))
    return symbols.select("name", "symbol_id").join(n, "name").groupBy("symbol_id").agg(F.sum("n").alias("n"))


ENTRY_NAMES = ("handler", "default", "GET", "POST", "PUT", "DELETE", "PATCH")


def is_entry(kind: Column, name: Column, path: Column, exported: Column) -> Column:
    """Functions and methods that are started from outside, by name, path or export."""
    p = F.lower(path)
    base = F.element_at(F.split(p, "/"), -1)
    by_path = (base == "lib.rs") | p.contains("test") | p.contains("spec") | base.startswith("test_") | base.endswith("_test.rs") | p.contains("bench") | base.isin("index.ts", "index.js", "index.tsx", "index.jsx")
    return kind.isin("function", "method") & ((name == "main") | exported | by_path | name.isin(*ENTRY_NAMES) | name.startswith("test_"))


def without_files(gone: DataFrame, symbols: DataFrame, tokens: DataFrame, refs: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables without what stands in the files `gone` (file_id), and without what points at it."""
    s, t = symbols.join(gone, "file_id", "left_anti"), tokens.join(gone, "file_id", "left_anti")
    out_s, out_t = symbols.join(gone, "file_id", "left_semi").select("symbol_id"), tokens.join(gone, "file_id", "left_semi").select("token_id")
    r = refs.join(out_s, "symbol_id", "left_anti").join(out_t, "token_id", "left_anti")
    e = edges.join(out_s.withColumnRenamed("symbol_id", "from_symbol"), "from_symbol", "left_anti").join(out_s.withColumnRenamed("symbol_id", "to_symbol"), "to_symbol", "left_anti")
    return {"symbols": s, "tokens": t, "refs": r.select(*refs.columns), "edges": e.select(*edges.columns)}


def index_stats(files: DataFrame, symbols: DataFrame, tokens: DataFrame, refs: DataFrame, edges: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """One row of counters."""
    one = [files.agg(F.count("*").alias("files")), symbols.agg(F.count("*").alias("symbols"), F.count_if("is_entry").alias("entry_points"), F.count_distinct("name").alias("names"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).cast("long").alias("name_bytes")), tokens.agg(F.count("*").alias("tokens")), refs.agg(F.count("*").alias("refs")), edges.agg(F.count("*").alias("edges"))]
    if scopes is not None:
        one.append(scopes.agg(F.count("*").alias("scopes")))
    out = one[0]
    for x in one[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out
