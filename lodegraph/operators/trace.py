"""The trace analyses over symbols, edges, tokens and refs.

Where a walk's order would decide a result, the canonical meaning is used: shortest
depth, smallest predecessor, a total order for every list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ranked
from . import graph, resolve

# -- filters ------------------------------------------------------------------


def universal(df: DataFrame, path: str | None = None, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Path substring, kind substring and name regex; an invalid regex is ignored."""
    if path:
        df = df.where(F.col("path").contains(path))
    if kind:
        df = df.where(F.lower("kind").contains(kind.lower()))
    if name:
        import re

        try:
            re.compile(name)
        except re.error:
            return df
        df = df.where(F.col("name").rlike(name))
    return df


# -- references ---------------------------------------------------------------


def simple_kind(kind: Column) -> Column:
    return F.when(kind.isin("call", "construction"), "call").when(kind.isin("write", "type_annotation", "import", "export"), kind).otherwise("read")


def reference_list(name: str, symbols: DataFrame, tokens: DataFrame, refs: DataFrame, files: DataFrame, lines_: DataFrame | None = None, path: str | None = None, kind: str | None = None, context: int = 0, limit: int | None = None) -> DataFrame:
    """path, line, col, kind, enclosing (name of the smallest symbol around), context of references, by path, line, column and token.

    The limit cuts the ordered list; counts by kind and file go by references(), before any limit. Context needs
    the files' lines, and is sought for the rows of the list only.
    """
    found = references(name, symbols, tokens, refs, kind).join(files.select("file_id", "path"), "file_id")
    if path:
        found = found.where(F.col("path").contains(path))
    found = found.orderBy("path", "line", "col", "token_id")
    found = found.limit(limit) if limit is not None else found
    around = resolve.around_lines(found, symbols).select("file_id", "line", F.col("name").alias("enclosing"))
    out = found.join(around, ["file_id", "line"], "left")
    if lines_ is not None:
        from . import lines

        near = lines.context(lines_, found.select("file_id", "line").distinct(), context, context).select("file_id", "line", "context")
        out = out.join(near, ["file_id", "line"], "left")
    else:
        out = out.withColumn("context", F.lit(None).cast("string"))
    return out.select("token_id", "path", "line", "col", "kind", "enclosing", "context")


def pattern_list(regex: str, lines_: DataFrame, files: DataFrame, symbols: DataFrame, path: str | None = None, context: int = 0, limit: int | None = None) -> DataFrame:
    """path, file_id, line, col, matched, enclosing, context of the lines that match, by path and line; the limit cuts the ordered list.

    Files are narrowed by path before any line is searched; context is sought for the rows of the list only.
    """
    from . import lines

    f = files.select("file_id", "path")
    f = f.where(F.col("path").contains(path)) if path else f
    found = lines.pattern(lines_.join(f.select("file_id"), "file_id", "left_semi"), regex).join(f, "file_id").orderBy("path", "line")
    found = found.limit(limit) if limit is not None else found
    around = resolve.around_lines(found, symbols).select("file_id", "line", F.col("name").alias("enclosing"))
    near = lines.context(lines_, found.select("file_id", "line"), context, context).select("file_id", "line", "context")
    return found.join(around, ["file_id", "line"], "left").join(near, ["file_id", "line"], "left").select("path", "file_id", "line", "col", "matched", "enclosing", "context")


def references(name: str, symbols: DataFrame, tokens: DataFrame, refs: DataFrame, kind: str | None = None) -> DataFrame:
    """token_id, file_id, line, col, kind: references to symbols of the name, and tokens of the name that stand elsewhere."""
    ids = symbols.where(F.col("name") == name).select("symbol_id")
    known = refs.join(ids, "symbol_id", "left_semi").groupBy("token_id").agg(F.min("kind").alias("rkind")).join(tokens, "token_id").select("token_id", "file_id", "line", "col", simple_kind(F.col("rkind")).alias("kind"))
    place = ["file_id", "line", "col"]
    other = tokens.where(F.col("name") == name).join(known.select(*place).distinct(), place, "left_anti").select("token_id", *place, F.when(F.col("kind") == "call", "call").otherwise("read").alias("kind"))
    out = known.unionByName(other)
    return out.where(F.col("kind") == kind) if kind else out


def flow(name: str, tokens: DataFrame, files: DataFrame) -> DataFrame:
    """Tokens of a name in order of path, line and column: the first defines, calls pass on, others read."""
    t = tokens.where(F.col("name") == name).join(files.select("file_id", "path"), "file_id")
    return ranked(t, "step", "path", "line", "col", "token_id").select("step", F.when(F.col("step") == 1, "define").when(F.col("kind") == "call", "pass_to_function").otherwise("read").alias("action"), "path", "line", "col")


# -- walks --------------------------------------------------------------------


def entry_paths(symbols: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """target, entry, depth, chain (from entry to target): one shortest path from each entry point, at most max_depth symbols long."""
    r = graph.reach(edges, targets.select(F.col("symbol_id").alias("seed")), max_depth - 1, backward=True)
    entries = symbols.where("is_entry").select(F.col("symbol_id").alias("node"))
    return r.join(entries, "node", "left_semi").select(F.col("seed").alias("target"), F.col("node").alias("entry"), "depth", "chain")


def terminal_paths(edges: DataFrame, seeds: DataFrame, max_depth: int, backward: bool) -> DataFrame:
    """root, terminal, depth, chain: paths that end at a symbol without further callers (backward) or callees."""
    r = graph.reach(edges, seeds.select(F.col("symbol_id").alias("seed")), max_depth, backward)
    more = edges.select(F.col("to_symbol" if backward else "from_symbol").alias("node")).distinct()
    return r.where("depth > 0").join(more, "node", "left_anti").select(F.col("seed").alias("root"), F.col("node").alias("terminal"), "depth", "chain")


def risk(entries: Column, files: Column, direct: Column) -> Column:
    return F.when((entries > 10) | (files > 50), "critical").when((entries > 5) | (files > 20), "high").when((direct > 5) | (files > 5), "medium").otherwise("low")


def impact(symbols: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 10, with_target: bool = True, local: int = graph.LOCAL) -> DataFrame:
    """symbol_id, direct, transitive, files, entries, risk: who is reached by walking up from each target.

    A graph of up to `local` edges and symbols, which is checked, is walked by each task for its own targets; a larger one level by level.
    """
    seeds, steps = targets.select(F.col("symbol_id").alias("seed")), graph.stepped(edges, backward=True)
    if steps.count() + symbols.count() <= local:
        out = graph.impact_sums(steps, symbols, seeds, max_depth, with_target)
    else:
        out = impact_by_levels(symbols, steps, seeds, max_depth, with_target)
    return out.select(F.col("seed").alias("symbol_id"), "direct", "transitive", "files", "entries", risk(F.col("entries"), F.col("files"), F.col("direct")).alias("risk"))


def impact_by_levels(symbols: DataFrame, steps: DataFrame, seeds: DataFrame, max_depth: int, with_target: bool) -> DataFrame:
    """seed, direct, transitive, entries, files: graph.impact_sums() for a graph of any size."""
    near, places = graph.near(steps, seeds, max_depth)
    up = F.col("direct").bitwiseOR(F.col("far"))
    rows = near.join(symbols.select(F.col("symbol_id").alias("node"), "file_id", "is_entry"), "node").withColumn("all", F.col("own").bitwiseOR(up) if with_target else up).where("`all` <> 0")
    has = lambda mask: F.sum(F.call_function("getbit", F.col(mask), F.col("bit")).cast("long"))
    sums = rows.withColumn("bit", F.explode(graph.bits(F.col("all")))).groupBy("block", "bit").agg(has("direct").alias("direct"), has("far").alias("transitive"), F.count_if("is_entry").alias("entries"))
    by_file = rows.groupBy("block", "file_id").agg(F.bit_or("all").alias("all"))
    files = by_file.withColumn("bit", F.explode(graph.bits(F.col("all")))).groupBy("block", "bit").agg(F.count("file_id").alias("files"))
    return sums.join(files, ["block", "bit"]).join(places, ["block", "bit"]).select("seed", "direct", "transitive", "entries", "files")


def named_target(symbols: DataFrame, target: str) -> DataFrame:
    """Symbols of a name, which may stand behind a file and a colon; the file doesn't narrow the search."""
    return symbols.where(F.col("name") == target.rpartition(":")[2])


def impact_names(symbols: DataFrame, edges: DataFrame, files: DataFrame, target: str, max_depth: int = 10) -> DataFrame:
    """what (direct or transitive), shown, depth: `name (file:line)` of direct callers, `name (depth d)` of those further up, each once."""
    seeds = named_target(symbols, target).select(F.col("symbol_id").alias("seed"))
    r = graph.reach(edges, seeds, max_depth, backward=True).where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"))
    s = r.join(symbols.withColumnRenamed("symbol_id", "node"), "node").join(files.select("file_id", "path"), "file_id")
    place = F.concat("name", F.lit(" ("), "path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")"))
    far = F.concat("name", F.lit(" (depth "), F.col("depth").cast("string"), F.lit(")"))
    return s.select(F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("what"), F.when(F.col("depth") == 1, place).otherwise(far).alias("shown"), "depth").distinct()


def call_depths(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """max_depth, avg_depth over entry points: each one's largest shortest distance downward."""
    seeds = symbols.where("is_entry").select(F.col("symbol_id").alias("seed"))
    d = graph.farthest(edges, seeds)
    return d.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.round(F.coalesce(F.avg("depth"), F.lit(0.0)), 4).alias("avg_depth"))


def best_paths(symbols: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 50, most: int = 5) -> DataFrame:
    """target, place, entry, depth, chain: up to `most` paths from entry points for each target, the shortest first."""
    w = Window.partitionBy("target").orderBy("depth", "entry")
    return entry_paths(symbols, edges, targets, max_depth).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("target", "place", "entry", "depth", "chain")


def cycle_paths(edges: DataFrame, found: DataFrame) -> DataFrame:
    """component, chain: one shortest cycle through the smallest node of each component; edges (a, b), found (node, component)."""
    inside = edges.join(found.toDF("a", "component"), "a").join(found.toDF("b", "other"), "b").where("component = other and a <> b").select(F.col("a").alias("from_symbol"), F.col("b").alias("to_symbol"), F.lit(0).alias("line")).distinct()
    roots = found.select(F.col("component").alias("seed")).distinct()
    reached = graph.reach(inside, roots, None)
    back = reached.join(inside.select(F.col("from_symbol").alias("node"), F.col("to_symbol").alias("seed")), ["node", "seed"])
    best = back.groupBy("seed").agg(F.min(F.struct("depth", "node", "chain")).alias("m"))
    return best.select(F.col("seed").alias("component"), F.concat("m.chain", F.array("seed")).alias("chain"))


# -- dead code ----------------------------------------------------------------


def dead(symbols: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols that are no entry point and that nothing calls or refers to."""
    return symbols.where("not is_entry").join(edges.select(F.col("to_symbol").alias("symbol_id")).distinct(), "symbol_id", "left_anti").join(refs.select("symbol_id").distinct(), "symbol_id", "left_anti")


def first_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows by order, gathered by a top-k, with their place."""
    return df.orderBy(*order).limit(k).withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def potential_callers(dead_: DataFrame, symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    """dead_id, caller (symbol or token id), reason: up to three functions of the file, two entry points, two tokens of the name."""
    d = dead_.select(F.col("symbol_id").alias("dead_id"), F.col("name").alias("dname"), "file_id", F.col("start_line").alias("dline"))
    # four functions of a file are enough for any three that leave one out
    fn = symbols.where(F.col("kind").isin("function", "method")).withColumn("k", F.row_number().over(Window.partitionBy("file_id").orderBy("symbol_id"))).where("k <= 4").select("file_id", F.col("symbol_id").alias("caller"))
    per = lambda *o: F.row_number().over(Window.partitionBy("dead_id").orderBy(*o))
    same = d.join(fn, "file_id").where("caller <> dead_id").withColumn("rn", per("caller")).where("rn <= 3").select("dead_id", "caller", F.lit("same file").alias("reason"))
    firsts = F.broadcast(symbols.where("is_entry").orderBy("symbol_id").limit(2).select(F.col("symbol_id").alias("caller")))
    entry = d.join(firsts, F.col("caller") != F.col("dead_id")).select("dead_id", "caller", F.lit("entry point").alias("reason"))
    # two tokens at each of a name's first three places hold two that aren't on any one definition line
    places = F.dense_rank().over(Window.partitionBy("name").orderBy("file_id", "line"))
    named = tokens.withColumn("p", places).where("p <= 3").withColumn("q", F.row_number().over(Window.partitionBy("name", "file_id", "line").orderBy("token_id"))).where("q <= 2")
    t = d.join(named.select("name", F.col("file_id").alias("tfile"), F.col("line").alias("tline"), "token_id"), F.col("name") == F.col("dname")).where("not (tfile = file_id and tline = dline)")
    hits = t.withColumn("rn", per("tfile", "tline", "token_id")).where("rn <= 2").select("dead_id", F.col("token_id").alias("caller"), F.lit("same name").alias("reason"))
    return same.unionByName(entry).unionByName(hits)


# -- module, scope ------------------------------------------------------------


def exports(symbols: DataFrame, files: DataFrame, part: str) -> DataFrame:
    return symbols.where("is_exported").join(files.where(F.col("path").contains(part)), "file_id").select("path", "symbol_id", "name", "kind")


def imported_by(symbols: DataFrame, tokens: DataFrame, files: DataFrame, part: str) -> DataFrame:
    """path of the files outside that import a name which a file with `part` in its path exports."""
    names = exports(symbols, files, part).select("name").distinct()
    return tokens.where("kind = 'import'").join(names, "name", "left_semi").select("file_id").distinct().join(files.where(~F.col("path").contains(part)), "file_id").select("path")


def dependencies(tokens: DataFrame, files: DataFrame, part: str) -> DataFrame:
    return tokens.where("kind = 'import'").join(files.where(F.col("path").contains(part)), "file_id").select("name").distinct()


def scope(symbols: DataFrame, tokens: DataFrame, files: DataFrame, part: str, line: int) -> DataFrame:
    """role, name, defined_at of what is visible at a line of the first file whose path has `part`."""
    f = files.where(F.col("path").contains(part)).orderBy("path").limit(1).select("file_id")
    s, t = symbols.join(F.broadcast(f), "file_id"), tokens.join(F.broadcast(f), "file_id")
    at = f.select(F.lit(0).alias("token_id"), "file_id", F.lit(line).alias("line"))
    around = resolve.enclosing(at, s).select(F.col("symbol_id").alias("e_id"), F.col("name").alias("e_name"))
    own = around.join(s, F.col("symbol_id") == F.col("e_id")).select(F.lit("enclosing").alias("role"), "name", F.col("start_line").alias("defined_at"))
    before = s.where(F.col("end_line") < line).join(F.broadcast(around))
    role = F.when(F.col("kind").isin("variable", "constant"), "local").when(F.col("kind").isin("function", "method") & (F.col("name") != F.col("e_name")), "parameter")
    seen = before.withColumn("role", role).where("role is not null").select("role", "name", F.col("start_line").alias("defined_at"))
    imports = t.where("kind = 'import'").select(F.lit("import").alias("role"), "name", F.col("line").alias("defined_at"))
    return own.unionByName(seen).unionByName(imports)
