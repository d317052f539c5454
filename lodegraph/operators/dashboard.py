"""Roll-ups and tables of the dashboard: lists, file graph, path trees, health, roles, matrix."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import graph, trace


def _counts(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("symbol_id")).agg(F.count("*").alias(name))


def symbol_rows(symbols: DataFrame, edges: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Every symbol with refs, callers, callees (call sites), dead, path."""
    d = trace.dead(symbols, edges, refs).select("symbol_id", F.lit(True).alias("dead"))
    out = symbols.join(files.select("file_id", "path"), "file_id")
    for t in (_counts(refs, "symbol_id", "refs"), _counts(edges, "to_symbol", "callers"), _counts(edges, "from_symbol", "callees"), d):
        out = out.join(t, "symbol_id", "left")
    return out.na.fill(0, ["refs", "callers", "callees"]).na.fill(False, ["dead"])


def with_cycles(rows: DataFrame, cycles: DataFrame) -> DataFrame:
    """Rows with in_cycle: whether a symbol's file is in a cycle of files."""
    c = cycles.select(F.col("node").alias("file_id"), F.lit(True).alias("in_cycle")).distinct()
    return rows.join(c, "file_id", "left").na.fill(False, ["in_cycle"])


def symbol_list(rows: DataFrame, kind: str | None = None, state: str | None = None, search: str | None = None, limit: int = 200) -> DataFrame:
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if state in ("dead", "used"):
        rows = rows.where(F.col("dead") == (state == "dead"))
    if search:
        rows = rows.where(F.lower("name").contains(search.lower()))
    return rows.orderBy("symbol_id").limit(min(limit, 1000))


def cross_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """from_file, to_file of every call site between two files."""
    s = symbols.select("symbol_id", "file_id")
    a, b = s.toDF("from_symbol", "from_file"), s.toDF("to_symbol", "to_file")
    return edges.join(a, "from_symbol").join(b, "to_symbol").where("from_file <> to_file").select("from_file", "to_file")


def file_nodes(rows: DataFrame, cross: DataFrame, cycles: DataFrame, limit: int = 100, state: str | None = None) -> DataFrame:
    """A row for each file with symbols: symbols, dead, imports, exports, in_cycle; with dead ones or in a cycle only, if a state says so; the largest `limit`."""
    n = rows.groupBy("file_id", "path").agg(F.count("*").alias("symbols"), F.count_if("dead").alias("dead"), F.count_if("is_entry").alias("exports"))
    i = cross.groupBy(F.col("from_file").alias("file_id")).agg(F.count("*").alias("imports"))
    c = cycles.select(F.col("node").alias("file_id"), F.lit(True).alias("in_cycle"))
    out = n.join(i, "file_id", "left").join(c, "file_id", "left").na.fill(0, ["imports"]).na.fill(False, ["in_cycle"])
    out = out.where("dead > 0") if state == "dead" else out.where("in_cycle") if state == "cycle" else out
    return out.orderBy(F.desc("symbols"), "file_id").limit(limit)


def file_links(cross: DataFrame, nodes: DataFrame) -> DataFrame:
    """from_file, to_file, weight among the given nodes."""
    e = cross.groupBy("from_file", "to_file").agg(F.count("*").alias("weight"))
    return e.join(nodes.select(F.col("file_id").alias("from_file")), "from_file", "left_semi").join(nodes.select(F.col("file_id").alias("to_file")), "to_file", "left_semi")


def prefixes(path: Column) -> Column:
    """All directories above a path and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def rollup(rows: DataFrame, cycles: DataFrame, base: str | None = None) -> DataFrame:
    """path, depth, value, dead, files, in_cycle, health of every directory and file: sums by file, then by prefix."""
    per = rows.groupBy("file_id", "path").agg(F.count("*").alias("value"), F.count_if("dead").alias("dead"))
    per = per.join(cycles.select(F.col("node").alias("file_id"), F.lit(True).alias("in_cycle")), "file_id", "left").na.fill(False, ["in_cycle"])
    if base:
        per = per.where((F.col("path") == base) | F.col("path").startswith(base.rstrip("/") + "/"))
    up = per.select(F.explode(prefixes(F.col("path"))).alias("path"), "value", "dead", "in_cycle")
    out = up.groupBy("path").agg(F.sum("value").alias("value"), F.sum("dead").alias("dead"), F.count("*").alias("files"), F.bool_or("in_cycle").alias("in_cycle"))
    return out.select("path", F.size(F.split("path", "/")).alias("depth"), "value", "dead", "files", "in_cycle", F.floor(100 * (F.col("value") - F.col("dead")) / F.col("value")).alias("health"))


def totals(rows: DataFrame, cycles: DataFrame) -> DataFrame:
    """files, symbols, dead, cycle_files, health over everything, in one pass."""
    f = with_cycles(rows, cycles)
    out = f.agg(F.count_distinct("file_id").alias("files"), F.count("*").alias("symbols"), F.count_if("dead").alias("dead"), F.count_distinct(F.when(F.col("in_cycle"), F.col("file_id"))).alias("cycle_files"))
    return out.withColumn("health", F.floor(100 * (F.col("symbols") - F.col("dead")) / F.col("symbols")))


def nested(rows: list[dict], root: str = "") -> list[dict]:
    """Roll-up rows as a tree: directories first, then by name without case. For output on the driver."""
    by_parent: dict[str, list[dict]] = {}
    for r in rows:
        by_parent.setdefault(r["path"].rpartition("/")[0], []).append(r)

    def under(path: str) -> list[dict]:
        own = [{**r, "name": r["path"].rpartition("/")[2], "children": under(r["path"])} for r in by_parent.get(path, [])]
        return sorted(own, key=lambda r: (not r["children"], r["name"].lower()))

    return under(root)


def health(rows: DataFrame, worst: int = 5, least: int = 3) -> DataFrame:
    """The worst files of `least` symbols or more by the share of live symbols."""
    f = rows.groupBy("path").agg(F.count("*").alias("total"), F.count_if("dead").alias("dead")).where(F.col("total") >= least)
    pct = F.floor(100 * (F.col("total") - F.col("dead")) / F.col("total") + 0.5).cast("long")
    cls = F.when(F.col("pct") >= 70, "good").when(F.col("pct") >= 40, "fair").otherwise("poor")
    return f.withColumn("pct", pct).withColumn("class", cls).orderBy("pct", "path").limit(worst)


def connections(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """from, to, kind, count, files: links between two names and the files they stand in. Links without a kind are calls."""
    kind = F.col("kind") if "kind" in edges.columns else F.lit("call")
    e = edges.select("from_symbol", "to_symbol", kind.alias("kind"))
    a, b = symbols.select(F.col("symbol_id").alias("from_symbol"), F.col("name").alias("from"), "file_id"), symbols.select(F.col("symbol_id").alias("to_symbol"), F.col("name").alias("to"))
    return e.join(a, "from_symbol").join(b, "to_symbol").groupBy("from", "to", "kind").agg(F.count("*").alias("count"), F.count_distinct("file_id").alias("files"))


def loose_connections(rows: DataFrame) -> DataFrame:
    """The connections where no links are known: from, to, kind, count, files by the first symbol of each name that has callers or callees."""
    r = rows.where("callers > 0 or callees > 0").groupBy("name").agg(F.min_by(F.col("callers") + F.col("callees"), "symbol_id").alias("count"))
    return r.select(F.col("name").alias("from"), F.lit("(various)").alias("to"), F.lit("reference").alias("kind"), "count", F.lit(1).cast("long").alias("files"))


def sorted_table(df: DataFrame, column: str, numeric: bool, descending: bool = False, key: str = "symbol_id") -> DataFrame:
    """Rows by a column, numbers as such and text without case, ties by key."""
    c = F.col(column) if numeric else F.lower(F.col(column).cast("string"))
    return df.orderBy(c.desc() if descending else c.asc(), key)


def matrix(cross: DataFrame, nodes: DataFrame, first: int = 40) -> DataFrame:
    """a, b, w: symmetric weights between the first `first` nodes of the file graph, in its order (most symbols, then id)."""
    kept = F.broadcast(nodes.orderBy(F.desc("symbols"), "file_id").limit(first).select("file_id"))  # at most `first` rows
    e = cross.join(kept.withColumnRenamed("file_id", "from_file"), "from_file", "left_semi").join(kept.withColumnRenamed("file_id", "to_file"), "to_file", "left_semi")
    e = e.groupBy("from_file", "to_file").agg(F.count("*").alias("w"))
    both = e.toDF("a", "b", "w").unionByName(e.toDF("b", "a", "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def roles(cross: DataFrame, most: int = 20) -> DataFrame:
    """file, role, n_in, n_out: entry, internal or leaf by degrees; the `most` busiest of each role."""
    e = cross.distinct()
    d = e.select(F.col("from_file").alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("to_file").alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = d.groupBy("file").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    role = F.when((F.col("n_in") == 0) & (F.col("n_out") > 0), "entry").when((F.col("n_out") == 0) & (F.col("n_in") > 0), "leaf").otherwise("internal")
    w = Window.partitionBy("role").orderBy(F.desc(F.col("n_in") + F.col("n_out")), "file")
    return d.withColumn("role", role).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).select("file", "role", "n_in", "n_out")


COLUMNS = ("entry", "internal", "leaf")


def role_links(cross: DataFrame, kept: DataFrame) -> DataFrame:
    """from_file, to_file, weight between kept files (file, role) whose roles stand beside each other."""
    at = F.array_position(F.array(*map(F.lit, COLUMNS)), F.col("role"))
    k = kept.select("file", at.alias("at"))
    e = cross.groupBy("from_file", "to_file").agg(F.count("*").alias("weight"))
    both = e.join(k.toDF("from_file", "x"), "from_file").join(k.toDF("to_file", "y"), "to_file")
    return both.where(F.abs(F.col("x") - F.col("y")) == 1).select("from_file", "to_file", "weight")


def severity(size: Column) -> Column:
    return F.when(size > 5, "critical").when(size > 3, "high").otherwise("medium")


def cycles_table(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """component, size, severity, members, display (first symbol of each file), largest first."""
    first = symbols.groupBy("file_id").agg(F.min_by("name", "symbol_id").alias("shown"))
    rows = found.join(first, found["node"] == first["file_id"])
    m = F.array_sort(F.collect_list(F.struct("node", "shown")))
    out = rows.groupBy("component").agg(F.count("*").alias("size"), m.alias("m"))
    return out.select("component", "size", severity(F.col("size")).alias("severity"), F.array_join(F.transform("m", lambda x: x["node"].cast("string")), ",").alias("members"), F.array_join(F.transform("m", lambda x: x["shown"]), ",").alias("display"))


def ordered_cycles(table: DataFrame, by: str = "size") -> DataFrame:
    """Rows of cycles_table by size, number of files, or the first symbol's name."""
    first = F.substring_index("display", ",", 1)
    order = {"size": F.desc("size"), "files": F.desc(F.size(F.array_distinct(F.split("members", ",")))), "alpha": F.lower(first).asc()}[by]
    return table.orderBy(order, "component")


def detail(refs: DataFrame, tokens: DataFrame, symbol_id: int, most: int = 20) -> DataFrame:
    """kind, n, files: the first `most` references to a symbol by kind, and the files that all of its references of the kind stand in."""
    r = refs.where(F.col("symbol_id") == symbol_id).select("token_id", F.col("kind").alias("rkind")).join(tokens.select("token_id", "file_id", "line"), "token_id")
    files = r.groupBy("rkind").agg(F.count_distinct("file_id").alias("files"))
    return r.orderBy("file_id", "line", "token_id").limit(most).groupBy("rkind").agg(F.count("*").alias("n")).join(files, "rkind").select(F.col("rkind").alias("kind"), "n", "files")


# -- query language -----------------------------------------------------------

KINDS = {"function", "method", "class", "struct", "enum", "interface", "type", "constant", "variable", "module"}


def glob(pattern: str) -> str:
    """A path glob as an anchored regex, without case."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        else:
            out += {"*": "[^/]*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return "(?i)^" + out


def parse(query: str) -> dict:
    """Filters of the dashboard's search line; unknown kinds and states are ignored, the rest is free text."""
    f: dict = {"text": []}
    for word in query.split():
        key, colon, value = word.partition(":")
        if not colon:
            f["text"].append(word)
        elif key in ("kind", "type"):
            if value.lower() in KINDS:
                f.setdefault("kinds", []).append(value.lower())
        elif key == "state":
            if value in ("dead", "used", "cycle", "entry"):
                f["state"] = value
        elif key == "file":
            f["file"] = value
        elif key in ("refs", "callers", "callees") and (m := re.fullmatch(r"([<>]?)(\d+)", value)):
            low, high = (int(m[2]), None) if m[1] == ">" else (None, int(m[2])) if m[1] == "<" else (int(m[2]), int(m[2]))
            f[key] = (low or None, high)
        elif key == "entry":
            f["entry"] = value in ("true", "yes", "1")
        elif key == "has" and value in ("callers", "callees", "refs"):
            f[value] = (1, None)
        else:
            f["text"].append(word)
    f["text"] = " ".join(f["text"])
    return f


# Search lines that are kept ready.
PRESETS = {"dead": "state:dead", "cycles": "state:cycle", "entry points": "entry:true", "most used": "refs:>10"}


def to_query(f: dict) -> str:
    """The search line of filters, as parse() gives them. Upper bounds of references and entry:false have no form, and go."""
    out = [f"kind:{k}" for k in f.get("kinds", [])]
    out += [f"state:{f['state']}"] if f.get("state") else []
    out += [f"file:{f['file']}"] if f.get("file") else []
    low, high = f.get("refs", (None, None))
    out += [f"refs:{low}"] if low is not None and low == high else [f"refs:>{low}"] if low is not None else []
    for key in ("callers", "callees"):
        if f.get(key, (None, None))[0]:
            out.append(f"has:{key}")
    out += ["entry:true"] if f.get("entry") else []
    return " ".join([*out, f["text"]] if f.get("text") else out)


def matching(rows: DataFrame, query: str) -> DataFrame:
    """Symbol rows that a search line selects. `>n` means n or more, `<n` n or fewer; state:cycle needs a column in_cycle."""
    f = parse(query)
    if f["text"]:
        t = f["text"].lower()
        rows = rows.where(F.lower("name").contains(t) | F.lower("path").contains(t))
    if f.get("kinds"):
        rows = rows.where(F.col("kind").isin(*f["kinds"]))
    if f.get("state") == "dead":
        rows = rows.where(F.col("dead") | (F.col("refs") == 0))
    elif f.get("state") == "used":
        rows = rows.where(~F.col("dead") & (F.col("refs") > 0))
    elif f.get("state") == "cycle":
        rows = rows.where(F.col("in_cycle"))
    elif f.get("state") == "entry":
        rows = rows.where(F.col("is_entry"))
    if f.get("file"):
        rows = rows.where(F.col("path").rlike(glob(f["file"])))
    for key in ("refs", "callers", "callees"):
        low, high = f.get(key, (None, None))
        if low is not None:
            rows = rows.where(F.col(key) >= low)
        if high is not None:
            rows = rows.where(F.col(key) <= high)
    if "entry" in f:
        rows = rows.where(F.col("is_entry") == f["entry"])
    return rows


def files_table(rows: DataFrame, cycles: DataFrame) -> DataFrame:
    c = cycles.select(F.col("node").alias("file_id"), F.lit(1).alias("c"))
    out = rows.join(c, "file_id", "left")
    return out.groupBy("path").agg(F.count("*").alias("symbols"), F.sum("refs").alias("refs_in"), F.sum("callees").alias("refs_out"), F.count_if("is_entry").alias("entries"), F.count_if("dead").alias("dead"), F.count("c").alias("in_cycle"))


def entry_table(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("is_entry") | ((F.col("callers") == 0) & (F.col("refs") == 0)))


# -- display ------------------------------------------------------------------

# Paths that are hidden while others look on.
SECRET = (".env*", "*secret*", "*credential*", "**/config/production.*", "**/*.pem", "**/*.key", "**/secrets/**", "**/.aws/**", "**/.ssh/**")


def whole_glob(pattern: str) -> str:
    """A glob over whole paths as a regex: stars cross folders, `**/` stands for any number of them."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i] == "*":
            out, i = out + ".*", i + 1
        else:
            out, i = out + ("." if pattern[i] == "?" else re.escape(pattern[i])), i + 1
    return f"^{out}$"


def redacted(path: Column, patterns: tuple[str, ...] = SECRET, on: bool = True) -> Column:
    """Names of files that a pattern covers, or whose path holds one without its outer stars, hidden; the folder and the extension stay."""
    if not on:
        return path
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(whole_glob(p))
        if core := p.strip("*").lower():
            hit = hit | F.lower(path).contains(core)
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.when(hit, F.concat(folder, F.lit("[HIDDEN]"), F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))).otherwise(path)


def short_path(path: Column) -> Column:
    """The last two parts of a path of more than three."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 3, F.concat(F.lit(".../"), F.array_join(F.slice(parts, F.lit(-2), F.lit(2)), "/"))).otherwise(path)


def short_label(name: Column, pixels: int) -> Column:
    """A label that fits a width, at six pixels a character; nothing where fewer than four characters fit."""
    n = pixels // 6
    return F.when(F.char_length(name) <= n, name).otherwise(F.lit("") if n <= 3 else F.concat(F.substring(name, 1, n - 2), F.lit("..")))


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def clamped(graph_nodes: Column, list_items: Column) -> tuple[Column, Column]:
    return F.least(F.greatest(graph_nodes, F.lit(10)), F.lit(500)), F.least(F.greatest(list_items, F.lit(50)), F.lit(2000))


def file_components(edges: DataFrame) -> DataFrame:
    return graph.components(edges)
