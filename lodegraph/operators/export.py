"""Results as JSON, CSV, DOT, Markdown and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def csv_cell(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_rows(df: DataFrame) -> DataFrame:
    """Rows as CSV lines, without a header."""
    return df.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in df.columns]).alias("value"))


# The columns of each analysis' CSV form.
HEADERS = {
    "trace": ("path_num", "entry_point", "entry_kind", "step", "symbol", "file", "line"),
    "refs": ("file", "line", "column", "kind", "context", "enclosing_symbol"),
    "dead": ("name", "kind", "file", "line", "reason"),
    "flow": ("path", "step", "variable", "action", "file", "line", "expression"),
    "impact": ("type", "value"),
    "module": ("type", "value"),
    "pattern": ("file", "line", "column", "matched_text", "context"),
    "scope": ("type", "name", "kind", "defined_at"),
    "stats": ("metric", "value"),
}


def table_of(operation: str, df: DataFrame) -> DataFrame:
    """A result in the columns of its CSV form: missing ones are empty, contexts are cut to their first line. One row of totals turns into rows of two columns."""
    head = HEADERS[operation]
    if len(head) == 2 and not set(head) <= set(df.columns):
        pairs = F.array(*[F.struct(F.lit(c).alias(head[0]), F.col(c).cast("string").alias(head[1])) for c in df.columns])
        return df.select(F.inline(pairs))
    one = lambda c: F.trim(F.substring_index(F.coalesce(F.col(c), F.lit("")), "\n", 1)).alias(c) if c in ("context", "expression") else F.col(c)
    return df.select(*[one(c) if c in df.columns else F.lit("").alias(c) for c in head])


def csv_text(operation: str, df: DataFrame, limit: int = 10_000) -> str:
    """The CSV form of the first `limit` rows of a result, with its header, for display; csv_rows() writes results of any size."""
    t = table_of(operation, df)
    return "\n".join([",".join(t.columns), *[r.value for r in csv_rows(t.limit(limit)).collect()], ""])


TITLES = {"trace": "TRACE", "refs": "REFS", "dead": "DEAD CODE ANALYSIS", "flow": "DATA FLOW", "impact": "IMPACT ANALYSIS", "module": "MODULE", "pattern": "PATTERN", "scope": "SCOPE AT", "stats": "CODEBASE STATISTICS"}


def plain_text(operation: str, df: DataFrame, subject: str = "", limit: int = 1000) -> str:
    """A result as plain text for display: a title, a rule, and a line for each of the first `limit` rows; files stand above their rows."""
    t = table_of(operation, df)
    rows = [r.asDict() for r in t.limit(limit).collect()]
    out, last = [TITLES[operation] + (f": {subject}" if subject else ""), f"Found: {len(rows)}", "-" * 60], None
    for r in rows:
        if "file" in r and r["file"] != last:
            last = r["file"]
            out += ["", f"{last}:"]
        cells = [str(v) for k, v in r.items() if k not in ("file", "line", "column") and v not in (None, "")]
        place = ":".join(str(r[k]) for k in ("line", "column") if r.get(k) not in (None, ""))
        out.append("  " + " ".join([*([place] if place else []), *cells]))
    return "\n".join(out) + "\n"


def boxed(operation: str, df: DataFrame, subject: str = "", width: int = 78, limit: int = 1000) -> str:
    """plain_text in a box of lines; long lines are cut for the eye, with dots."""
    fit = lambda x: x[: width - 3] + "..." if len(x) > width else x.ljust(width)
    lines = plain_text(operation, df, subject, limit).rstrip("\n").split("\n")
    return "\n".join(["╔" + "═" * width + "╗", *["║" + fit(x) + "║" for x in lines], "╚" + "═" * width + "╝"]) + "\n"


def dot_rows(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Edge lines of a DOT graph."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q(a), F.lit(" -> "), q(b), F.lit(";")).alias("value"))


def dot(edges: DataFrame, a: str, b: str, limit: int = 1000) -> str:
    """A DOT graph of the first `limit` edges, for display."""
    rows = dot_rows(edges.select(a, b).distinct().orderBy(a, b).limit(limit), a, b).collect()
    return "\n".join(["digraph trace {", *[r.value for r in rows], "}"])


def markdown_rows(df: DataFrame) -> DataFrame:
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of the first `limit` rows, for display."""
    rows = markdown_rows(df.limit(limit)).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *[r.value for r in rows]])


def chain_text(names: Column) -> Column:
    return F.array_join(names, " -> ")


def preview(content: Column, lines: int = 3, width: int = 80) -> Column:
    """The first lines of a hit, each cut to a width in characters."""
    first = F.slice(F.split(content, "\n"), F.lit(1), F.lit(lines))
    return F.array_join(F.transform(first, lambda x: F.when(F.char_length(x) > width, F.concat(F.substring(x, 1, width - 3), F.lit("..."))).otherwise(x)), "\n")
