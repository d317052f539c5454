"""Lines, context windows, chunks and line patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 50, 5


def line_array(content: Column) -> Column:
    """Lines of a text: no empty line after a last line end, no carriage return at a line's end; none for an empty text."""
    parts = F.split(content, "\n", -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(content.contains("\r"), F.transform(cut, lambda x: F.regexp_replace(x, r"\r+$", ""))).otherwise(cut)


def lines(files: DataFrame) -> DataFrame:
    """file_id, line (from 1), text."""
    return files.where("content is not null").select("file_id", F.posexplode(line_array(F.col("content"))).alias("i", "text")).select("file_id", (F.col("i") + 1).alias("line"), "text")


def line_range(lines_: DataFrame, first: int, last: int) -> DataFrame:
    """Lines first to last of each file; a range beyond the end gives what is there."""
    return lines_.where(F.col("line").between(first, last))


def context(lines_: DataFrame, at: DataFrame, before: int, after: int) -> DataFrame:
    """For each (file_id, line) of `at`: the lines around it as one text in order.

    Each wanted line names the lines it needs, so this is an equi-join, however long a file is.
    """
    want = at.select("file_id", F.col("line").alias("at_line")).distinct()
    need = want.select("file_id", "at_line", F.explode(F.sequence(F.greatest(F.col("at_line") - before, F.lit(1)), F.col("at_line") + after)).alias("line"))
    got = need.join(lines_, ["file_id", "line"])
    rows = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    return got.groupBy("file_id", "at_line").agg(F.array_join(rows, "\n").alias("context"), F.count("*").alias("n_lines")).withColumnRenamed("at_line", "line")


def layout(line: Column, text: Column, hit: Column) -> Column:
    """A context row as shown: the hit line marked."""
    return F.when(hit, F.format_string("> %4d: %s", line, text)).otherwise(F.format_string("  %4d: %s", line, text))


def truncated(text: Column, most: int) -> Column:
    t = F.trim(text)
    return F.when(F.char_length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Windows of `size` lines that overlap by `overlap`: id, file_id, path, content, start_line, end_line."""
    rows = files.where("content is not null").select("file_id", "path", "language", line_array(F.col("content")).alias("xs")).where(F.size("xs") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("xs") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = rows.select("*", F.explode(starts).alias("s"))
    part = F.slice("xs", F.col("s") + 1, F.lit(size))
    out = rows.select("file_id", "path", "language", part.alias("xs"), (F.col("s") + 1).alias("start_line"), (F.col("s") + F.size(part)).alias("end_line"))
    return out.select(F.concat_ws(":", "path", "start_line", "end_line").alias("id"), "file_id", "path", "language", F.array_join("xs", "\n").alias("content"), "start_line", "end_line", F.sha2(F.array_join("xs", "\n"), 256).alias("content_hash"), "xs")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def function_name(line: Column) -> Column:
    """The name that a line declares as a function, else null."""
    t = trimmed(line)
    after = lambda head, end: trimmed(F.substring_index(F.substring(t, F.lit(len(head) + 1), F.length(t)), end, 1))
    valued = t.contains("=>") | t.contains("function")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for head in ("fn ", "function ", "def ", "func "):
        out = out.when(t.startswith(head), after(head, "("))
    out = out.when(t.rlike("^(const|let|var) ") & valued, F.regexp_replace(F.get(F.split(t, r"(?U)\s+"), 1), "[= ]+$", ""))
    out = out.when(t.startswith("export function "), after("export function ", "(")).when(t.startswith("export const ") & valued, after("export const ", "="))
    return F.nullif(out, F.lit(""))


def class_name(line: Column) -> Column:
    """The name that a line declares as a class or struct, or whose implementation it opens, else null."""
    t = trimmed(line)
    out = F.when(t.startswith("class "), F.regexp_extract(t, "^class ([^ {(:]*)", 1)).when(t.rlike("^(pub )?struct "), F.regexp_extract(t, "^(?:pub )?struct ([^ {(<]*)", 1))
    return F.nullif(out.when(t.rlike("^impl[ <]"), F.regexp_extract(t, r"(?U)^impl[<\p{L}\p{N}_,]*+>*+\s*+([^ {<]*)", 1)), F.lit(""))


def method_name(line: Column) -> Column:
    """The name that a line declares as a method, else null."""
    t = trimmed(line)
    upto = lambda x: trimmed(F.substring_index(x, "(", 1))
    out = F.when(t.contains("pub ") & t.contains("fn "), upto(F.substring(t, F.locate("fn ", t) + 3, F.length(t))))
    return F.nullif(out.when(t.startswith("async "), upto(F.substring(t, F.lit(7), F.length(t)))), F.lit(""))


def chunk_symbol(xs: Column) -> Column:
    """struct(name, type) of the first line in a chunk that declares something; null if none does."""

    def of(line: Column) -> Column:
        f, c, m = function_name(line), class_name(line), method_name(line)
        return F.when(f.isNotNull(), F.struct(f.alias("name"), F.lit("function").alias("type"))).when(c.isNotNull(), F.struct(c.alias("name"), F.lit("class").alias("type"))).when(m.isNotNull(), F.struct(m.alias("name"), F.lit("method").alias("type")))

    return F.get(F.filter(F.transform(xs, of), lambda x: x.isNotNull()), F.lit(0))


def pattern(lines_: DataFrame, regex: str) -> DataFrame:
    """file_id, line, col (bytes before the first match), matched, of every line that matches."""
    at = F.regexp_instr("text", F.lit(regex))
    hit = lines_.where(F.col("text").rlike(regex))
    return hit.select("file_id", "line", F.octet_length(F.substring(F.col("text"), F.lit(1), at - 1)).alias("col"), F.regexp_substr("text", F.lit(regex)).alias("matched"))


def enclosing_block(lines_: DataFrame, at: DataFrame, most: int = 60) -> DataFrame:
    """file_id, line, first, last of the brace block around each wanted line, sought within most / 2 lines on both sides.

    Upward, the block begins at the line that opens at least as many braces as were closed on the way; downward,
    it ends at the line that closes as many as were opened. Where none does so nearby, the search's last line counts,
    and the wanted line itself at the file's ends.
    """
    half = most // 2
    want = at.select("file_id", F.col("line").alias("at_line")).distinct()
    need = want.select("file_id", "at_line", F.explode(F.sequence(F.greatest(F.col("at_line") - half - 1, F.lit(1)), F.col("at_line") + half + 1)).alias("line"))
    rows = need.join(lines_, ["file_id", "line"]).select("file_id", "at_line", "line", F.regexp_count("text", F.lit(r"\{")).alias("o"), F.regexp_count("text", F.lit(r"\}")).alias("c"))
    near = rows.groupBy("file_id", "at_line").agg(F.array_sort(F.collect_list(F.struct("line", "o", "c"))).alias("xs"))
    state = "struct<depth:int,line:int>"
    none = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("line")).cast(state)

    def step(more: str, less: str, ends: str):
        def take(s: Column, x: Column) -> Column:
            d = s["depth"] + x[more] - x[less]
            done = ((d <= 0) & (x[ends] > 0)) | (F.abs(x["line"] - F.col("at_line")) > half)
            return F.when(s["line"].isNotNull(), s).otherwise(F.struct(d.alias("depth"), F.when(done, x["line"]).alias("line")).cast(state))

        return take

    up, down = F.filter("xs", lambda x: x["line"] <= F.col("at_line")), F.filter("xs", lambda x: x["line"] >= F.col("at_line"))
    first, last = F.aggregate(F.reverse(up), none, step("c", "o", "o"))["line"], F.aggregate(down, none, step("o", "c", "c"))["line"]
    here = F.exists("xs", lambda x: x["line"] == F.col("at_line"))  # no block around a line that isn't there
    return near.where(here).select("file_id", F.col("at_line").alias("line"), F.coalesce(first, F.col("at_line")).alias("first"), F.coalesce(last, F.col("at_line")).alias("last"))
