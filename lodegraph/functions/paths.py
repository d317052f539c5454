"""Paths: extensions, languages, ignore rules, project markers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extensions that are searched, and the languages they name.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python",
    "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "rb": "ruby", "php": "php", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang",
    "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "lua": "lua", "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "vue": "vue", "svelte": "svelte",
    "md": "markdown", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json",
}
# The extensions that the code graph knows, and the languages they name.
TRACE_LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "java": "java", "rb": "ruby",
    "php": "php", "swift": "swift", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "lua": "lua", "sh": "bash", "bash": "bash", "zsh": "bash", "json": "json",
    "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "css": "css", "scss": "css", "sass": "css", "less": "css",
    "sql": "sql", "zig": "zig", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell", "lhs": "haskell", "ml": "ocaml", "mli": "ocaml",
    "scala": "scala", "sc": "scala", "clj": "clojure", "cljs": "clojure", "cljc": "clojure", "v": "verilog", "vh": "verilog", "svelte": "svelte", "vue": "vue",
}
# Searched by the library's walk, not by the index command's.
DOCUMENTS = ("md", "yaml", "yml", "toml", "json")
# Ignored unless told otherwise.
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", "*.min.js", "*.map")
# Files that mark the root of a project, in order of priority, and the type that they name. The engine's own mark stands first.
MARKERS = {
    ".lodegraph": "lodegraph", ".git": "git", "package.json": "nodejs", "Cargo.toml": "rust", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "pom.xml": "java", "build.gradle": "java",
    "Gemfile": "ruby", "composer.json": "php", "mix.exs": "elixir", "deno.json": "deno", "bun.lockb": "bun",
}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _map(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def language(path: Column) -> Column:
    return F.coalesce(_map(LANGUAGES, extension(path)), F.lit("unknown"))


def trace_language(path: Column) -> Column:
    return F.coalesce(_map(TRACE_LANGUAGES, extension(path)), F.lit("unknown"))


def indexable(path: Column, documents: bool = True) -> Column:
    """Whether a file is walked; documents and data files are part of one of the two lists only."""
    return extension(path).isin(*[x for x in LANGUAGES if documents or x not in DOCUMENTS])


def ignored(path: Column, patterns: list[str] | tuple[str, ...] = IGNORED) -> Column:
    """A pattern ignores a path that contains it, its outer stars aside."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.contains(p.strip("*"))
    return hit


HIDDEN = re.compile(r"(^|/)\.[^/.]")


def hidden(path: Column) -> Column:
    return path.rlike(HIDDEN.pattern)


def project_types(entries: DataFrame) -> DataFrame:
    """dir, kind of each directory (dir, name) with a marker, by the first marker in priority."""
    order = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(MARKERS) for x in (k, i)]), F.col("name"))
    rows = entries.withColumn("p", order).where("p is not null")
    return rows.groupBy("dir").agg(F.min_by(_map(MARKERS, F.col("name")), F.col("p")).alias("kind"))


def project_roots(files: DataFrame) -> DataFrame:
    """path, root: the nearest directory above each path that holds a marker."""
    dirs = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))
    roots = dirs.where(F.col("name").isin(*MARKERS)).select("dir").distinct().withColumnRenamed("dir", "root")
    parts = F.split("dir", "/")
    up = dirs.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("root"))
    return up.join(roots, "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
