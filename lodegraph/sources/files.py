"""Source trees as tables: walking, ignore rules, stored indexes, registries."""

from __future__ import annotations

import fnmatch
import json
import os
import re

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..session import stored

LARGEST = 1 << 20
IGNORE_FILE = ".gitignore"


def numbered(paths_: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, file_id of every path: the ids that are known, and the next free ones, in the order of paths, for the others.

    Paths are sorted by ranges; an id is a path's place in its range behind the ranges before, whose sizes
    are a row each. Numbers don't collide, and a path keeps its number when others come and go.
    """
    new = paths_.select("path").distinct()
    first = 0
    if known is not None:
        new = new.join(known.select("path"), "path", "left_anti")
        most = known.agg(F.max("file_id").alias("m")).first().m
        first = 0 if most is None else most + 1
    placed = stored(new.repartitionByRange("path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id()), "paths")
    placed = placed.select("path", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = placed.join(F.broadcast(before), "part").select("path", (F.lit(first) + F.col("before") + F.col("place")).cast("long").alias("file_id"))
    if known is not None:
        out = out.unionByName(known.join(paths_.select("path").distinct(), "path", "left_semi").select("path", F.col("file_id").cast("long").alias("file_id")))
    return out


def unlisted(root: str) -> tuple[list[tuple[str, int]], str]:
    """Files that Spark's readers leave out, names or folders with a leading underscore, and ignore files: path below root and length; and root as a URI.

    Listed by the driver, where pyarrow knows the file system.
    """
    uri = root if re.match(r"[a-z0-9]+:", root) else "file://" + os.path.abspath(root)
    uri = re.sub(r"^file:/+", "file:///", uri).rstrip("/")
    try:
        store, base = pafs.FileSystem.from_uri(uri)
        found = [(x.path[len(base) :].lstrip("/"), x.size) for x in store.get_file_info(pafs.FileSelector(base, recursive=True)) if x.is_file]
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return [], uri
    special = lambda p: p.rpartition("/")[2] == IGNORE_FILE or (any(x.startswith("_") for x in p.split("/")) and not paths.HIDDEN.search(p))
    return [(p, n) for p, n in found if special(p)], uri


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), length, content of all files; content is read only where it is used."""
    base = re.sub(r"^[a-z0-9]+:/+", "/", root.rstrip("/"))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    seen = raw.select(F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/"), "^" + re.escape(base) + "/", "").alias("path"), "length", "content")
    more, uri = unlisted(root)
    if not more:
        return seen

    def read(batches):
        store, at = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{at}/{p}") as f:
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([n], pa.int64()), pa.array([f.read()], pa.binary())], names=["path", "length", "content"])

    return seen.unionByName(spark.createDataFrame(more, "path string, length long").mapInArrow(read, "path string, length long, content binary"))


def ignore_files(spark: SparkSession, root: str, name: str = IGNORE_FILE) -> dict[str, str]:
    """The ignore files of a tree: folder below root (empty for root itself) and rules."""
    rows = listing(spark, root).where((F.col("path") == name) | F.col("path").endswith("/" + name)).select("path", F.col("content").cast("string").alias("text")).collect()
    return {r.path[: -len(name)].rstrip("/"): r.text or "" for r in rows}


def walk(spark: SparkSession, root: str, largest: int = LARGEST, documents: bool = True, ignore: tuple[str, ...] = (), rules: str | dict[str, str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """file_id, path (below root), language, content of the files that are indexed.

    Hidden files, files over `largest` bytes, other extensions, what `ignore` or the rules of ignore
    files (by folder, such as ignore_files gives them) cover, and files that aren't UTF-8 are left out.
    Size is tested on the listing, before any content is read. Paths in known (path, file_id) keep their ids.
    """
    path = F.col("path")
    kept = listing(spark, root).where(F.col("length") <= largest).where(paths.indexable(path, documents) & ~paths.hidden(path) & ~paths.ignored(path, ignore))
    if rules:
        kept = kept.where(~ignored_by({"": rules} if isinstance(rules, str) else rules, path))
    kept = kept.withColumn("text", F.try_validate_utf8(F.col("content").cast("string")))
    return kept.where("text is not null").join(numbered(kept.select("path"), known), "path").select("file_id", "path", paths.language(path).alias("language"), F.col("text").alias("content"))


def rule_pattern(rule: str) -> tuple[bool, str] | None:
    """(negated, regex) of a line of an ignore file; null for blank lines and comments."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated, rule = rule.startswith("!"), rule.removeprefix("!")
    directory, rule = rule.endswith("/"), rule.rstrip("/")
    anchored, rule = "/" in rule, rule.lstrip("/")
    body = ""
    for part in re.split(r"(\*\*/|/\*\*|\*\*)", rule):
        body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*"}.get(part) or fnmatch.translate(part).removeprefix("(?s:").replace(r")\Z", "").replace(r")\z", "").replace(".*", "[^/]*")
    return negated, ("^" if anchored else "(?:^|.*/)") + body + ("/.*$" if directory else "(?:/.*)?$")


def ignored_by(rules: dict[str, str], path):
    """Whether the rules of ignore files, by folder, cover a path; the last rule that matches decides, deeper folders after the ones above."""
    out = F.lit(False)
    for folder in sorted(rules, key=lambda d: (d.count("/") + bool(d), d)):
        below = path if not folder else F.substring(path, F.lit(len(folder) + 2), F.length(path))
        here = F.lit(True) if not folder else path.startswith(folder + "/")
        for found in filter(None, map(rule_pattern, rules[folder].split("\n"))):
            out = F.when(here & below.rlike(found[1]), F.lit(not found[0])).otherwise(out)
    return out


TABLES = ("files", "symbols", "tokens", "refs", "edges", "scopes", "chunks")


def save(index: dict[str, DataFrame], folder: str) -> None:
    """An index as Parquet tables; a rebuild replaces what was there."""
    for name, df in index.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a stored index; raises where none is there."""
    from pyspark.errors import AnalysisException

    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}")
        except AnalysisException:
            continue
    if "symbols" not in out and "chunks" not in out:
        raise FileNotFoundError(f"no index in {folder}")
    return out


def project_root(start: str) -> str | None:
    """The nearest folder at or above `start` with a marker of a project."""
    at = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(at, m)) for m in paths.MARKERS):
            return at
        if os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def project_type(root: str) -> str:
    return next((kind for marker, kind in paths.MARKERS.items() if os.path.exists(os.path.join(root, marker))), "unknown")


# Folders in which no project is sought.
SKIPPED = ("node_modules", "target", "dist", "build", "__pycache__", "venv", ".venv", "vendor")


def discover(folders: list[str], depth: int = 3, skip: tuple[str, ...] = SKIPPED, active: tuple[str, ...] = ()) -> list[dict]:
    """Projects below some folders: name, path, kind, active; the active ones first, then by name without case."""
    found: dict[str, dict] = {}

    def look(at: str, left: int) -> None:
        try:
            entries = sorted(os.scandir(at), key=lambda e: e.name)
        except OSError:
            return
        if any(e.name in paths.MARKERS for e in entries):
            found[at] = {"name": os.path.basename(at), "path": at, "kind": project_type(at), "active": at in active}
        for e in entries:
            if left and e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in skip:
                look(e.path, left - 1)

    for f in folders:
        look(os.path.abspath(f), depth)
    return sorted(found.values(), key=lambda p: (not p["active"], p["name"].lower()))


class Registry:
    """Projects in a JSON file: remember, forget, list the newest first."""

    def __init__(self, path: str, keep: int = 10):
        self.path, self.keep = path, keep

    def read(self) -> list[dict]:
        try:
            with open(self.path) as f:
                return json.load(f)
        except (OSError, ValueError):
            return []

    def _write(self, rows: list[dict]) -> list[dict]:
        with open(self.path, "w") as f:
            json.dump(rows, f, indent=1)
        return rows

    def remember(self, project: dict) -> list[dict]:
        return self._write([project, *[p for p in self.read() if p["path"] != project["path"]]][: self.keep])

    def forget(self, path: str) -> list[dict]:
        return self._write([p for p in self.read() if p["path"] != path])
