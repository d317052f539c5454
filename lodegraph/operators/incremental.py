"""Updates of the text index and of the code graph by changed and deleted files.

The result equals a full build of the files as they are now: rows of touched files
are replaced, and call edges and references are resolved anew for the names that
touched files define or used to define, and for the calls that they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract, lines, resolve


def replace_files(files: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """files after (path, language, content, file_id) rows of changed and paths of deleted."""
    touched = changed.select("path").unionByName(deleted.select("path")).distinct()
    return files.join(touched, "path", "left_anti").select(*files.columns).unionByName(changed.join(deleted.select("path"), "path", "left_anti").select(*files.columns))


def update_chunks(chunks: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The chunk table without touched paths, with the chunks of changed files."""
    touched = changed.select("path").unionByName(deleted.select("path")).distinct()
    new = lines.chunks(changed.join(deleted.select("path"), "path", "left_anti"))
    return chunks.join(touched, "path", "left_anti").select(*chunks.columns).unionByName(new.select(*chunks.columns))


def update_graph(index: dict[str, DataFrame], changed: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """symbols, tokens, refs, edges after files changed (file_id, path, language, content) and went (file_id)."""
    touched = changed.select("file_id").unionByName(gone.select("file_id")).distinct()
    new = extract.build(changed.join(gone.select("file_id"), "file_id", "left_anti"))
    left = resolve.without_files(touched, index["symbols"], index["tokens"], index["refs"], index["edges"])
    symbols = left["symbols"].unionByName(new["symbols"])
    tokens = left["tokens"].unionByName(new["tokens"])
    # new names may be called from anywhere, calls of touched files may go anywhere
    names = new["symbols"].select("name").distinct()
    calls_in = left["tokens"].join(names, "name", "left_semi")
    fresh = new["symbols"]
    edges = left["edges"].unionByName(_edges(calls_in, fresh, symbols)).unionByName(_edges(new["tokens"], symbols, symbols))
    refs = left["refs"].unionByName(_refs(calls_in, fresh, symbols)).unionByName(_refs(new["tokens"], symbols, symbols))
    return {"symbols": symbols, "tokens": tokens, "refs": refs, "edges": edges}


def _resolved(tokens: DataFrame, targets: DataFrame, all_symbols: DataFrame) -> DataFrame:
    t = tokens.where("kind = 'call'")
    hits = t.join(targets.select("name", F.col("symbol_id").alias("target")), "name").select("token_id", "target", "line")
    return hits.join(resolve.enclosing(t, all_symbols).select("token_id", F.col("symbol_id").alias("caller")), "token_id")


def _edges(tokens: DataFrame, targets: DataFrame, all_symbols: DataFrame) -> DataFrame:
    return _resolved(tokens, targets, all_symbols).where("caller <> target").select(F.col("caller").alias("from_symbol"), F.col("target").alias("to_symbol"), "line")


def _refs(tokens: DataFrame, targets: DataFrame, all_symbols: DataFrame) -> DataFrame:
    calls = _resolved(tokens, targets, all_symbols).select("token_id", F.col("target").alias("symbol_id"), F.lit("call").alias("kind"))
    return calls.unionByName(resolve.construction_refs(tokens, targets))
