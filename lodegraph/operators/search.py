"""Ranked text search: BM25 over two fields, overlap removal, filters and boosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, SYMBOL_BOOST, LONGEST = 1.2, 0.75, 3.0, 40


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, shorter than 40 bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: (x != "") & (F.octet_length(x) < LONGEST))


def query_terms(spark, query: str) -> DataFrame:
    """term, weight: how often the query has it."""
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(terms(F.col("q"))).alias("term"))
    return q.groupBy("term").agg(F.count("*").cast("double").alias("weight"))


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    """id, score of the documents with a query term in one field.

    The terms of the query are applied before counting, so only their postings are shuffled.
    """
    spark = docs.sparkSession
    q = F.broadcast(query_terms(spark, query))  # at most as many rows as the query has words
    t = docs.select(F.col(id_col).alias("id"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("ts")).withColumn("dl", F.size("ts"))
    whole = F.broadcast(t.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))  # one row
    tf = t.select("id", "dl", F.explode("ts").alias("term")).join(q, "term").groupBy("id", "term", "dl", "weight").agg(F.count("*").alias("tf"))
    df = F.broadcast(tf.groupBy("term").agg(F.count("*").alias("df")))  # a row for each term of the query
    s = tf.join(df, "term").join(whole)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return s.groupBy("id").agg(F.sum(part * F.col("weight")).alias("score"))


def search(docs: DataFrame, query: str, id_col: str = "id", content: str = "content", symbol: str | None = None, boost: float = SYMBOL_BOOST) -> DataFrame:
    """Content score plus the boosted score of the symbol-name field. A query without terms finds nothing."""
    hits = bm25(docs, id_col, content, query)
    if symbol:
        own = bm25(docs, id_col, symbol, query).select("id", (F.col("score") * boost).alias("score"))
        hits = hits.unionByName(own).groupBy("id").agg(F.sum("score").alias("score"))
    return hits


def top(hits: DataFrame, limit: int = 20) -> DataFrame:
    return hits.orderBy(F.desc("score"), "id").limit(limit)


def without_overlaps(hits: DataFrame) -> DataFrame:
    """Greedy by falling score: a hit stays unless it shares a line with a hit of its path that stays.

    A path's hits are as many as the limit of the search before, so the array is bounded.
    """
    row = F.struct((-F.col("score")).alias("neg"), "id", "start_line", "end_line", "score")
    kind = "array<struct<neg:double,id:string,start_line:int,end_line:int,score:double>>"
    xs = F.array_sort(F.collect_list(row)).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        clash = F.exists(acc, lambda k: (k["start_line"] <= x["end_line"]) & (x["start_line"] <= k["end_line"]))
        return F.when(clash, acc).otherwise(F.array_append(acc, x))

    grouped = hits.groupBy("path").agg(xs.alias("xs"))
    return grouped.select("path", F.explode(F.aggregate("xs", F.array().cast(kind), step)).alias("x")).select("path", "x.id", "x.start_line", "x.end_line", "x.score")


# Folders and names of tests and of generated files, and what a hit in them is worth.
TEST_FOLDERS = ("test", "tests", "__tests__", "spec", "__mocks__")
TEST_ENDS = ("_test.go", "_test.rs", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx")
GENERATED_FOLDERS = ("generated", "gen", "dist", "build", ".next", "node_modules")
GENERATED_ENDS = (".min.js", ".min.css", ".generated.ts", ".g.dart", ".pb.go")
EXACT, IN_TEST, IN_GENERATED = 2.0, 0.5, 0.3


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def is_test_path(path: Column) -> Column:
    """A test by a folder on the way (not the first of a relative path), or by the file's name."""
    p = F.lower(path)
    name = F.element_at(F.split(p, "/"), -1)
    return _any(p.contains(f"/{x}/") for x in TEST_FOLDERS) | _any(name.endswith(x) for x in TEST_ENDS) | name.startswith("test_") | (name == "conftest.py")


def is_generated_path(path: Column) -> Column:
    """A generated file by a folder on the way (not the first of a relative path), or by the file's name."""
    p = F.lower(path)
    name = F.element_at(F.split(p, "/"), -1)
    return _any(p.contains(f"/{x}/") for x in GENERATED_FOLDERS) | _any(name.endswith(x) for x in GENERATED_ENDS) | name.contains(".bundle.")


def boosted(score: Column, path: Column, exact: Column) -> Column:
    """Exact symbol matches double, tests halve, generated files count three tenths."""
    return score * F.when(exact, EXACT).otherwise(1.0) * F.when(is_test_path(path), IN_TEST).otherwise(1.0) * F.when(is_generated_path(path), IN_GENERATED).otherwise(1.0)


def filtered(docs: DataFrame, paths: list[str] | None = None, include_tests: bool = True) -> DataFrame:
    """Rows whose path has one of the substrings, and no tests unless wanted."""
    out = docs
    if paths:
        cond = F.lit(False)
        for p in paths:
            cond = cond | F.col("path").contains(p)
        out = out.where(cond)
    return out if include_tests else out.where(~is_test_path(F.col("path")))


# -- reranking -----------------------------------------------------------------


def valid_order(indices: Column, n: Column) -> Column:
    """Indices in range, each once, then the missing ones in their order."""
    all_ = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    good = F.array_distinct(F.filter(indices, lambda i: (i >= 0) & (i < n)))
    return F.concat(good, F.array_except(all_, good))


def parsed_order(reply: Column) -> Column:
    """The index array in a model's reply: the outermost brackets; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(\[[0-9,\s-]*\])", 1), F.lit("")), "array<int>")


def semantic(docs: DataFrame, query: str, limit: int = 20, reranker: Callable[[str, list[str]], list[int]] | None = None) -> list[dict]:
    """Top hits without overlaps, reordered by a callable over their first 1,500 characters (the identity unless given).

    Works on the 2 * limit best rows only, which the driver holds.
    """
    hits = top(search(docs, query), 2 * limit).join(docs, "id")
    rows = [r.asDict() for r in without_overlaps(hits.select("id", "path", "start_line", "end_line", "score")).join(docs.select("id", "content"), "id").orderBy(F.desc("score"), "id").collect()]
    order = reranker(query, [r["content"][:1500] for r in rows]) if reranker else list(range(len(rows)))
    seen = list(dict.fromkeys(i for i in order if 0 <= i < len(rows)))
    return [rows[i] for i in seen + [i for i in range(len(rows)) if i not in set(seen)]][:limit]


# -- natural language ----------------------------------------------------------

# Beginnings of questions, and words that sentences have and names don't.
QUESTIONS = ("how", "what", "where", "when", "why", "which", "who", "does", "is", "are", "can", "show", "find", "list")
COMMON = ("the", "a", "an", "to", "from", "in", "of", "for", "with", "by", "all", "every", "any")


def natural(query: Column) -> Column:
    """Whether a query reads like a sentence: two words or more that begin like a question, or three or more with a common word."""
    low = F.lower(query)
    words = F.filter(F.split(low, r"(?U)\s+"), lambda x: x != "")
    question = _any(low.startswith(x) for x in QUESTIONS)
    common = F.arrays_overlap(words, F.array(*map(F.lit, COMMON)))
    return (F.size(words) >= 2) & (question | (common & (F.size(words) >= 3)))


# -- replies of models ----------------------------------------------------------


def _json(reply: str, opening: str, closing: str):
    """The JSON value that a reply is, or that stands between its outermost brackets; None without one."""
    import json

    a, b = reply.find(opening), reply.rfind(closing)
    for part in (reply, reply[a : b + 1] if 0 <= a < b else ""):
        try:
            return json.loads(part)
        except ValueError:
            continue
    return None


def parsed_names(reply: str) -> list[str]:
    """The names in a reply to a query for related symbols; none if it can't be read."""
    found = _json(reply, "[", "]")
    return [x for x in found if isinstance(x, str)] if isinstance(found, list) else []


def parsed_indices(reply: str, n: int) -> list[int]:
    """The indices below n in a reply to a rerank request; all in order if it can't be read."""
    found = _json(reply, "[", "]")
    if not isinstance(found, list) or not all(isinstance(x, int) for x in found):
        return list(range(n))
    return [x for x in found if 0 <= x < n]


def parsed_analysis(reply: str) -> dict | None:
    """intent, symbols and filters of a reply to a question in natural language."""
    found = _json(reply, "{", "}")
    return {"intent": found.get("intent"), "symbols": found.get("symbols") or [], "filters": found.get("filters")} if isinstance(found, dict) else None


LONGEST_NAME, MOST_NAMES = 15, 10


def expanded(query: str, expander: Callable[[str], str] | None = None, natural_language: bool | None = None) -> list[str]:
    """Names to trace for a query: what an expander replies, up to MOST_NAMES, the query itself without one or without a reply.

    A long query that isn't natural language is a name already.
    """
    if expander is None or (not natural_language and len(query.encode()) > LONGEST_NAME):
        return [query]
    return parsed_names(expander(query))[:MOST_NAMES] or [query]


def reordered(rows: list, ask: Callable[[list], str] | None, least: int = 4) -> list:
    """Rows in the order of a reply's indices, those that it leaves out behind; unchanged without a model or for fewer than `least`."""
    if ask is None or len(rows) < least:
        return list(rows)
    order = list(dict.fromkeys(parsed_indices(ask(rows), len(rows))))
    return [rows[i] for i in order] + [x for i, x in enumerate(rows) if i not in set(order)]
