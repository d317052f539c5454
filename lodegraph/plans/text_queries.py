"""Queries over lines, chunks and ranked search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import lines as L
from ..operators import search as S
from ..operators.index import TextIndex
from ..session import shared_dir
from ..sources import adapters as A
from .registry import query

QUERY, LIMIT = "the thon onwh reat", 20
CHUNKS = """chunks AS (SELECT path || ':' || (s + 1) || ':' || least(s + 50, len(xs)) AS id, file_id, path, array_to_string(xs[s + 1:s + 50], chr(10)) AS content, (s + 1)::INT AS start_line, least(s + 50, len(xs))::INT AS end_line
  FROM (SELECT file_id, path, xs, unnest(range(0, greatest(len(xs) - 6, 0) + 1, 45)) AS s FROM (SELECT file_id, any_value(path) AS path, list(text ORDER BY line) AS xs FROM lines JOIN docfiles USING (file_id) GROUP BY file_id)))"""
RANKED = f"""{CHUNKS},
ts AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND strlen(x) < 40) AS ts FROM chunks),
q AS (SELECT term, count(*)::DOUBLE AS weight FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS term) GROUP BY term),
whole AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM ts),
tf AS (SELECT id, dl, term, weight, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM ts) JOIN q USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
hits AS (SELECT id, sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) CROSS JOIN whole GROUP BY id),
best AS (SELECT * FROM hits ORDER BY round(score, 9) DESC, id LIMIT {LIMIT})"""


def chunks(spark, sf):
    return L.chunks(A.documents(spark, sf))


_KEPT: dict[tuple[str, str], TextIndex] = {}


def built(spark, sf):
    """A new index of the documents' chunks, in the shared folder. The table is one small file, dealt out because cutting words is work."""
    index = TextIndex(spark, f"{shared_dir(spark)}/lodegraph/index-{uuid.uuid4().hex}")
    index.add(L.chunks(A.documents(spark, sf).repartition(spark.sparkContext.defaultParallelism)).select("id", "path", "content", "start_line", "end_line"))
    return index


def kept(spark, sf):
    """The index of these documents that this application keeps; built by whoever asks first."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        _KEPT[key] = built(spark, sf)
    return _KEPT[key]


def hits(spark, sf):
    return kept(spark, sf).search(QUERY)


@query("x1_chunks", "SELECT id, file_id, start_line, end_line FROM chunks", CHUNKS)
def x1(spark, sf):
    return chunks(spark, sf).select("id", "file_id", "start_line", "end_line")


@query("x3_content_hash", "SELECT id, sha256(content) AS content_hash FROM chunks", CHUNKS)
def x3(spark, sf):
    return chunks(spark, sf).select("id", "content_hash")


@query("f1_terms", "SELECT term, count(*) AS n FROM (SELECT unnest(ts) AS term FROM ts) GROUP BY term", RANKED)
def f1(spark, sf):
    return chunks(spark, sf).select(F.explode(S.terms(F.col("content"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("b12_index", "SELECT id, len(ts)::INT AS terms FROM ts", RANKED)
def b12(spark, sf):
    """Builds the index anew; it is the one that is kept from then on."""
    index = _KEPT[spark.sparkContext.applicationId, sf] = built(spark, sf)
    return index.docs().select("id", F.col("content").alias("terms"))


@query("f3_bm25", "SELECT id, round(score, 4) AS score FROM hits", RANKED)
def f3(spark, sf):
    return hits(spark, sf).select("id", F.round("score", 4).alias("score"))


def best(spark, sf):
    h = hits(spark, sf)
    return h.orderBy(F.desc(F.round("score", 9)), "id").limit(LIMIT)


@query("f4_topk", "SELECT id, round(score, 4) AS score FROM best", RANKED)
def f4(spark, sf):
    return best(spark, sf).select("id", F.round("score", 4).alias("score"))


@query("f5_dedup", """SELECT path, id, start_line, end_line, round(score, 4) AS score FROM walk WHERE kept""", RANKED + """,
ranked AS (SELECT best.*, path, start_line, end_line, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) AS rn FROM best JOIN chunks USING (id)),
walk AS (SELECT *, true AS kept, [struct_pack(a := start_line, b := end_line)] AS acc FROM ranked WHERE rn = 1
  UNION ALL SELECT r.*, len(list_filter(w.acc, lambda k: k.a <= r.end_line AND r.start_line <= k.b)) = 0,
    CASE WHEN len(list_filter(w.acc, lambda k: k.a <= r.end_line AND r.start_line <= k.b)) = 0 THEN list_append(w.acc, struct_pack(a := r.start_line, b := r.end_line)) ELSE w.acc END
  FROM walk w JOIN ranked r ON r.path = w.path AND r.rn = w.rn + 1)""")
def f5(spark, sf):
    rows = best(spark, sf).join(kept(spark, sf).docs().select("id", "path", "start_line", "end_line"), ["id", "path"])
    return S.without_overlaps(rows).select("path", "id", "start_line", "end_line", F.round("score", 4).alias("score"))


@query("f6_empty_query", "SELECT id, 0.0::DOUBLE AS score FROM chunks WHERE false", CHUNKS)
def f6(spark, sf):
    return kept(spark, sf).search("...").select("id", "score")


@query("f10_filters", "SELECT id FROM hits JOIN chunks USING (id) WHERE contains(path, 'src1') OR contains(path, '/fr/')", RANKED)
def f10(spark, sf):
    return S.filtered(hits(spark, sf), ["src1", "/fr/"], False).select("id")


NAMED = """docs AS (SELECT s.symbol_id AS id, string_split(lower(name), ' ') AS ns, list_filter(regexp_split_to_array(lower(path || ' ' || kind), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS cs FROM symbols s JOIN files USING (file_id) WHERE kind <> 'module'),
q AS (SELECT unnest(['bolt', 'bolt', 'core', 'method']) AS term), w AS (SELECT term, count(*)::DOUBLE AS weight FROM q GROUP BY 1),
f AS (SELECT id, 3.0::DOUBLE AS boost, 'n' AS field, ns AS ts FROM docs UNION ALL SELECT id, 1.0, 'c', cs FROM docs),
whole AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM f GROUP BY 1),
tf AS (SELECT id, boost, field, dl, term, count(*) AS tf FROM (SELECT id, boost, field, len(ts) AS dl, unnest(ts) AS term FROM f) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)"""


@query("f2_boosted", "SELECT id, round(sum(boost * weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM tf JOIN w USING (term) JOIN df USING (field, term) JOIN whole USING (field) GROUP BY id", NAMED)
def f2(spark, sf):
    """Symbols as documents: the name is the boosted field, path and kind the content."""
    s = A.symbols(spark, sf).where("kind <> 'module'").join(A.files(spark, sf), "file_id").select(F.col("symbol_id").alias("id"), F.col("name").alias("symbol"), F.concat_ws(" ", "path", "kind").alias("content"))
    return S.search(s, "bolt core, BOLT method", symbol="symbol").select("id", F.round("score", 4).alias("score"))


UPDATED = RANKED.replace("FROM lines JOIN docfiles USING (file_id) GROUP BY file_id", "FROM lines JOIN docfiles USING (file_id) WHERE NOT contains(path, '/de/') AND NOT contains(path, '/fr/') GROUP BY file_id UNION ALL SELECT file_id, path, ['the thon ' || file_id] FROM docfiles WHERE contains(path, '/fr/')")


@query("f7_index_after_update", "SELECT id, round(score, 4) AS score FROM hits", UPDATED)
def f7(spark, sf):
    """German documents go from a kept index, French ones come back as one line."""
    index, d = built(spark, sf), A.documents(spark, sf)
    index.delete(d.where(F.col("path").contains("/de/") | F.col("path").contains("/fr/")).select("path"))
    new = d.where(F.col("path").contains("/fr/")).withColumn("content", F.concat(F.lit("the thon "), F.col("file_id").cast("string")))
    index.add(L.chunks(new).select("id", "path", "content", "start_line", "end_line"))
    return TextIndex.open(spark, index.folder).search(QUERY).select("id", F.round("score", 4).alias("score"))


TESTED = r"""CASE WHEN regexp_matches(lower(path), '/(test|tests|__tests__|spec|__mocks__)/') OR regexp_matches(lower(base || '.' || ext), '(_test\.(go|rs)|\.(test|spec)\.(ts|tsx|js|jsx))$') OR starts_with(lower(base), 'test_') OR lower(base || '.' || ext) = 'conftest.py' THEN 0.5 ELSE 1 END"""
MADE = r"""CASE WHEN regexp_matches(lower(path), '/(generated|gen|dist|build|\.next|node_modules)/') OR regexp_matches(lower(base || '.' || ext), '(\.min\.(js|css)|\.generated\.ts|\.g\.dart|\.pb\.go)$') OR contains(lower(base || '.' || ext), '.bundle.') THEN 0.3 ELSE 1 END"""


@query("f11_boosts", f"SELECT file_id, round(10.0 * CASE WHEN ext = 'rs' THEN 2 ELSE 1 END * {TESTED} * {MADE}, 4)::DOUBLE AS score FROM paths")
def f11(spark, sf):
    return A.paths(spark, sf).select("file_id", F.round(S.boosted(F.lit(10.0), F.col("path"), F.col("ext") == "rs"), 4).alias("score"))


@query("s13_lines", "SELECT file_id, line, text FROM lines")
def s13(spark, sf):
    return L.lines(A.documents(spark, sf))


@query("s14_line_range", "SELECT file_id, line, text FROM lines WHERE line BETWEEN 3 AND 5")
def s14(spark, sf):
    return L.line_range(L.lines(A.documents(spark, sf)), 3, 5)


@query("l15_context", """SELECT a.file_id, a.line, string_agg(b.text, chr(10) ORDER BY b.line) AS context, count(*) AS n_lines
FROM (SELECT * FROM lines WHERE contains(text, 'onwh')) a JOIN lines b ON b.file_id = a.file_id AND b.line BETWEEN a.line - 2 AND a.line + 2 GROUP BY ALL""")
def l15(spark, sf):
    rows = L.lines(A.documents(spark, sf))
    return L.context(rows, rows.where(F.col("text").contains("onwh")), 2, 2)


@query("l17_truncate", "SELECT file_id, line, CASE WHEN length(trim(text)) > 80 THEN substring(trim(text), 1, 77) || '...' ELSE trim(text) END AS shown FROM lines")
def l17(spark, sf):
    return L.lines(A.documents(spark, sf)).select("file_id", "line", L.truncated(F.col("text"), 80).alias("shown"))


@query("l18_layout", "SELECT file_id, line, (CASE WHEN contains(text, 'onwh') THEN '> ' ELSE '  ' END) || lpad(line::VARCHAR, 4, ' ') || ': ' || text AS shown FROM lines")
def l18(spark, sf):
    return L.lines(A.documents(spark, sf)).select("file_id", "line", L.layout(F.col("line"), F.col("text"), F.col("text").contains("onwh")).alias("shown"))


@query("t14_pattern", "SELECT file_id, line, strlen(substring(text, 1, strpos(text, m) - 1))::INT AS col, m AS matched FROM (SELECT *, regexp_extract(text, '[a-z]*thon[a-z]+') AS m FROM lines WHERE regexp_matches(text, '[a-z]*thon[a-z]+')) ")
def t14(spark, sf):
    return L.pattern(L.lines(A.documents(spark, sf)), "[a-z]*thon[a-z]+")


@query("t14_list", """SELECT m.path, m.file_id, m.line, m.col, m.matched, e.name AS enclosing, string_agg(l.text, chr(10) ORDER BY l.line) AS context FROM m JOIN lines l ON l.file_id = m.file_id AND l.line BETWEEN m.line - 1 AND m.line + 1 LEFT JOIN e ON e.file_id = m.file_id AND e.line = m.line GROUP BY ALL""",
       """m AS (SELECT path, file_id, line, strlen(substring(text, 1, strpos(text, m) - 1))::INT AS col, m AS matched FROM (SELECT *, regexp_extract(text, '[a-z]*thon[a-z]+') AS m FROM lines JOIN (SELECT file_id, path FROM docfiles) USING (file_id) WHERE contains(path, '/doc_1') AND regexp_matches(text, '[a-z]*thon[a-z]+')) ORDER BY path, line LIMIT 50),
e AS (SELECT m.file_id, m.line, arg_min(name, (end_line - start_line, symbol_id)) AS name FROM m JOIN symbols s ON s.file_id = m.file_id AND m.line BETWEEN start_line AND end_line GROUP BY ALL)""")
def t14l(spark, sf):
    from ..operators import trace as T

    d = A.documents(spark, sf)
    return T.pattern_list("[a-z]*thon[a-z]+", L.lines(d), d, A.symbols(spark, sf), "/doc_1", 1, 50)


BARE = "regexp_replace(regexp_replace(text, '^[\\s\\x{0085}\\p{Z}]+', ''), '[\\s\\x{0085}\\p{Z}]+$', '')"
DECLARED = f"""bare AS (SELECT file_id, line, {BARE} AS t, contains({BARE}, '=>') OR contains({BARE}, 'function') AS valued FROM lines),
declared AS (SELECT file_id, line,
  nullif(CASE WHEN regexp_matches(t, '^(fn|function|def|func) ') THEN trim(string_split(regexp_replace(t, '^(fn|function|def|func) ', ''), '(')[1])
    WHEN regexp_matches(t, '^(const|let|var) ') AND valued THEN regexp_replace(regexp_split_to_array(t, '[\\s\\p{{Z}}]+')[2], '[= ]+$', '')
    WHEN starts_with(t, 'export function ') THEN trim(string_split(t[17:], '(')[1]) WHEN starts_with(t, 'export const ') AND valued THEN trim(string_split(t[14:], '=')[1]) END, '') AS fn,
  nullif(CASE WHEN starts_with(t, 'class ') THEN regexp_extract(t, '^class ([^ {{(:]*)', 1) WHEN regexp_matches(t, '^(pub )?struct ') THEN regexp_extract(t, '^(?:pub )?struct ([^ {{(<]*)', 1)
    WHEN regexp_matches(t, '^impl[ <]') THEN regexp_extract(t, '^impl[<\\p{{L}}\\p{{N}}_,]*>*[\\s]*([^ {{<]*)', 1) END, '') AS cls,
  nullif(CASE WHEN contains(t, 'pub ') AND contains(t, 'fn ') THEN trim(string_split(t[strpos(t, 'fn ') + 3:], '(')[1]) WHEN starts_with(t, 'async ') THEN trim(string_split(t[7:], '(')[1]) END, '') AS method FROM bare)"""


@query("x4_chunk_symbol", """SELECT id, arg_min(coalesce(fn, cls, method), line) AS name, arg_min(CASE WHEN fn IS NOT NULL THEN 'function' WHEN cls IS NOT NULL THEN 'class' ELSE 'method' END, line) AS type
FROM chunks JOIN declared USING (file_id) WHERE line BETWEEN start_line AND end_line AND coalesce(fn, cls, method) IS NOT NULL GROUP BY id""", f"{CHUNKS}, {DECLARED}")
def x4(spark, sf):
    s = chunks(spark, sf).select("id", L.chunk_symbol(F.col("xs")).alias("s")).where("s is not null")
    return s.select("id", "s.name", "s.type")


@query("x5_names", "SELECT * FROM declared WHERE fn IS NOT NULL OR cls IS NOT NULL OR method IS NOT NULL", DECLARED)
def x5(spark, sf):
    t = F.col("text")
    names = L.lines(A.documents(spark, sf)).select("file_id", "line", L.function_name(t).alias("fn"), L.class_name(t).alias("cls"), L.method_name(t).alias("method"))
    return names.where("fn is not null or cls is not null or method is not null")


@query("s3_ignored", "SELECT file_id FROM paths WHERE contains(path, 'node_modules') OR contains(path, '.git') OR contains(path, 'dist') OR contains(path, 'build') OR contains(path, '__pycache__') OR contains(path, '.min.js') OR contains(path, '.map') OR contains(path, '_util')")
def s3(spark, sf):
    return A.paths(spark, sf).where(paths.ignored(F.col("path"), [*paths.IGNORED, "*_util*"])).select("file_id")


CODE = "'ts','tsx','js','jsx','mjs','cjs','py','pyi','rs','go','java','kt','kts','scala','rb','php','c','h','cpp','cc','cxx','hpp','cs','swift','ex','exs','erl','hrl','hs','ml','mli','lua','sh','bash','zsh','sql','vue','svelte'"


@query("s4_extensions", f"SELECT file_id, lower(ext) IN ({CODE},'md','yaml','yml','toml','json') AS indexable, lower(ext) IN ({CODE}) AS narrow FROM paths")
def s4(spark, sf):
    return A.paths(spark, sf).select("file_id", paths.indexable(F.col("path")).alias("indexable"), paths.indexable(F.col("path"), False).alias("narrow"))


def by_extension(said: str) -> str:
    """CASE over `language ext ext, language ext` in SQL."""
    return "CASE lower(ext) " + " ".join(f"WHEN '{e}' THEN '{names[0]}'" for names in map(str.split, said.split(",")) for e in names[1:]) + " ELSE 'unknown' END"


SEARCHED = by_extension("typescript ts tsx, javascript js jsx mjs cjs, python py pyi, rust rs, go go, java java, kotlin kt kts, scala scala, ruby rb, php php, c c h, cpp cpp cc cxx hpp, csharp cs, swift swift, elixir ex exs, erlang erl hrl, haskell hs, ocaml ml mli, lua lua, shell sh bash zsh, sql sql, vue vue, svelte svelte, markdown md, yaml yaml yml, toml toml, json json")
TRACED = by_extension("typescript ts tsx mts cts, javascript js jsx mjs cjs, python py pyi, rust rs, go go, c c h, cpp cpp hpp cc cxx, java java, ruby rb, php php, swift swift, kotlin kt kts, csharp cs, lua lua, bash sh bash zsh, json json, yaml yaml yml, toml toml, markdown md markdown, html html htm, css css scss sass less, sql sql, zig zig, elixir ex exs, erlang erl hrl, haskell hs lhs, ocaml ml mli, scala scala sc, clojure clj cljs cljc, verilog v vh, svelte svelte, vue vue")


@query("s5_language", f"SELECT file_id, {SEARCHED} AS language FROM paths")
def s5(spark, sf):
    return A.paths(spark, sf).select("file_id", paths.language(F.col("path")).alias("language"))


@query("s6_trace_language", f"SELECT file_id, {TRACED} AS language FROM paths")
def s6(spark, sf):
    return A.paths(spark, sf).select("file_id", paths.trace_language(F.col("path")).alias("language"))


MARKS = ("package.json", ".git", "go.mod", "deno.json", "Cargo.toml", "setup.py", "none.txt", "bun.lockb", "pom.xml", "Gemfile", "mix.exs", "pyproject.toml", "requirements.txt", "composer.json", "build.gradle")


@query("s8_project_type", f"""SELECT dir, arg_min(kind, pr) AS kind FROM (SELECT 'd' || doc_id % 70 AS dir, {A._list(MARKS, 'doc_id * 11 + doc_id // 70')} AS name FROM documents) JOIN (SELECT unnest(['.git','package.json','Cargo.toml','pyproject.toml','setup.py','go.mod','pom.xml','build.gradle','Gemfile','composer.json','mix.exs','deno.json','bun.lockb']) AS name,
 unnest(['git','nodejs','rust','python','python','go','java','java','ruby','php','elixir','deno','bun']) AS kind, unnest(range(13)) AS pr) USING (name) GROUP BY dir""")
def s8(spark, sf):
    i = F.col("doc_id")
    rows = A.read(spark, sf, "documents").select(F.concat(F.lit("d"), (i % 70).cast("string")).alias("dir"), A.pick(MARKS, i * 11 + F.floor(i / 70)).alias("name"))
    return paths.project_types(rows)


@query("s7_project_root", "SELECT path, CASE WHEN file_id % 7 = 0 THEN folder ELSE 'p' || file_id END AS root FROM paths WHERE file_id % 7 = 0 OR file_id % 3 = 0")
def s7(spark, sf):
    """Every seventh folder holds a marker of a Python project, every third tree one of a repository."""
    f = A.paths(spark, sf)
    own = f.where("file_id % 7 = 0").select(F.concat("folder", F.lit("/pyproject.toml")).alias("path"))
    top = f.where("file_id % 3 = 0").select(F.concat(F.lit("p"), F.col("file_id").cast("string"), F.lit("/.git")).alias("path"))
    names = f.select("path")
    return paths.project_roots(names.unionByName(own).unionByName(top)).join(names, "path", "left_semi")


@query("c20_display", """SELECT file_id, CASE WHEN len(string_split(path, '/')) > 3 THEN '.../' || array_to_string(string_split(path, '/')[-2:], '/') ELSE path END AS short, '&lt;' || path || '&gt;' AS html FROM paths""")
def c20(spark, sf):
    from ..operators import dashboard as D

    f = A.paths(spark, sf)
    return f.select("file_id", D.short_path(F.col("path")).alias("short"), D.escaped(F.concat(F.lit("<"), F.col("path"), F.lit(">"))).alias("html"))


@query("c3_glob", r"SELECT file_id FROM paths WHERE regexp_matches(path, '(?i)^p.*/.*/TEST_[^/]*\.[^/]*s')")
def c3(spark, sf):
    from ..operators import dashboard as D

    return A.paths(spark, sf).where(F.col("path").rlike(D.glob("p**/**/TEST_*.*s"))).select("file_id")


@query("w17_redact", r"""SELECT file_id, CASE WHEN contains(lower(path), '.env') OR contains(lower(path), 'secret') OR contains(lower(path), 'credential') OR regexp_matches(path, '(^|/)config/production\.') OR contains(lower(path), '/config/production.') OR regexp_matches(path, '\.(pem|key)$')
 OR regexp_matches(path, '(^|/)(secrets|\.aws|\.ssh)/') OR regexp_matches(lower(path), '/(secrets|\.aws|\.ssh)/') THEN folder || '/[HIDDEN].' || ext ELSE path END AS path FROM paths""")
def w17(spark, sf):
    from ..operators import dashboard as D

    return A.paths(spark, sf).select("file_id", D.redacted(F.col("path")).alias("path"))


@query("w18_settings", "SELECT file_id, least(greatest(file_id * 10, 10), 500)::BIGINT AS graph_nodes, least(greatest(file_id * 30, 50), 2000)::BIGINT AS list_items FROM paths")
def w18(spark, sf):
    from ..operators import dashboard as D

    g, n = D.clamped(F.col("file_id") * 10, F.col("file_id") * 30)
    return A.paths(spark, sf).select("file_id", g.cast("long").alias("graph_nodes"), n.cast("long").alias("list_items"))


SENTENCE = """SELECT *, list_filter(regexp_split_to_array(lower(text), '[\\s\\x{0085}\\p{Z}\\x0b]+'), lambda x: x <> '') AS ws FROM said"""


@query("a4_natural", f"""SELECT id, coalesce(len(ws) >= 2 AND (regexp_matches(lower(text), '^(how|what|where|when|why|which|who|does|is|are|can|show|find|list)') OR (len(ws) >= 3 AND list_has_any(ws, ['the','a','an','to','from','in','of','for','with','by','all','every','any']))), false) AS "natural" FROM ({SENTENCE})""",
       "said AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT -1 - item_id, left(text, 20) FROM benchmark)")
def a4(spark, sf):
    """Turns of conversations, and beginnings of test items."""
    c = A.read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    b = A.read(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), F.substring("text", 1, 20).alias("text"))
    return c.unionByName(b).select("id", F.coalesce(S.natural(F.col("text")), F.lit(False)).alias("natural"))


@query("a6_valid_order", """SELECT item_id, array_to_string(list_concat(g, list_filter(range(0, 5), lambda i: NOT list_contains(g, i))), ',') AS shown FROM (SELECT item_id, CASE WHEN item_id % 7 = 2 THEN [2, item_id % 5] WHEN item_id % 7 < 5 THEN list_filter([item_id % 7, 2, item_id % 5], lambda i: true) ELSE [2, item_id % 5] END AS raw, list_distinct([2]) AS _, 
 (SELECT list(x ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest([item_id % 7, 2, item_id % 5]) AS x, unnest([1, 2, 3]) AS p) WHERE x < 5 GROUP BY x)) AS g FROM benchmark)""")
def a6(spark, sf):
    i = F.col("item_id")
    raw = S.parsed_order(F.concat(F.lit("order: ["), F.concat_ws(", ", i % 7, F.lit(2), i % 5), F.lit("] ok")))
    return A.read(spark, sf, "benchmark").select("item_id", F.array_join(S.valid_order(raw, F.lit(5)).cast("array<string>"), ",").alias("shown"))


@query("l16_block")
def l16(spark, sf):
    """Blocks around the lines of pages, whose statements stand on lines of their own here; the walk over braces has a plain version in the tests."""
    p = A.read(spark, sf, "pages").select(F.col("page_id").alias("file_id"), F.regexp_replace("html", "([;{}>])", "$1\n").alias("content"))
    rows = L.lines(p)
    return L.enclosing_block(rows, rows.where(F.col("text").rlike("[a-z]\\(")).select("file_id", "line"))
