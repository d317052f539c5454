"""Symbols, calls, imports, scopes and tokens from source text.

Python goes through its own syntax tree and tokens; other languages, and Python that
doesn't parse, through patterns over the whole text. Each row names its method.
Columns count bytes.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..session import stored
from . import resolve

FIELDS = "file_id long, path string, what string, name string, kind string, line int, end_line int, col int, is_exported boolean, is_async boolean, method string, ord int"

# Words that no symbol, call or token is named by, whatever the language.
KEYWORDS = frozenset("""
if else for while do switch case default break continue return throw try catch finally
var let const function class extends implements import export from as async await yield static get set
public private protected readonly true false null undefined void never this super constructor
def lambda with assert pass raise global nonlocal and or not is None True False self cls
fn pub mod use crate Self struct enum trait impl type where mut ref move box dyn unsafe loop match Some Ok Err
func package go defer chan select map range interface nil
int float double char string bool boolean byte short long signed unsigned auto register volatile extern
typeof instanceof in of
""".split())
# Calls that every program of a language makes.
JAVASCRIPT_BUILTINS = frozenset("""
console log error warn info debug parseInt parseFloat isNaN isFinite setTimeout setInterval clearTimeout clearInterval
require define module exports JSON Math Date Array Object String Number Boolean Symbol Map Set WeakMap WeakSet Promise Proxy Reflect Error RegExp
encodeURI decodeURI encodeURIComponent decodeURIComponent eval fetch alert confirm prompt
""".split())
PYTHON_BUILTINS = frozenset("""
print len range str int float bool list dict set tuple type object isinstance issubclass hasattr getattr setattr delattr open input id dir vars globals locals
iter next zip map filter reduce sorted reversed enumerate sum min max abs round pow divmod ord chr hex oct bin format repr hash callable
super staticmethod classmethod property compile exec eval help quit exit
""".split())
RUST_BUILTINS = frozenset("""
println print eprintln eprint format write writeln panic assert assert_eq assert_ne debug_assert debug_assert_eq debug_assert_ne vec todo unimplemented unreachable
cfg derive include include_str include_bytes env option_env concat stringify line column file module_path
Box Vec String Option Result Arc Rc Cell RefCell Mutex RwLock
""".split())
GO_BUILTINS = frozenset("""
fmt Println Printf Print Sprintf Fprintf Errorf len cap make new append copy delete close panic recover real imag complex error Error string int bool byte rune
""".split())
BUILTINS = {"javascript": JAVASCRIPT_BUILTINS, "typescript": JAVASCRIPT_BUILTINS, "python": PYTHON_BUILTINS, "rust": RUST_BUILTINS, "go": GO_BUILTINS}

# What declares a function, tried in this order: pattern, kind, always asynchronous.
FUNCTIONS = [
    (r"(?m)^[\t ]*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*\(", "function", False),
    (r"(?m)^[\t ]*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>", "function", False),
    (r"(?m)^[\t ]*(?:export\s+)?(?:const|let|var)\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*=\s*async\s+\([^)]*\)\s*=>", "function", True),
    (r"(?m)^[\t ]*(?:async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "function", False),
    (r"(?m)^[\t ]*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*[<(]", "function", False),
    (r"(?m)^[\t ]*func\s+(?:\([^)]+\)\s+)?([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "function", False),
    (r"(?m)^[\t ]*def\s+([a-zA-Z_][a-zA-Z0-9_!?]*)", "method", False),
    (r"(?m)^(?:public|private|protected|static|[^\S\n])*function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "function", False),  # words on the lines above change no match, and looking for them takes the square of blank lines
    ("typed method", "method", False),
    ("typed function", "function", False),
    (r"(?m)^[\t ]*(?:local\s+)?function\s+([a-zA-Z_][a-zA-Z0-9_.:]*)\s*\(", "function", False),
    (r"(?m)^[\t ]*def[p]?\s+([a-zA-Z_][a-zA-Z0-9_!?]*)", "function", False),
    (r"(?m)^([a-z_][a-zA-Z0-9_']*)\s*::", "function", False),
]
# What stands before the name of a typed method and of a typed function. Their whole patterns take time
# by powers in an engine that backtracks, so names with a parameter list and a brace are found first.
BEFORE = {
    "typed method": r"[\t ]*(?:public|private|protected|static|\s)*(?:async\s+)?(?:[a-zA-Z_<>\[\]]+\s+)+",
    "typed function": r"[\t ]*(?:static\s+)?(?:inline\s+)?[a-zA-Z_][a-zA-Z0-9_*&\s]+\s",
}
BODIED = {"typed method": r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^()]*\)\s*(?:throws\s+[^{]+)?\{", "typed function": r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\([^()]*\)\s*\{"}
# What declares a type, tried in this order.
CLASSES = [
    (r"(?m)^[\t ]*(?:export\s+)?(?:abstract\s+)?class\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", "class"),
    (r"(?m)^[\t ]*(?:export\s+)?interface\s+([a-zA-Z_$][a-zA-Z0-9_$]*)", "interface"),
    (r"(?m)^[\t ]*(?:export\s+)?type\s+([a-zA-Z_$][a-zA-Z0-9_$]*)\s*(?:<[^>]*>)?\s*=", "type_alias"),
    (r"(?m)^[\t ]*class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
    (r"(?m)^[\t ]*(?:pub(?:\([^)]*\))?\s+)?struct\s+([a-zA-Z_][a-zA-Z0-9_]*)", "struct"),
    (r"(?m)^[\t ]*(?:pub(?:\([^)]*\))?\s+)?enum\s+([a-zA-Z_][a-zA-Z0-9_]*)", "enum"),
    (r"(?m)^[\t ]*(?:pub(?:\([^)]*\))?\s+)?trait\s+([a-zA-Z_][a-zA-Z0-9_]*)", "trait"),
    (r"(?m)^[\t ]*impl(?:<[^>]*>)?\s+([a-zA-Z_][a-zA-Z0-9_]*)", "impl"),
    (r"(?m)^[\t ]*type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+struct", "struct"),
    (r"(?m)^[\t ]*type\s+([a-zA-Z_][a-zA-Z0-9_]*)\s+interface", "interface"),
    (r"(?m)^[\t ]*(?:class|module)\s+([a-zA-Z_][a-zA-Z0-9_:]*)", "class"),
    (r"(?m)^[\t ]*(?:abstract\s+)?(?:final\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
    (r"(?m)^[\t ]*(?:public\s+)?(?:abstract\s+)?(?:final\s+)?class\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
    (r"(?m)^[\t ]*(?:class|struct)\s+([a-zA-Z_][a-zA-Z0-9_]*)", "class"),
]
# Calls of methods, calls, and identifiers.
METHOD_CALL, CALL, IDENTIFIER = r"([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:\.|->)\s*([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", r"([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", r"[a-zA-Z_][a-zA-Z0-9_]*"
# What imports a module, the name in the first group or else in the second.
IMPORTS = [
    r"""(?m)^[\t ]*import\s+(?:\{[^}]*\}|[^'"]+)\s+from\s+['"]([@a-zA-Z0-9_./-]+)['"]""", r"""require\s*\(\s*['"]([@a-zA-Z0-9_./-]+)['"]\s*\)""",
    r"(?m)^[\t ]*(?:from\s+([a-zA-Z_][a-zA-Z0-9_.]*)\s+)?import\s+([a-zA-Z_][a-zA-Z0-9_.,\s]*)", r"(?m)^[\t ]*use\s+([a-zA-Z_][a-zA-Z0-9_:]*(?:::\{[^}]+\})?)",
    r"""(?m)^[\t ]*import\s+["]([a-zA-Z0-9_./-]+)["]""", r"""(?m)^[\t ]*require(?:_relative)?\s+['"]([@a-zA-Z0-9_./-]+)['"]""", r"(?m)^[\t ]*use\s+([a-zA-Z_\\][a-zA-Z0-9_\\]*)",
    r"(?m)^[\t ]*import\s+(?:static\s+)?([a-zA-Z_][a-zA-Z0-9_.]*(?:\.\*)?);", r"""(?m)^[\t ]*#include\s*[<"]([^>"]+)[>"]""",
]
#: What is made anew, in languages whose trees would show it: `new X` and literals of a type.
BUILD = {"javascript": r"\bnew\s+([A-Za-z_$][\w$]+)", "typescript": r"\bnew\s+([A-Za-z_$][\w$]+)", "rust": r"(?<![\w.])([A-Z]\w+)\s*\{", "go": r"(?<![\w.])&?([A-Z]\w+)\s*\{"}
_FUNCTIONS = [(name if name in BEFORE else re.compile(name), kind, always) for name, kind, always in FUNCTIONS]
_CLASSES = [(re.compile(p), kind) for p, kind in CLASSES]
_IMPORTS = [re.compile(p) for p in IMPORTS]
_BEFORE, _BODIED = ({k: re.compile(v) for k, v in t.items()} for t in (BEFORE, BODIED))
_METHOD_CALL, _CALL, _IDENTIFIER = map(re.compile, (METHOD_CALL, CALL, IDENTIFIER))
_BUILD = {k: re.compile(v) for k, v in BUILD.items()}


def builtin(name: str, language: str) -> bool:
    return name in BUILTINS.get(language, ())


class Places:
    """Offsets of a text to lines (from 1) and byte columns."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()
        self.starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def __call__(self, at: int) -> tuple[int, int]:
        k = bisect.bisect_right(self.starts, at) - 1
        start = self.starts[k]
        return k + 1, at - start if self.plain else len(self.text[start:at].encode("utf-8", "replace"))


def line_list(text: str) -> list[str]:
    """Lines without their ends; none after a last line end."""
    lines = text.split("\n")
    return [x.removesuffix("\r") for x in (lines[:-1] if lines[-1] == "" else lines)]


class Ends:
    """Estimates where what starts at a line ends: by braces, else by indent, else 50 lines on."""

    def __init__(self, lines: list[str]):
        self.n = len(lines)
        bare = [x.strip() for x in lines]
        self.indent = [len(x.encode("utf-8", "replace")) - len(x.lstrip().encode("utf-8", "replace")) for x in lines]
        self.deep, self.opens = [x.count("{") - x.count("}") for x in bare], ["{" in x for x in bare]
        self.ends = [bool(x) and not x.startswith("#") for x in bare]
        self.known: dict[int, int] = {}

    def __call__(self, start: int) -> int:
        if start not in self.known:
            self.known[start] = self._find(start)
        return self.known[start]

    def _find(self, start: int) -> int:
        if not 0 < start <= self.n:
            return start
        depth, opened, own = 0, False, self.indent[start - 1]
        for i in range(start - 1, self.n):
            depth += self.deep[i]
            opened = opened or self.opens[i]
            if opened and depth == 0:
                return i + 1
            if not opened and i >= start and self.ends[i] and self.indent[i] <= own:
                return i
        return min(start + 50, self.n)


def typed(which: str, text: str, starts: list[int]) -> Iterator[tuple[re.Match, str]]:
    """Names with a parameter list and a brace, after words that make them a typed method or function; and the whole declaration."""
    for m in _BODIED[which].finditer(text):
        k = bisect.bisect_right(starts, m.start()) - 1
        for at in (starts[k], starts[max(0, k - 1)]):  # the type may stand on the line above
            if at < m.start() and _BEFORE[which].fullmatch(text, at, m.start()):
                yield m, text[at : m.end()]
                break


def by_pattern(text: str, language: str = "unknown") -> list[tuple]:
    """(what, name, kind, line, end_line, col, exported, async) of a text in any language."""
    place, lines, out = Places(text), line_list(text), []
    end = Ends(lines)
    exported = lambda name, found: "export" in found or found.startswith("pub ") or name[0].isupper()
    functions: dict[tuple[str, int], tuple] = {}
    for pattern, kind, always in _FUNCTIONS:
        for m, found in typed(pattern, text, place.starts) if isinstance(pattern, str) else ((m, m[0]) for m in pattern.finditer(text)):
            name = m[1]
            line, col = place(m.start(1))
            if name not in KEYWORDS and (name, line) not in functions:
                functions[name, line] = ("symbol", name, kind, line, end(line), col, exported(name, found), always or "async" in found)
    out += sorted(functions.values(), key=lambda r: (r[1], r[3]))
    for pattern, kind in _CLASSES:
        for m in pattern.finditer(text):
            if m[1] not in KEYWORDS:
                line, col = place(m.start(1))
                out.append(("symbol", m[1], kind, line, end(line), col, exported(m[1], m[0]), False))
    seen = set()
    for pattern, k in ((_METHOD_CALL, 2), (_CALL, 1)):
        for m in pattern.finditer(text):
            name = m[k]
            if name not in KEYWORDS and not builtin(name, language):
                line, col = place(m.start(k))
                if k == 2 or (line, col) not in seen:
                    seen.add((line, col))
                    out.append(("call", name, "call", line, line, col, False, False))
    if language in _BUILD:
        for m in _BUILD[language].finditer(text):
            if m[1] not in KEYWORDS and not builtin(m[1], language):
                line, col = place(m.start(1))
                out.append(("type", m[1], "type", line, line, col, False, False))
    for pattern in _IMPORTS:
        for m in pattern.finditer(text):
            k = 1 if m[1] is not None else 2
            line, col = place(m.start(k))
            out.append(("import", m[k], "import", line, line, col, False, False))
    for m in _IDENTIFIER.finditer(text):
        if len(m[0]) > 1 and m[0] not in KEYWORDS:
            line, col = place(m.start())
            out.append(("token", m[0], "identifier", line, line, col, False, False))
    return [*out, ("scope", None, "file", 1, max(1, len(lines)), 0, False, False)]


def python_tokens(text: str) -> Iterator[tuple]:
    """Identifiers of two bytes or more, comments and literals of a Python text."""
    lines = text.split("\n")
    literal = {tokenize.STRING, tokenize.NUMBER} | {getattr(tokenize, n) for n in ("FSTRING_MIDDLE",) if hasattr(tokenize, n)}
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        line, at = t.start
        col = len(lines[line - 1][:at].encode("utf-8", "replace")) if line <= len(lines) else 0
        if t.type == tokenize.NAME and not keyword.iskeyword(t.string) and len(t.string.encode()) > 1:
            yield ("token", t.string, "identifier", line, line, col, False, False)
        elif t.type == tokenize.COMMENT:
            yield ("token", t.string, "comment", line, line, col, False, False)
        elif t.type in literal:
            yield ("token", t.string, "literal", line, t.end[0], col, False, False)


def by_python_tree(text: str) -> list[tuple]:
    """The same rows from Python's syntax tree; raises SyntaxError on other text."""
    tree, out = ast.parse(text), []
    lines = text.split("\n")

    def visit(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            inner = in_class
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                at = lines[child.lineno - 1].encode().find(child.name.encode(), child.col_offset)
                is_async = isinstance(child, ast.AsyncFunctionDef)
                out.append(("symbol", child.name, "method" if in_class else "function", child.lineno, child.end_lineno, at, False, is_async))
                out.append(("scope", child.name, "function", child.lineno, child.end_lineno, child.col_offset, False, is_async))
                inner = False
            elif isinstance(child, ast.ClassDef):
                at = lines[child.lineno - 1].encode().find(child.name.encode(), child.col_offset)
                out.append(("symbol", child.name, "class", child.lineno, child.end_lineno, at, False, False))
                out.append(("scope", child.name, "class", child.lineno, child.end_lineno, child.col_offset, False, False))
                inner = True
            elif isinstance(child, ast.Lambda | ast.For | ast.While | ast.If | ast.With | ast.Try | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
                kind = "lambda" if isinstance(child, ast.Lambda) else "comprehension" if isinstance(child, ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp) else "block"
                out.append(("scope", None, kind, child.lineno, child.end_lineno, child.col_offset, False, False))
            if isinstance(child, ast.Call):
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name and not builtin(name, "python"):
                    col = f.col_offset if isinstance(f, ast.Name) else f.end_col_offset - len(name.encode())
                    out.append(("call", name, "call", f.end_lineno, f.end_lineno, col, False, False))
            elif isinstance(child, ast.Import):
                out.extend(("import", a.name, "import", child.lineno, child.lineno, child.col_offset, False, False) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                out.append(("import", "." * child.level + (child.module or ""), "import", child.lineno, child.lineno, child.col_offset, False, False))
            visit(child, inner)

    visit(tree, False)
    return [*out, *python_tokens(text), ("scope", None, "file", 1, max(1, len(line_list(text))), 0, False, False)]


def rows_of(text: str | None, language: str) -> list[tuple]:
    """Rows of one file with the method that made them; none for a blank file."""
    if not text or not text.strip():
        return []
    if language == "python":
        try:
            return [(*r, "tree") for r in by_python_tree(text)]
        except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
            pass
    return [(*r, "pattern") for r in by_pattern(text, language)]


def extract(files: DataFrame) -> DataFrame:
    """All rows of files (file_id, path, language, content), in the order of ord within a file."""
    fields = StructType.fromDDL(FIELDS)
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for f, p, lang, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(f, p, *r, i) for i, r in enumerate(rows_of(text, lang))]
                if len(out) > 50_000:  # a few files' rows at a time
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return files.select("file_id", "path", "language", "content").mapInArrow(run, fields)


def with_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Ids that depend on the row alone (file, place, name), so that files can be extracted anew one by one."""
    w = Window.partitionBy("file_id").orderBy(*order)
    return df.withColumn(name, F.col("file_id") * (1 << 24) + F.row_number().over(w))


#: Kinds of extraction that the graph names otherwise.
GRAPH_KINDS = {"trait": "interface", "impl": "unknown"}


def build(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, tokens, refs, edges, scopes of a set of files. Extraction runs once, into the shared folder.

    A name that several patterns declare on one line is one symbol: of the first pattern's kind, exported or asynchronous if any says so.
    """
    rows = stored(extract(files), "extracted")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GRAPH_KINDS.items() for x in kv]), F.col("kind")), F.col("kind"))
    s = rows.where("what = 'symbol'").groupBy("file_id", "path", "name", "line").agg(F.min_by(kind, "ord").alias("kind"), F.max("end_line").alias("end_line"), F.bool_or("is_exported").alias("is_exported"), F.bool_or("is_async").alias("is_async"))
    s = with_ids(s, "symbol_id", "line", "name").select("symbol_id", "name", "file_id", "kind", resolve.is_entry(F.col("kind"), F.col("name"), F.col("path"), F.col("is_exported")).alias("is_entry"), "is_exported", "is_async", F.col("line").alias("start_line"), "end_line")
    t = rows.where("what in ('call', 'type', 'import', 'token')").select("file_id", "name", "line", "col", F.when(F.col("what") != "token", F.col("what")).when(F.col("kind") == "identifier", "identifier").otherwise("unknown").alias("kind"))
    t = with_ids(t, "token_id", "line", "col", "kind", "name").select("token_id", "name", "file_id", "line", "col", "kind")
    s, t = stored(s, "symbols"), stored(t, "graph-tokens")
    c = with_ids(rows.where("what = 'scope'"), "scope_id", "line", F.desc("end_line"), "col").select("scope_id", "file_id", "kind", "name", F.col("line").alias("start_line"), "end_line")
    refs = resolve.call_refs(t, s).unionByName(resolve.construction_refs(t, s))
    return {"symbols": s, "tokens": t, "refs": refs, "edges": resolve.call_edges(t, s), "scopes": scope_parents(c)}


def scope_parents(scopes: DataFrame, bucket: int = resolve.BUCKET) -> DataFrame:
    """scopes with parent_id: the smallest other scope around each; null for the outermost.

    Scopes of ordinary length are listed under the blocks of lines that they touch and meet a scope's first
    line there; the few that span many blocks go by file.
    """
    at = lambda line: F.floor(F.col(line) / bucket)
    own = scopes.select("scope_id", "file_id", "start_line", "end_line", at("start_line").alias("k"))
    outer = scopes.select("file_id", F.col("scope_id").alias("p"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"), at("start_line").alias("k0"), at("end_line").alias("k1"))
    short = outer.where("k1 - k0 <= 16").withColumn("k", F.explode(F.sequence("k0", "k1"))).drop("k0", "k1")
    long = outer.where("k1 - k0 > 16").drop("k0", "k1")
    around = "p <> scope_id and ps <= start_line and pe >= end_line and (pe - ps > end_line - start_line or p < scope_id)"
    found = own.join(short, ["file_id", "k"]).where(around).select("scope_id", "p", "ps", "pe").unionByName(own.join(long, "file_id").where(around).select("scope_id", "p", "ps", "pe"))
    best = found.groupBy("scope_id").agg(F.min_by("p", F.struct(F.col("pe") - F.col("ps"), -F.col("p"))).alias("parent_id"))
    return scopes.join(best, "scope_id", "left")
