"""Extraction, walking, snapshots, dashboard language, on literal inputs."""

import json

from pyspark.sql import functions as F

from lodegraph.operators import dashboard, extract, lines, search, snapshots
from lodegraph.sources import files


def names(text, language, what="symbol"):
    return [r[1] for r in extract.rows_of(text, language) if r[0] == what]


def test_javascript():
    text = "function greet(n) {\n  return n;\n}\nexport function farewell() { }\nconst add = (a, b) => a + b;\nasync function fetchData() { greet(); obj.method(); nested.deep.call(); }\n"
    assert {"greet", "farewell", "add", "fetchData"} <= set(names(text, "javascript"))
    by = {r[1]: r for r in extract.rows_of(text, "javascript") if r[0] == "symbol"}
    assert by["farewell"][6] and by["fetchData"][7] and by["greet"][3:5] == (1, 3)
    assert {"greet", "method", "call"} <= set(names(text, "javascript", "call"))


def test_imports():
    text = "import { a } from './module';\nimport b from 'package';\nconst c = require('path');\n"
    assert {"./module", "package", "path"} <= set(names(text, "javascript", "import"))


def test_python_tree_and_fallback():
    text = "class MyClass:\n    def __init__(self):\n        self.get_value()\n    async def get_value(self):\n        return helper(1)\n\ndef standalone():\n    pass\n"
    by = {r[1]: r for r in extract.rows_of(text, "python") if r[0] == "symbol"}
    assert set(by) == {"MyClass", "__init__", "get_value", "standalone"}
    assert by["__init__"][2] == "method" and by["standalone"][2] == "function" and by["get_value"][7] and by["MyClass"][3:5] == (1, 5)
    assert names(text, "python", "call") == ["get_value", "helper"]
    kinds = {(r[1], r[2]) for r in extract.rows_of("x1 = 'a b'  # note\n", "python") if r[0] == "token"}
    assert kinds == {("x1", "identifier"), ("'a b'", "literal"), ("# note", "comment")}
    assert {r[-1] for r in extract.rows_of("def broken(:\n  x\n", "python")} == {"pattern"}
    assert extract.rows_of("  \n", "python") == extract.rows_of(None, "go") == []


def test_rust_and_go():
    assert [(r[1], r[2]) for r in extract.rows_of("class Aa {}\n", "java") if r[0] == "symbol"] == [("Aa", "class")] * 6
    rust = "pub struct MyStruct { x: i32 }\nimpl MyStruct {\n    pub fn new() -> Self {\n        Self { x: 1 }\n    }\n}\nfn helper() {}\n"
    found = [(r[1], r[2], r[3], r[4]) for r in extract.rows_of(rust, "rust") if r[0] == "symbol"]
    assert ("MyStruct", "struct", 1, 1) in found and ("MyStruct", "impl", 2, 6) in found and ("new", "function", 3, 5) in found and ("helper", "function", 7, 7) in found
    go = "type T struct {\n}\nfunc (t *T) Do() {\n}\nfunc main() { t.Do() }\n"
    assert {"T", "Do", "main"} <= set(names(go, "go"))


GOLDEN = {
    "ruby": ("class Dog\n  def bark!\n    require 'set'\n  end\nend\n", {("bark!", "method", 2), ("Dog", "class", 1)}, {"set"}),
    "php": ("<?php\nuse App\\Models;\nabstract class Cart {\n  public static function total($x) {\n  }\n}\n", {("total", "function", 4), ("Cart", "class", 3)}, {"App", "App\\Models"}),
    "java": ("import java.util.List;\npublic class Main {\n  public static void main(String[] args) throws Exception {\n    run();\n  }\n}\n", {("main", "method", 3), ("Main", "class", 2)}, {"java.util.List"}),
    "c": ("#include <stdio.h>\nstatic inline int add(int a, int b) {\n  return a;\n}\nint\nmain(void)\n{\n}\n", {("add", "method", 2), ("main", "method", 6)}, {"stdio.h"}),
    "lua": ("local function a.b:c(x)\nend\n", {("a.b:c", "function", 1)}, set()),
    "elixir": ("defp run(x) do\nend\n", {("run", "function", 1)}, set()),
    "haskell": ("swap' :: a -> a\n", {("swap'", "function", 1)}, set()),
    "go": ("import \"fmt\"\nfunc (r *Rec) Do(x int) {\n}\ntype T interface {\n}\n", {("Do", "function", 2), ("T", "interface", 4)}, {"fmt"}),
    "typescript": ("export interface I {}\nexport type Id<T> = T | null;\nexport const run = async (a) => 1;\nimport { x } from '@a/b';\n", {("I", "interface", 1), ("Id", "type_alias", 2), ("run", "function", 3)}, {"@a/b"}),
    "kotlin": ("class K\nfun x() {}\n", {("K", "class", 1), ("x", "method", 2)}, set()),
}


def test_golden_files():
    for language, (text, symbols, imports) in GOLDEN.items():
        rows = extract.by_pattern(text, language)
        found = {(r[1], r[2], r[3]) for r in rows if r[0] == "symbol"}
        assert symbols <= found, (language, found)
        assert {x for x, _, _ in symbols} >= {x for x, _, _ in found} - {"MyStruct"}, (language, found)
        assert imports <= {r[1].strip() for r in rows if r[0] == "import"}, language


def test_calls_and_words():
    text = "function main() {\n  greet('x'); obj.method(); a->b(); console.log(1); if (y) {}\n}\n"
    calls = [(r[1], r[3], r[5]) for r in extract.by_pattern(text, "javascript") if r[0] == "call"]
    assert calls == [("method", 2, 18), ("b", 2, 31), ("main", 1, 9), ("greet", 2, 2)]
    assert [r[1] for r in extract.by_pattern(text, "lua") if r[0] == "call" and r[1] == "log"] == ["log"]  # built in elsewhere only
    assert not extract.builtin("len", "javascript") and extract.builtin("len", "go")


def test_prose_takes_no_powers_of_time():
    import time

    began = time.time()
    for text in ("word " * 20_000, "int a " * 5000 + "(", " \n" * 20_000, "public static " * 5000, "f(" * 20_000):
        extract.by_pattern(text, "java")
    assert time.time() - began < 20


def test_words_before_a_function_on_lines_above():
    """Looking at one line only finds the same names as words and white space from any line before."""
    import random
    import re

    whole = re.compile(r"(?m)^[\t ]*(?:public|private|protected|static|\s)*function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(")
    line = next(p for p, _, _ in extract._FUNCTIONS if not isinstance(p, str) and "protected" in p.pattern)
    rng = random.Random(5)
    parts = ["public", "private", "static", "protected", "function", "function f(", "function\n g (", " ", "\n", "\t", "\r\n", "\x0c", "\x85", "x", "(", "f", ";"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        want = [(m[1], m.start(1), m.end()) for m in whole.finditer(text)]
        assert [(m[1], m.start(1), m.end()) for m in line.finditer(text)] == want, text
        found += bool(want)
    assert found > 1000


def test_blank_lines_take_no_square_of_time():
    import time

    began = time.process_time()
    extract.by_pattern(" \n" * 20_000, "java")
    assert time.process_time() - began < 5


def test_ends():
    for text, start, end in (("f {\n {\n}\n}\nx", 1, 4), ("def a:\n  x\n\n# no\n  y\nz\n", 1, 5), ("a\n" + "  b\n" * 80, 1, 51), ("a", 1, 1), ("", 3, 3)):
        assert extract.Ends(extract.line_list(text))(start) == end, text


def test_columns_are_bytes():
    assert [r[5] for r in extract.rows_of("é = call(1)\n", "python") if r[0] == "call"] == [5]


def test_chunks_cover_all_lines(spark):
    for n in (0, 1, 5, 44, 50, 51, 95, 96, 140, 141, 400):
        df = spark.createDataFrame([(1, "p", "x", "".join(f"l{i}\n" for i in range(1, n + 1)))], "file_id long, path string, language string, content string")
        got = [(r.start_line, r.end_line) for r in lines.chunks(df).orderBy("start_line").collect()]
        want, s = [], 0
        while s < n:
            want.append((s + 1, min(s + 50, n)))
            if s + 50 >= n:
                break
            s += 45
        assert got == want, n


def test_walk_and_store(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def a():\n    b()\n\ndef b():\n    pass\n")
    (tmp_path / "src/big.py").write_text("x" * 3000)
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden/x.py").write_text("x = 1")
    (tmp_path / "_own").mkdir()
    (tmp_path / "_own/__init__.py").write_text("y = 1")
    (tmp_path / "build.log").write_text("no")
    (tmp_path / "gen").mkdir()
    (tmp_path / "gen/g.py").write_text("g = 1")
    (tmp_path / "Cargo.toml").write_text("[package]\n")
    df = files.walk(spark, str(tmp_path), largest=2000, rules="gen/\n# note\n!gen/keep.py\n")
    assert sorted(r.path for r in df.collect()) == ["Cargo.toml", "_own/__init__.py", "src/a.py"]
    (tmp_path / "src/.gitignore").write_text("b*.py\n")
    (tmp_path / "src/b1.py").write_text("b = 1")
    rules = files.ignore_files(spark, str(tmp_path))
    assert rules == {"src": "b*.py\n"}
    assert sorted(r.path for r in files.walk(spark, str(tmp_path), largest=2000, rules=rules).collect()) == ["Cargo.toml", "_own/__init__.py", "gen/g.py", "src/a.py"]
    index = extract.build(df)
    files.save(index, str(tmp_path / "out/index"))
    back = files.load(spark, str(tmp_path / "out/index"))
    assert back["edges"].count() == 1 and back["symbols"].count() == 2
    assert files.project_root(str(tmp_path / "src")) == str(tmp_path) and files.project_type(str(tmp_path)) == "rust"
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / ".git").mkdir()
    assert files.project_type(str(tmp_path)) == "git"
    found = files.discover([str(tmp_path.parent)], active=(str(tmp_path),))
    assert found[0]["active"] and found[0]["path"] == str(tmp_path)
    r = files.Registry(str(tmp_path / "r.json"))
    r.remember({"path": "a"}), r.remember({"path": "b"}), r.remember({"path": "a"})
    assert [p["path"] for p in r.read()] == ["a", "b"] and [p["path"] for p in r.forget("a")] == ["b"]


def test_ids_of_paths(spark):
    many = spark.range(5000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"))
    ids = {r.path: r.file_id for r in files.numbered(many.unionByName(many)).collect()}
    assert [ids[p] for p in sorted(ids)] == list(range(5000))
    known = spark.createDataFrame([(p, i) for p, i in list(ids.items())[:10]], "path string, file_id long")
    more = {r.path: r.file_id for r in files.numbered(spark.createDataFrame([("new",), (list(ids)[3],), ("a",)], "path string"), known).collect()}
    top = max(list(ids.values())[:10])
    assert more == {"a": top + 1, "new": top + 2, list(ids)[3]: ids[list(ids)[3]]}
    zero = spark.createDataFrame([("x", 0)], "path string, file_id long")
    assert {r.path: r.file_id for r in files.numbered(spark.createDataFrame([("x",), ("y",)], "path string"), zero).collect()} == {"x": 0, "y": 1}


def test_ignore_rules():
    import re

    for rule, path, hit in [("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("/a", "a/b", True), ("/a", "x/a", False), ("doc/*.md", "doc/x.md", True), ("doc/*.md", "doc/y/x.md", False), ("**/t", "a/b/t", True), ("t/", "t/x", True), ("t/", "t", False)]:
        assert bool(re.search(files.rule_pattern(rule)[1], path)) == hit, (rule, path)


def test_search_language():
    assert dashboard.parse("kind:function state:dead refs:>3 callers:<2 callees:4 file:src/* foo bar kind:odd refs:>0") == {"text": "foo bar", "kinds": ["function"], "state": "dead", "refs": (None, None), "callers": (None, 2), "callees": (4, 4), "file": "src/*"}


def test_redaction(spark):
    shown = {".env": "[HIDDEN]", ".env.local": "[HIDDEN].local", "config/secrets.json": "config/[HIDDEN].json", "credentials.txt": "[HIDDEN].txt", "src/main.rs": "src/main.rs", "README.md": "README.md", "src/token.rs": "src/token.rs",
             "home/.aws/x": "home/.aws/[HIDDEN]", ".ssh/id": ".ssh/[HIDDEN]", "config/production.yml": "config/[HIDDEN].yml", "a/b.pem": "a/[HIDDEN].pem", "c.key": "[HIDDEN].key", "a/config/production.x": "a/config/[HIDDEN].x"}
    df = spark.createDataFrame([(p,) for p in shown], "path string")
    assert {r[0]: r[1] for r in df.select("path", dashboard.redacted(F.col("path"))).collect()} == shown
    assert all(r[0] == r[1] for r in df.select("path", dashboard.redacted(F.col("path"), on=False)).collect())


def test_tests_and_generated_files(spark):
    paths = {"src/__tests__/foo.test.ts": "t", "pkg/auth/auth_test.go": "t", "src/auth/handler.ts": "", "src/api.min.js": "g", "a/node_modules/foo/index.js": "g", "x/conftest.py": "t", "a/gen/x.rs": "g", "a/.next/x": "g", "a/x.pb.go": "g", "x/__mocks__/a.js": "t", "a/target/x": "", "a/vendor/x": ""}
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", search.is_test_path(F.col("path")).alias("t"), search.is_generated_path(F.col("path")).alias("g"))
    assert {r.path: "t" * r.t + "g" * r.g for r in df.collect()} == paths


def test_natural_language(spark):
    said = {"how does auth work": True, "what calls the login function": True, "show all references to userId": True, "validateEmail": False, "auth": False, "UserService": False, "list users": True, "get all the tokens": True, "run this is fast": False, "": False}
    df = spark.createDataFrame([(q,) for q in said], "q string")
    assert {r[0]: r[1] for r in df.select("q", search.natural(F.col("q"))).collect()} == said


def test_replies():
    assert search.parsed_names('Here: ["auth", "login", 3] ok') == ["auth", "login"] and search.parsed_names("none") == []
    assert search.parsed_indices("[2, 0, 10, 1, 3]", 5) == [2, 0, 1, 3] and search.parsed_indices("no", 3) == [0, 1, 2]
    assert search.parsed_analysis('x {"intent": "trace", "symbols": ["login"], "filters": null} y') == {"intent": "trace", "symbols": ["login"], "filters": None}
    assert search.expanded("how does it work", lambda q: '["a", "b"]', True) == ["a", "b"] and search.expanded("x") == ["x"]
    assert search.expanded("aNameThatIsVeryLong", lambda q: '["a"]', False) == ["aNameThatIsVeryLong"]
    assert search.reordered([1, 2, 3, 4], lambda rows: "[3, 3, 0]") == [4, 1, 2, 3] and search.reordered([1, 2], lambda rows: "[1, 0]") == [1, 2]


def plain_block(lines, at, most=60):
    i = at - 1
    first = last = i
    depth = 0
    for k in range(i, -1, -1):
        depth += lines[k].count("}") - lines[k].count("{")
        if (depth <= 0 and "{" in lines[k]) or i - k > most // 2:
            first = k
            break
    depth = 0
    for k in range(i, len(lines)):
        depth += lines[k].count("{") - lines[k].count("}")
        if (depth <= 0 and "}" in lines[k]) or k - i > most // 2:
            last = k
            break
    return first + 1, last + 1


def test_blocks(spark):
    import random

    rng = random.Random(1)
    text = [rng.choice(["x", "a {", "}", "{ }", "} else {", "", "y"]) for _ in range(150)]
    rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(text)], "file_id long, line int, text string")
    for most in (60, 8):
        got = {r.line: (r.first, r.last) for r in lines.enclosing_block(rows, rows.select("file_id", "line"), most).collect()}
        assert got == {i + 1: plain_block(text, i + 1, most) for i in range(150)}


def test_declared_names(spark):
    said = {
        "fn run(x)": ("run", None, None), "  function go (a) {": ("go", None, None), "\tdef f(self):": ("f", None, None), "func (r *R) Do()": (None, None, None), "const add = (a) => a": ("add", None, None), "let x= function() {}": ("x", None, None),
        "export function out(": ("out", None, None), "export const k = () => 1": ("k", None, None), "const n = 1": (None, None, None), "class Dog(Animal):": (None, "Dog", None), "pub struct P<T> {": (None, "P", None), "impl<T> Bar<T> for X {": (None, "Bar", None),
        "impl Foo {": (None, "Foo", None), "pub fn new(x)": (None, None, "new"), "pub async fn go2(": (None, None, "go2"), "async load(x) {": (None, None, "load"),
    }
    df = spark.createDataFrame([(t,) for t in said], "t string").select("t", lines.function_name(F.col("t")), lines.class_name(F.col("t")), lines.method_name(F.col("t")))
    assert {r[0]: tuple(r)[1:] for r in df.collect()} == said


def test_rerank_and_semantic(spark):
    got = spark.createDataFrame([("[2, 0, 10, 1, 3]", 5), ("[1,1]", 3), ("none", 2)], "r string, n int").select(search.valid_order(F.coalesce(search.parsed_order(F.col("r")), F.array().cast("array<int>")), F.col("n"))).collect()
    assert [list(r[0]) for r in got] == [[2, 0, 1, 3, 4], [1, 0, 2], [0, 1]]
    docs = spark.createDataFrame([(f"d{i}", f"p{i}", "alpha " * (i + 1) + "beta", 1, 5) for i in range(4)], "id string, path string, content string, start_line int, end_line int")
    plain = search.semantic(docs, "alpha", 3)
    turned = search.semantic(docs, "alpha", 3, lambda q, texts: [2, 99, 0])
    assert [r["id"] for r in turned[:2]] == [plain[2]["id"], plain[0]["id"]] and len(turned) == 3


def test_snapshots_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a/x", "function", True, False), (2, "a/y", "class", False, True)], "symbol_id long, path string, kind string, is_entry boolean, dead boolean")
    cycles = spark.createDataFrame([(1,)], "component long")
    s = snapshots.create(rows, cycles, "2024-01-02 03:04:05", "p", "first")
    s.write.json(str(tmp_path / "s"))
    (tmp_path / "s/broken.json").write_text("{nope")
    back = snapshots.read(spark, str(tmp_path / "s"))
    got = [r for r in back.collect() if r.id]
    assert got[0].id == "20240102_030405" and got[0].metrics.by_kind == {"class": 1, "function": 1} and got[0].metrics.dead == 1


def test_tree_nesting():
    rows = [{"path": p} for p in ("s", "s/b.rs", "s/a", "s/a/x.rs", "s/A.rs")]
    assert json.dumps([[c["name"] for c in r["children"]] for r in dashboard.nested(rows)]) == '[["a", "A.rs", "b.rs"]]'
