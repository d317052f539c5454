"""Forms of results for display, search lines, labels, numbering."""

from pyspark.sql import functions as F

from lodegraph.operators import dashboard, export, trace
from lodegraph.session import ranked


def refs(spark):
    rows = [("a.py", 3, 7, "call", "  x = f(1)\n  y", "main"), ("a.py", 9, 0, "read", "say, \"hi\"", None), ("b.py", 1, 2, "call", None, None)]
    return spark.createDataFrame(rows, "file string, line int, column int, kind string, context string, enclosing_symbol string")


def test_csv(spark):
    assert export.csv_text("refs", refs(spark)) == 'file,line,column,kind,context,enclosing_symbol\na.py,3,7,call,x = f(1),main\na.py,9,0,read,"say, ""hi""",\nb.py,1,2,call,,\n'
    stats = spark.createDataFrame([(3, 12)], "total_files long, total_symbols long")
    assert export.csv_text("stats", stats) == "metric,value\ntotal_files,3\ntotal_symbols,12\n"
    assert set(export.HEADERS) == set(export.TITLES) and len(export.HEADERS) == 9


def test_plain_and_boxed(spark):
    text = export.plain_text("refs", refs(spark), "f")
    assert text.startswith("REFS: f\nFound: 3\n" + "-" * 60 + "\n\na.py:\n  3:7 call x = f(1) main\n") and "\nb.py:\n  1:2 call\n" in text
    box = export.boxed("refs", refs(spark), "f", 20).split("\n")
    assert {len(x) for x in box if x} == {22} and box[1] == "║REFS: f             ║" and "..." in box[3]


def test_dot_and_markdown(spark):
    e = spark.createDataFrame([("x", "y"), ("x", "y"), ('q"', "x")], "a string, b string")
    assert export.dot(e, "a", "b") == 'digraph trace {\n  "q\\"" -> "x";\n  "x" -> "y";\n}'
    assert export.markdown(e.limit(1)) == "| a | b |\n|---|---|\n| x | y |"


def test_search_lines_round_trip():
    for line in ("state:dead", "kind:function file:src/** refs:>3 entry:true foo", "has:callers has:callees", "refs:4 x y", *dashboard.PRESETS.values()):
        assert dashboard.parse(dashboard.to_query(dashboard.parse(line))) == dashboard.parse(line)
    assert dashboard.to_query(dashboard.parse("refs:<3 entry:false")) == ""


def test_labels_and_links(spark):
    df = spark.createDataFrame([("short",), ("a_long_name",)], "n string")
    assert [r[0] for r in df.select(dashboard.short_label(F.col("n"), 48)).collect()] == ["short", "a_long.."]
    assert [r[0] for r in df.select(dashboard.short_label(F.col("n"), 20)).collect()] == ["", ""]
    cross = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (1, 3)], "from_file long, to_file long")
    kept = dashboard.roles(cross)
    assert {(r.file, r.role) for r in kept.collect()} == {(1, "entry"), (2, "internal"), (3, "leaf")}
    assert {tuple(r) for r in dashboard.role_links(cross, kept).collect()} == {(1, 2, 2), (2, 3, 1)}


def test_cycle_paths_and_numbers(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (2, 1)], "a long, b long")
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)], "node long, component long")
    assert {r.component: list(r.chain) for r in trace.cycle_paths(e, found).collect()} == {1: [1, 2, 1], 5: [5, 6, 5]}
    n = ranked(spark.range(1000).repartition(7), "n", F.desc("id"))
    assert {(r.id, r.n) for r in n.collect()} == {(i, 1000 - i) for i in range(1000)}
