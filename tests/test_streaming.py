"""The event stream against the same operators in batch."""

from pyspark.sql import functions as F

from lodegraph.sources import adapters
from lodegraph.streaming import events


def drain(df, spark, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def parts(spark, sf, tmp_path):
    adapters.read(spark, sf, "events").orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def test_windows_equal_batch(spark, sf, tmp_path):
    live = events.stream(spark, parts(spark, sf, tmp_path))
    got = drain(events.per_window(live, "1 hour"), spark, "w", "complete")
    want = events.per_window(adapters.file_events(spark, sf), "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_last_event_in_sessions(spark, sf, tmp_path):
    live = events.stream(spark, parts(spark, sf, tmp_path), per_trigger=1)
    got = {tuple(r) for r in drain(events.last_wins(live, "5 minutes"), spark, "l").collect()}
    want = {tuple(r) for r in events.last_wins(adapters.file_events(spark, sf), "5 minutes").collect()}
    assert got and got <= want  # sessions after the watermark are still open


def test_apply_and_repeats(spark, sf, tmp_path):
    folder, seen = parts(spark, sf, tmp_path), []
    twice = events.once(events.stream(spark, folder))
    q = events.apply_to(twice, lambda df, epoch: seen.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    want = adapters.file_events(spark, sf).select("project", "path").distinct().count()
    assert len({(r.project, r.path) for r in seen}) == want


def test_unusable_events_go(spark):
    df = spark.createDataFrame([("create", "a/b.rs"), ("remove", "a/b.py"), ("access", "a/b.rs"), ("modify", "a/b.bin"), ("modify", ".git/b.rs")], "action string, path string")
    assert [r.action for r in events.usable(df).orderBy("path").collect()] == ["deleted", "changed"]
    assert df.select(F.count_if(events.classify(F.col("action")).isNull())).first()[0] == 1


A = "def main():\n    helper()\n\ndef helper():\n    other()\n"
B = "def other():\n    pass\n\ndef unused():\n    main()\n"


def names(index):
    t = index.tables
    s = t["symbols"].select(F.col("symbol_id").alias("i"), "name")
    e = t["edges"].join(s.toDF("from_symbol", "a"), "from_symbol").join(s.toDF("to_symbol", "b"), "to_symbol")
    return sorted(r.name for r in s.collect()), sorted((r.a, r.b, r.line) for r in e.collect()), sorted(r.path for r in t["files"].collect())


def test_index_follows_events(spark, tmp_path):
    from lodegraph.operators.index import TextIndex
    from lodegraph.streaming.maintain import Maintained, relay

    tree = {"a.py": A, "b.py": B}

    def read(paths):
        rows = [(r.path, "python", tree[r.path]) for r in paths.collect() if r.path in tree]
        return spark.createDataFrame(rows, "path string, language string, content string")

    index = Maintained(spark, f"file://{tmp_path}/index", "p", read)
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    index.start(paths("a.py", "b.py"))
    assert names(index)[1] == [("helper", "other", 5), ("main", "helper", 2), ("unused", "main", 5)]

    log = "seq long, ts timestamp, project string, path string, action string"
    folder = str(tmp_path / "log")
    batches = [
        ([(1, "p", "c.py", "changed"), (2, "q", "a.py", "deleted"), (3, "p", "b.py", "deleted"), (4, "p", "b.py", "changed")], {"c.py": "def other():\n    helper()\n", "b.py": "def unused():\n    helper()\n"}),
        ([(5, "p", "a.py", "deleted"), (6, "p", "nowhere.py", "changed")], {"a.py": None}),
    ]
    seq = spark.createDataFrame([], log)
    seq.write.parquet(folder)
    live = spark.readStream.schema(log).parquet(folder)
    q = index.follow(live, str(tmp_path / "check"))
    q.processAllAvailable()
    for rows, changes in batches:
        for path, text in changes.items():
            tree.update({path: text}) if text else tree.pop(path)
        df = spark.createDataFrame([(i, *rest) for i, *rest in rows], "seq long, project string, path string, action string")
        df.select("seq", F.timestamp_seconds("seq").alias("ts"), "project", "path", "action").coalesce(1).write.mode("append").parquet(folder)
        q.processAllAvailable()
        whole = Maintained(spark, f"file://{tmp_path}/whole{len(tree)}", "p", read)
        whole.start(paths(*tree))
        assert names(index) == names(whole)
        found = {r.path for r in index.text.search("helper").collect()}
        assert found == {p for p, t in tree.items() if "helper" in t}
    q.stop()
    again = Maintained(spark, f"file://{tmp_path}/index", "p", read).open()
    assert names(again) == names(index) and {r.path for r in TextIndex.open(spark, f"file://{tmp_path}/index/text").search("helper").collect()} == found
    before = again.version
    again.apply(spark.createDataFrame([("c.py", "deleted")], "path string, action string"), again.epoch)
    assert again.version == before  # a batch that is run again does nothing
    said = [r.event for r in index.events().orderBy("at").collect()]
    assert said.count("reindex_start") == 3 and said.count("reindex_complete") == 3 and {"file_changed", "reindex_progress"} <= set(said)
    sent = drain(relay(spark, f"file://{tmp_path}/index"), spark, "sse").collect()
    assert len(sent) == len(said) and any(r.value.startswith("event: reindex_complete\ndata: {") for r in sent)
    assert index.snapshot("2024-01-02 03:04:05").first().metrics.symbols == len(names(index)[0])
