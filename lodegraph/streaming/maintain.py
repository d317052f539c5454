"""An index that follows file events: text and graph updated batch by batch, with an event log and snapshots.

Each batch replaces what the touched files hold and leaves the tables as a full build of the files as they are now
would. Versions are written beside each other and the last one is named by the log, so a reader keeps what it has
open, and a batch that is run again after a failure is applied once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dashboard, extract, graph, incremental, lines, snapshots, trace
from ..operators.index import TextIndex
from ..sources import files as sources

EVENTS = "at timestamp, event string, project string, detail string"
TABLES = ("files", "symbols", "tokens", "refs", "edges")


class Maintained:
    """A project's index in a shared folder. read: rows (path, language, content) of the paths (path) that are given to it."""

    def __init__(self, spark: SparkSession, folder: str, project: str, read: Callable[[DataFrame], DataFrame]):
        self.spark, self.folder, self.project, self.read = spark, folder.rstrip("/"), project, read
        self.version, self.epoch, self.tables = "", -1, {}
        self.text = TextIndex(spark, f"{self.folder}/text")

    # -- log ---------------------------------------------------------------
    def tell(self, event: str, **detail) -> None:
        """Append one event to the log."""
        row = self.spark.createDataFrame([(event, self.project, json.dumps(detail))], "event string, project string, detail string")
        row.select(F.current_timestamp().alias("at"), "event", "project", "detail").coalesce(1).write.mode("append").json(f"{self.folder}/events")

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).json(f"{self.folder}/events")

    # -- state -------------------------------------------------------------
    def _keep(self, tables: dict[str, DataFrame], epoch: int, touched: int) -> None:
        version = uuid.uuid4().hex
        for i, name in enumerate(TABLES):
            tables[name].write.parquet(f"{self.folder}/graph/{version}/{name}")
            self.tell("reindex_progress", done=i + 1, of=len(TABLES), table=name)
        self.tables = {name: self.spark.read.parquet(f"{self.folder}/graph/{version}/{name}") for name in TABLES}
        self.version, self.epoch = version, epoch
        s = self.tables
        dead = trace.dead(s["symbols"], s["edges"], s["refs"]).count()
        self.tell("reindex_complete", version=version, epoch=epoch, files=touched, symbols=s["symbols"].count(), dead=dead, text=self.text.steps)

    def open(self) -> Maintained:
        """The state that the log names last."""
        last = self.events().where("event = 'reindex_complete'").orderBy(F.desc("at")).first()
        if last is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        found = json.loads(last.detail)
        self.version, self.epoch = found["version"], found["epoch"]
        self.tables = {name: self.spark.read.parquet(f"{self.folder}/graph/{self.version}/{name}") for name in TABLES}
        self.text = TextIndex(self.spark, f"{self.folder}/text", found["text"])
        return self

    def start(self, paths: DataFrame) -> None:
        """A full build of the files with these paths (path)."""
        self.tell("reindex_start")
        rows = self.read(paths)
        files = rows.join(sources.numbered(rows.select("path")), "path")
        self.text.add(lines.chunks(files).select("id", "path", "content", "start_line", "end_line"))
        self._keep({"files": files.select("file_id", "path"), **extract.build(files)}, -1, files.count())

    def apply(self, last: DataFrame, epoch: int) -> None:
        """Apply the last actions (path, action) of a batch; a batch that was applied before does nothing."""
        if epoch <= self.epoch:
            return
        touched = last.where("action in ('changed', 'deleted')").groupBy("path").agg(F.max_by("action", F.struct(F.col("action") == "deleted")).alias("action")).persist()
        try:
            n = touched.count()
            if not n:
                return
            changes = touched.collect() if n <= 1000 else []
            for r in changes:
                self.tell("file_changed", path=r.path, action=r.action)
            self.tell("reindex_start")
            wanted = touched.where("action = 'changed'").select("path")
            found = self.read(wanted)
            known = self.tables["files"]
            ids = sources.numbered(known.select("path").unionByName(found.select("path")).distinct(), known)
            changed = found.join(ids, "path").select("file_id", "path", "language", "content")
            # what is gone by the time it is read counts as deleted
            gone = touched.select("path").join(found.select("path"), "path", "left_anti")
            self.text.delete(touched.select("path"))
            self.text.add(lines.chunks(changed).select("id", "path", "content", "start_line", "end_line"))
            tables = incremental.update_graph(self.tables, changed, known.join(gone, "path", "left_semi").select("file_id"))
            files = ids.join(gone, "path", "left_anti").select("file_id", "path")
            self._keep({"files": files, **tables}, epoch, n)
        finally:
            touched.unpersist()

    def follow(self, events_: DataFrame, checkpoint: str):
        """Start a query that applies each batch of events (project, path, action, ts, seq)."""
        from . import events

        return events.apply_to(events_, lambda df, epoch: self.apply(df.where(F.col("project") == self.project), epoch), checkpoint)

    # -- answers -----------------------------------------------------------
    def snapshot(self, created_at, name: str | None = None) -> DataFrame:
        """One snapshot row of the index as it is; for after each update."""
        t = self.tables
        rows = dashboard.symbol_rows(t["symbols"], t["edges"], t["refs"], t["files"])
        cross = dashboard.cross_edges(t["symbols"], t["edges"]).toDF("a", "b")
        return snapshots.create(rows, graph.components(cross), created_at, self.project, name)


def sse(event: Column, detail: Column) -> Column:
    """An event as a server-sent one."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), detail, F.lit("\n\n"))


def relay(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as a stream of server-sent events; status updates are not passed on."""
    raw = spark.readStream.schema(EVENTS).json(f"{folder.rstrip('/')}/events")
    return raw.where("event <> 'status_update'").select("project", sse(F.col("event"), F.col("detail")).alias("value"))
