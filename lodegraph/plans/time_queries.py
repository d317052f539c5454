"""Queries over file events and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import snapshots as Z
from ..sources import adapters as A
from ..streaming import events as E
from .graph_queries import SCC, scc
from .registry import query
from .symbol_queries import ROWS, rows

GAP = "5 minutes"


@query("r2_classify", "SELECT seq, path, action FROM file_events")
def r2(spark, sf):
    return E.usable(A.file_events(spark, sf)).select("seq", "path", "action")


@query("r3_debounce", f"SELECT min(ts) AS start, count(*) AS n, count(DISTINCT path) AS paths FROM (SELECT *, sum(new) OVER (ORDER BY ts, seq) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts, seq) < INTERVAL '{GAP}' THEN 0 ELSE 1 END AS new FROM file_events)) GROUP BY g")
def r3(spark, sf):
    return E.bursts(A.file_events(spark, sf), GAP)


@query("r4_last_event", f"SELECT min(ts) AS start, max(ts) + INTERVAL '{GAP}' AS finish, project, path, arg_max(action, (ts, seq)) AS action, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY project, path ORDER BY ts, seq) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project, path ORDER BY ts, seq) < INTERVAL '{GAP}' THEN 0 ELSE 1 END AS new FROM file_events)) GROUP BY g, project, path")
def r4(spark, sf):
    return E.last_wins(A.file_events(spark, sf), GAP)


@query("r10_changes_per_window", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, project, action, count(*) AS n FROM file_events GROUP BY ALL")
def r10(spark, sf):
    return E.per_window(A.file_events(spark, sf), "1 hour")


@query("r8_deleted_paths", "SELECT project, path FROM file_events GROUP BY ALL HAVING arg_max(action, (ts, seq)) = 'deleted'")
def r8(spark, sf):
    return A.file_events(spark, sf).groupBy("project", "path").agg(F.max_by("action", F.struct("ts", "seq")).alias("a")).where("a = 'deleted'").select("project", "path")


@query("z1_snapshot", """SELECT '20240102_030405' AS id, count(DISTINCT path) AS files, count(*) AS symbols, count(*) FILTER (dead) AS dead, (SELECT count(DISTINCT component) FROM scc) AS cycles, count(*) FILTER (is_entry) AS entry_points,
 (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM rows GROUP BY 1)) AS by_kind, (SELECT string_agg(path, ',' ORDER BY n DESC, path) FROM (SELECT path, count(*) AS n FROM rows GROUP BY 1 ORDER BY n DESC, path LIMIT 20)) AS top_files FROM rows""", f"{ROWS}, {SCC}")
def z1(spark, sf):
    s = Z.create(rows(spark, sf), scc(spark, sf), "2024-01-02 03:04:05", "p")
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("metrics.by_kind")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return s.select("id", *[f"metrics.{m}" for m in Z.METRICS], kinds.alias("by_kind"), F.array_join(F.transform("metrics.top_files", lambda x: x["path"]), ",").alias("top_files"))


@query("z2_list", "SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC)::INT AS place FROM snaps")
def z2(spark, sf):
    from pyspark.sql.window import Window

    return A.snapshots(spark, sf).select("id", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("place"))


@query("z3_latest", "SELECT id, files, symbols FROM snaps ORDER BY created_at DESC, id DESC LIMIT 1")
def z3(spark, sf):
    return Z.latest(A.snapshots(spark, sf)).select("id", "files", "symbols")


@query("z4_compare", "SELECT b.files - a.files AS files_diff, b.symbols - a.symbols AS symbols_diff, b.dead - a.dead AS dead_diff, b.cycles - a.cycles AS cycles_diff, b.entry_points - a.entry_points AS entry_points_diff FROM snaps a, snaps b WHERE a.id = '199702' AND b.id = '199805'")
def z4(spark, sf):
    return Z.compare(A.snapshots(spark, sf), "199702", "199805")


@query("z5_newest", "SELECT id FROM snaps ORDER BY created_at DESC, id DESC LIMIT 12")
def z5(spark, sf):
    return Z.newest(A.snapshots(spark, sf), 12).select("id")


TREND = ", ".join(f"{m} - lag({m}) OVER (ORDER BY created_at, id) AS {m}_diff" for m in Z.METRICS)


@query("c18_trend", f"SELECT id, {', '.join(Z.METRICS)}, {TREND} FROM snaps")
def c18(spark, sf):
    return Z.trend(A.snapshots(spark, sf))


SAID = "concat_ws(', ', " + ", ".join(f"CASE WHEN {m}_diff > 0 THEN '+' || {m}_diff || ' {m}' WHEN {m}_diff < 0 THEN {m}_diff || ' {m}' END" for m in Z.METRICS) + ")"


@query("c18_summary", f"SELECT id, {SAID} AS summary FROM (SELECT id, {TREND} FROM snaps)")
def c18s(spark, sf):
    return Z.summary(Z.trend(A.snapshots(spark, sf)))
