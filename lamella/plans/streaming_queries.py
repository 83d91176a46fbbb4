"""Queries on streams and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lamella.plans.registry import query
from lamella.session import scratch_path
from lamella.sources.derived import Tables
from lamella.streaming import edits, live

SAVES = """SELECT 'slide_' || CAST(user_id AS STRING) AS slide_name, event_id AS save_seq, CAST(floor(value * 10) AS BIGINT) AS cell_marker,
 CAST(event_id % 7 AS BIGINT) AS region, CAST(length(event_type) AS BIGINT) AS fov FROM {events}"""
LATEST = {
    "saves": SAVES,
    "last": "SELECT slide_name, save_seq, cell_marker, region, fov FROM (SELECT *, row_number() OVER (PARTITION BY slide_name ORDER BY save_seq DESC) AS rn FROM {saves}) q WHERE rn = 1",
}


@query("live_counts", "SELECT slide_name, save_seq, cell_marker, region, fov FROM {last}", LATEST)
def live_counts(t: Tables) -> DataFrame:
    return live.live_counts(t.spark.sql(SAVES, events=t.events))


@query("live_counts_stream", "SELECT slide_name, save_seq, cell_marker, region, fov FROM {last}", LATEST)
def live_counts_stream(t: Tables) -> DataFrame:
    """The same through a stream over the event files and the upserted table."""
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events.parque[t]")
    path = scratch_path(t.spark, "live")
    saves = t.spark.sql(SAVES, events=events)
    live.start_live_counts(saves, f"{path}/table", f"{path}/checkpoint", available_now=True).awaitTermination()
    return live.read_counts(t.spark, f"{path}/table")


REPLAY = {
    "ev": "SELECT *, row_number() OVER (PARTITION BY slide_name ORDER BY seq) AS rn FROM {edit_log}",
    "hist": """SELECT slide_name, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id VARCHAR, x DOUBLE, y DOUBLE)[]) AS live,
 CAST([] AS STRUCT(id VARCHAR, had BOOLEAN, ox DOUBLE, oy DOUBLE, has BOOLEAN, nx DOUBLE, ny DOUBLE)[]) AS steps, CAST(0 AS BIGINT) AS at_ FROM (SELECT DISTINCT slide_name FROM {ev}) s
UNION ALL
SELECT slide_name, rn,
 CASE WHEN c.id IS NULL THEN live WHEN tgt THEN list_append(list_filter(live, lambda e: e.id <> c.id), {{'id': c.id, 'x': tx, 'y': ty}}) ELSE list_filter(live, lambda e: e.id <> c.id) END,
 CASE WHEN op IN ('undo', 'redo') OR c.id IS NULL THEN steps ELSE list_append(steps[1:at_], c) END,
 CASE WHEN c.id IS NULL THEN at_ WHEN op = 'undo' THEN at_ - 1 ELSE at_ + 1 END
FROM (SELECT *, CASE WHEN op = 'undo' THEN c.had ELSE c.has END AS tgt, CASE WHEN op = 'undo' THEN c.ox ELSE c.nx END AS tx, CASE WHEN op = 'undo' THEN c.oy ELSE c.ny END AS ty FROM (
 SELECT slide_name, rn, op, live, steps, at_, CASE
  WHEN op = 'undo' THEN CASE WHEN at_ > 0 THEN steps[at_] END
  WHEN op = 'redo' THEN CASE WHEN at_ < len(steps) THEN steps[at_ + 1] END
  WHEN op = 'add' OR (cur.id IS NOT NULL AND (op = 'delete' OR cur.x <> x OR cur.y <> y)) THEN {{'id': ann_id, 'had': cur.id IS NOT NULL, 'ox': cur.x, 'oy': cur.y, 'has': op <> 'delete', 'nx': x, 'ny': y}} END AS c
 FROM (SELECT h.slide_name, e.rn, e.op, e.ann_id, e.x, e.y, h.live, h.steps, h.at_, list_filter(h.live, lambda v: v.id = e.ann_id)[1] AS cur FROM hist h JOIN {ev} e ON e.slide_name = h.slide_name AND e.rn = h.rn + 1) a) b) d""",
    "fin": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slide_name ORDER BY rn DESC) AS k FROM {hist}) q WHERE k = 1",
}


@query(
    "replay_edits",
    """SELECT slide_name, v.id AS ann_id, v.x AS x, v.y AS y, at_ > 0 AS can_undo, at_ < n AS can_redo FROM (
 SELECT slide_name, at_, len(steps) AS n, unnest(CASE WHEN len(live) = 0 THEN [NULL] ELSE live END) AS v FROM {fin}) q""",
    REPLAY,
    recursive=True,
)
def replay_edits(t: Tables) -> DataFrame:
    return edits.replay_edits(t.edit_log)
