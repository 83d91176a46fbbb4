"""Matching and evaluation queries, the flagship among them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.operators import evaluation as ev
from lamella.operators import spatial as sp
from lamella.plans.registry import query
from lamella.sources.derived import Tables

GROUP = ["slide_name", "fov_id", "marker"]

# Naive joins, the meaning that the cell joins must reproduce.
NAIVE = {
    "mf": """SELECT m.id AS marker_id, m.slide_name, m.biomarker, m.x, m.y, m.w, m.h, m.created_at, f.id AS fov_id, f.biomarker AS fov_channel,
 f.x AS fov_x, f.y AS fov_y, f.w AS fov_w, f.h AS fov_h, f.created_at AS fov_created_at
FROM {markers} m JOIN {fovs} f ON m.slide_name = f.slide_name AND m.x >= f.x AND m.x <= f.x + f.w AND m.y >= f.y AND m.y <= f.y + f.h""",
    "gtb": """SELECT slide_name, fov_id, biomarker AS marker, marker_id, created_at, x - w/2 AS x1, y - h/2 AS y1, x + w/2 AS x2, y + h/2 AS y2
FROM {mf} WHERE biomarker <> ''""",
    "prb": """SELECT p.slide_name, f.id AS fov_id, p.biomarker AS marker, p.gt_id, p.score, p.x1, p.y1, p.x2, p.y2
FROM {preds} p JOIN {fovs} f ON p.slide_name = f.slide_name AND p.cx >= f.x AND p.cx <= f.x + f.w
 AND p.cy >= f.y AND p.cy <= f.y + f.h WHERE p.biomarker <> ''""",
    "ov": """SELECT slide_name, fov_id, marker, pred, gt, gt_at, inter / (pa + ga - inter) AS iou FROM (
 SELECT p.slide_name, p.fov_id, p.marker, p.gt_id AS pred, g.marker_id AS gt, g.created_at AS gt_at,
  greatest(0, least(p.x2,g.x2) - greatest(p.x1,g.x1)) * greatest(0, least(p.y2,g.y2) - greatest(p.y1,g.y1)) AS inter,
  (p.x2-p.x1)*(p.y2-p.y1) AS pa, (g.x2-g.x1)*(g.y2-g.y1) AS ga
 FROM {prb} p JOIN {gtb} g ON p.slide_name = g.slide_name AND p.fov_id = g.fov_id AND p.marker = g.marker) q WHERE inter > 0""",
}


def greedy_sql(threshold: float) -> dict[str, str]:
    """Greedy matching as a recursive walk over each group's ranked pairs."""
    return {
        **NAIVE,
        "ranked": f"""SELECT slide_name, fov_id, marker, pred, gt,
 row_number() OVER (PARTITION BY slide_name, fov_id, marker ORDER BY iou DESC, pred DESC, gt_at DESC, gt DESC) AS rn FROM {{ov}} WHERE iou >= {threshold}""",
        "walk": """SELECT slide_name, fov_id, marker, rn, [pred] AS ps, [gt] AS gs FROM {ranked} WHERE rn = 1
UNION ALL
SELECT r.slide_name, r.fov_id, r.marker, r.rn,
 CASE WHEN list_contains(w.ps, r.pred) OR list_contains(w.gs, r.gt) THEN w.ps ELSE list_append(w.ps, r.pred) END,
 CASE WHEN list_contains(w.ps, r.pred) OR list_contains(w.gs, r.gt) THEN w.gs ELSE list_append(w.gs, r.gt) END
FROM walk w JOIN {ranked} r ON r.slide_name = w.slide_name AND r.fov_id = w.fov_id AND r.marker = w.marker AND r.rn = w.rn + 1""",
        "tps": "SELECT slide_name, fov_id, marker, MAX(len(ps)) AS tp FROM {walk} GROUP BY slide_name, fov_id, marker",
        "matched": """SELECT s.slide_name, s.fov_id, s.marker, CAST(COALESCE(t.tp, 0) AS BIGINT) AS tp,
 CAST(s.np - COALESCE(t.tp, 0) AS BIGINT) AS fp, CAST(s.ng - COALESCE(t.tp, 0) AS BIGINT) AS fn
FROM (SELECT slide_name, fov_id, marker, SUM(p) AS np, SUM(g) AS ng FROM (
  SELECT slide_name, fov_id, marker, 1 AS p, 0 AS g FROM {prb} UNION ALL SELECT slide_name, fov_id, marker, 0 AS p, 1 AS g FROM {gtb}) u
 GROUP BY slide_name, fov_id, marker) s
LEFT JOIN {tps} t ON t.slide_name = s.slide_name AND t.fov_id = s.fov_id AND t.marker = s.marker""",
    }


METRICS_SQL = """SELECT COALESCE(marker, '__overall__') AS marker, marker IS NULL AS is_overall, CAST(SUM(tp) AS BIGINT) AS tp, CAST(SUM(fp) AS BIGINT) AS fp,
 CAST(SUM(fn) AS BIGINT) AS fn, CAST(COUNT(*) AS BIGINT) AS n_fovs FROM {src} GROUP BY GROUPING SETS ((marker), ())"""
RATIO_SQL = """SELECT {by}marker, is_overall, tp, fp, fn, n_fovs, round(p, 6) AS precision, round(r, 6) AS recall,
 round(CASE WHEN p + r = 0 THEN 0 ELSE 2*p*r/(p+r) END, 6) AS f1 FROM (SELECT *,
 CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE)/(tp+fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE)/(tp+fn) END AS r FROM ("""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def preds_as_points(t: Tables) -> DataFrame:
    """Predictions placed at their centre, so that they join fields of view as markers do."""
    return t.preds.where(F.col("biomarker") != "").select(
        F.col("gt_id").alias("id"),
        "slide_name",
        "biomarker",
        F.col("cx").alias("x"),
        F.col("cy").alias("y"),
        "x1",
        "y1",
        "x2",
        "y2",
        "score",
    )


def pred_boxes(t: Tables) -> DataFrame:
    placed = sp.markers_in_fovs(preds_as_points(t), t.fovs)
    return placed.select(
        "slide_name", "fov_id", F.col("biomarker").alias("marker"), F.col("marker_id").alias("key"), "score", "x1", "y1", "x2", "y2"
    )


def gt_boxes(t: Tables) -> DataFrame:
    fovs = ev.of_known_slides(t.fovs, t.slides)
    return ev.ground_truth_boxes(sp.markers_in_fovs(t.markers.where(F.col("biomarker") != ""), fovs), None)


@query("match_boxes", "SELECT slide_name, fov_id, marker, tp, fp, fn FROM {matched}", greedy_sql(0.05), recursive=True)
def match_boxes(t: Tables) -> DataFrame:
    return ev.match_boxes(gt_boxes(t), pred_boxes(t), GROUP, 0.05)


@query(
    "detection_metrics",
    RATIO_SQL.replace("{by}", "") + METRICS_SQL.replace("{src}", "{matched}") + ") a) b",
    greedy_sql(bx.IOU_THRESHOLD),
    recursive=True,
)
def detection_metrics(t: Tables) -> DataFrame:
    matches = ev.match_boxes(gt_boxes(t), pred_boxes(t), GROUP)
    return rounded(ev.detection_metrics(matches), "precision", "recall", "f1")
