"""Queries that run a detector over the pixels of fields of view."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import catalog as ct
from lamella.operators import inference as nf
from lamella.operators.inference import TILE_KEY
from lamella.operators import spatial as sp
from lamella.plans.flagship import METRICS_SQL, RATIO_SQL, greedy_sql, rounded
from lamella.plans.pixel_queries import EDGE, REGION
from lamella.plans.registry import query
from lamella.sources.derived import Tables

PEAKS = {
    **REGION,
    "nuc": "SELECT slide_name, arg_min(name, idx) AS channel FROM {channels} WHERE contains(lower(name), 'dapi') GROUP BY slide_name",
    "peak": """SELECT request_id AS fov_id, slide_name, channel AS marker, ox, oy, ty, tx, ly, lx, v FROM (
 SELECT l.request_id, l.slide_name, l.channel, r.x AS ox, r.y AS oy, CAST(floor(l.yy/8) AS INT)*8 AS ty, CAST(floor(l.xx/8) AS INT)*8 AS tx, l.yy % 8 AS ly, l.xx % 8 AS lx, COALESCE(p.v, 0) AS v,
  row_number() OVER (PARTITION BY l.request_id, l.channel, floor(l.yy/8), floor(l.xx/8) ORDER BY COALESCE(p.v, 0) DESC, l.yy % 8, l.xx % 8) AS rn
 FROM {lat} l JOIN {rq} r ON r.request_id = l.request_id LEFT JOIN {abs_px} p ON p.slide_name = l.slide_name AND p.channel = l.channel AND p.sy = l.sy AND p.sx = l.sx) q WHERE rn = 1""",
}


def load_peaks():
    """A detector without a model: one box around the brightest red pixel of each tile."""

    def detect(batch: pd.DataFrame) -> pd.DataFrame:
        peak = batch["red"].map(lambda p: int(p.argmax()))
        x, y = (peak % batch["w"]).astype(float), (peak // batch["w"]).astype(float)
        out = batch[TILE_KEY].assign(rank=0, x1=x - 2, y1=y - 2, x2=x + 2, y2=y + 2)
        return out.assign(score=batch["red"].map(lambda p: p.max() / 65535.0))

    return detect


def small_fovs(t: Tables) -> DataFrame:
    """Fields of view scaled to the extent of the pixel tiles."""
    cell = lambda c: F.floor(F.col(c) / 64) - 8
    return t.fovs.select("id", "slide_name", cell("x").alias("x"), cell("y").alias("y"), F.lit(12).alias("w"), F.lit(9).alias("h"))


def model_tiles(t: Tables) -> DataFrame:
    fovs = small_fovs(t)
    nuclear = t.channels.join(ct.nuclear_channel(t.channels), ["slide_name", "idx"]).select("slide_name", F.col("name").alias("channel"))
    channels = t.tiles.select("slide_name", F.col("channel").alias("marker")).distinct()
    wanted = fovs.select("slide_name", F.col("id").alias("fov_id")).join(channels, "slide_name")
    return nf.fov_stacks(t.tiles, fovs, wanted, nuclear, EDGE, EDGE)


@query(
    "detect_in_fovs",
    """SELECT slide_name, fov_id, marker, ty, tx, round(v/65535.0::DOUBLE, 6) AS score, CAST(lx - 2 + ox + tx AS DOUBLE) AS x1, CAST(ly - 2 + oy + ty AS DOUBLE) AS y1,
 CAST(lx + 2 + ox + tx AS DOUBLE) AS x2, CAST(ly + 2 + oy + ty AS DOUBLE) AS y2 FROM {peak} WHERE v/65535.0::DOUBLE > 0.3""",
    PEAKS,
)
def detect_in_fovs(t: Tables) -> DataFrame:
    out = nf.detect_in_fovs(model_tiles(t), load_peaks, score=0.3)
    return rounded(out.withColumns({"ty": F.col("key.ty"), "tx": F.col("key.tx")}).drop("key"), "score")


#: Truth boxes around the markers, in the pixels that the fields of view are scaled to, and
#: the detector's boxes in the fields of view that have some.
MODEL = {
    **PEAKS,
    **greedy_sql(0.05),
    "gtb": """SELECT m.slide_name, m.fov_id, m.biomarker AS marker, m.marker_id, m.created_at, floor(m.x/64) - 10 AS x1, floor(m.y/64) - 10 AS y1, floor(m.x/64) - 6 AS x2, floor(m.y/64) - 6 AS y2
 FROM {mf} m JOIN {chn} c ON c.slide_name = m.slide_name AND c.channel = m.biomarker""",
    "prb": """SELECT p.slide_name, p.fov_id, p.marker, p.ty * 1000 + p.tx AS gt_id, CAST(p.lx - 2 + p.ox + p.tx AS DOUBLE) AS x1, CAST(p.ly - 2 + p.oy + p.ty AS DOUBLE) AS y1,
 CAST(p.lx + 2 + p.ox + p.tx AS DOUBLE) AS x2, CAST(p.ly + 2 + p.oy + p.ty AS DOUBLE) AS y2
 FROM {peak} p JOIN (SELECT DISTINCT slide_name, fov_id, marker FROM {gtb}) g ON g.slide_name = p.slide_name AND g.fov_id = p.fov_id AND g.marker = p.marker WHERE p.v/65535.0::DOUBLE > 0.3""",
}


@query("evaluate_model", RATIO_SQL.replace("{by}", "") + METRICS_SQL.replace("{src}", "{matched}") + ") a) b", MODEL, recursive=True)
def evaluate_model(t: Tables) -> DataFrame:
    """From pixels and annotations to the metrics of a detector."""
    near = lambda c, d: (F.floor(F.col(c) / 64) + d).cast("double")
    pairs = sp.markers_in_fovs(t.markers, t.fovs)
    sides = {"x1": near("x", -10), "y1": near("y", -10), "x2": near("x", -6), "y2": near("y", -6)}
    key = F.struct("created_at", "marker_id").alias("key")
    gt = pairs.select("slide_name", "fov_id", F.col("biomarker").alias("marker"), key, *[c.alias(k) for k, c in sides.items()])
    nuclear = t.channels.join(ct.nuclear_channel(t.channels), ["slide_name", "idx"]).select("slide_name", F.col("name").alias("channel"))
    out = nf.evaluate_model(gt, t.tiles, small_fovs(t), nuclear, load_peaks, iou=0.05, score=0.3, size=EDGE, edge=EDGE)
    return rounded(out, "precision", "recall", "f1")
