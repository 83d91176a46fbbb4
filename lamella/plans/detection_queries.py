"""Queries on detections, suppression, star polygons and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.functions import scores as sc
from lamella.operators import detection as dt
from lamella.operators import pixels as px
from lamella.plans.flagship import GROUP, METRICS_SQL, NAIVE, RATIO_SQL, greedy_sql, gt_boxes, pred_boxes, rounded
from lamella.plans.pixel_queries import STACK, stacks
from lamella.plans.registry import query
from lamella.sources.derived import Tables


def load_peak_detector():
    """A detector without a model: one box around the brightest red pixel of each tile."""

    def detect(batch: pd.DataFrame) -> pd.DataFrame:
        peak = batch["red"].map(lambda p: int(p.argmax()))
        x, y = (peak % batch["w"]).astype(float), (peak // batch["w"]).astype(float)
        out = batch[["slide_name", "channel", "tile_y", "tile_x"]].copy()
        out["x1"], out["y1"], out["x2"], out["y2"] = x - 2, y - 2, x + 2, y + 2
        out["score"] = batch["red"].map(lambda p: p.max() / 65535.0)
        return out

    return detect


PEAK_SCHEMA = "slide_name string, channel string, tile_y int, tile_x int, x1 double, y1 double, x2 double, y2 double, score double"


@query(
    "score_tiles",
    """SELECT slide_name, channel, tile_y, tile_x, CAST(i % 8 - 2 AS DOUBLE) AS x1, CAST(floor(i/8) - 2 AS DOUBLE) AS y1, CAST(i % 8 + 2 AS DOUBLE) AS x2, CAST(floor(i/8) + 2 AS DOUBLE) AS y2, round(red/65535.0::DOUBLE, 6) AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY slide_name, channel, tile_y, tile_x ORDER BY red DESC, i) AS rn FROM {stk}) q WHERE rn = 1""",
    STACK,
)
def score_tiles(t: Tables) -> DataFrame:
    return rounded(dt.score_tiles(stacks(t), load_peak_detector, PEAK_SCHEMA), "score")


@query(
    "to_scene",
    """SELECT fov_id, gt_id, x1 - fx + trunc(fx) AS x1, y1 - fy + trunc(fy) AS y1, x2 - fx + trunc(fx) AS x2, y2 - fy + trunc(fy) AS y2 FROM (
 SELECT p.*, f.x AS fx, f.y AS fy FROM {prb} p JOIN {fovs} f ON f.id = p.fov_id) q""",
    NAIVE,
)
def to_scene(t: Tables) -> DataFrame:
    # Detections as a detector gives them: relative to their tile of the field of view.
    corner = t.fovs.select(F.col("id").alias("fov_id"), F.col("x").alias("fx"), F.col("y").alias("fy"))
    tile = lambda lo, at: (F.floor((F.col(lo) - F.col(at)) / 256) * 256).cast("int")
    rows = pred_boxes(t).join(corner, "fov_id").withColumns(
        {"ox": F.col("fx").cast("int"), "oy": F.col("fy").cast("int"), "tx": tile("x1", "fx"), "ty": tile("y1", "fy")}
    )
    local = rows.withColumns({f"{c}{n}": F.col(f"{c}{n}") - F.col(f"f{c}") - F.col(f"t{c}") for c in "xy" for n in (1, 2)})
    return dt.to_scene(local).select("fov_id", F.col("key").alias("gt_id"), "x1", "y1", "x2", "y2")


@query("threshold", "SELECT gt_id, score FROM {preds} WHERE score > 0.5")
def threshold(t: Tables) -> DataFrame:
    return dt.threshold(t.preds, 0.5).select("gt_id", "score")


@query(
    "decode_queries",
    """SELECT vec_id, query, round(s, 6) AS score, round((cx - w/2)*512, 4) AS x1, round((cy - h/2)*512, 4) AS y1, round((cx + w/2)*512, 4) AS x2, round((cy + h/2)*512, 4) AS y2 FROM (
 SELECT *, 1/(1+exp(-greatest(logit0, logit1, logit2, logit3))) AS s FROM {raw_queries}) q WHERE s > 0.6""",
)
def decode_queries(t: Tables) -> DataFrame:
    q = t.raw_queries.withColumn("logits", F.array(*[f"logit{k}" for k in range(4)]))
    out = dt.decode_queries(q, 0.6).select("vec_id", "query", "score", "x1", "y1", "x2", "y2")
    return rounded(out, "score").withColumns({c: F.round(c, 4) for c in ("x1", "y1", "x2", "y2")})


@query("sigmoid", "SELECT vec_id, query, round(1/(1+exp(-logit0)), 6) AS p FROM {raw_queries}")
def sigmoid(t: Tables) -> DataFrame:
    return t.raw_queries.select("vec_id", "query", F.round(sc.sigmoid(F.col("logit0")), 6).alias("p"))


@query(
    "cxcywh_to_xyxy",
    "SELECT vec_id, query, round((cx - w/2)*512, 4) AS x1, round((cy - h/2)*512, 4) AS y1, round((cx + w/2)*512, 4) AS x2, round((cy + h/2)*512, 4) AS y2 FROM {raw_queries}",
)
def cxcywh_to_xyxy(t: Tables) -> DataFrame:
    sides = bx.from_normalised(*[F.col(c) for c in ("cx", "cy", "w", "h")], 512.0)
    return t.raw_queries.select("vec_id", "query", *[F.round(c, 4).alias(k) for k, c in sides.items()])


@query(
    "iou",
    """SELECT marker_id, fov_id, round(CASE WHEN i > 0 THEN i/(w*h + 262144 - i) ELSE 0 END, 6) AS iou FROM (SELECT *,
 greatest(0, least(x + w/2, fov_x + 512) - greatest(x - w/2, fov_x)) * greatest(0, least(y + h/2, fov_y + 512) - greatest(y - h/2, fov_y)) AS i FROM {mf}) q""",
    NAIVE,
)
def iou(t: Tables) -> DataFrame:
    from lamella.plans.annotation_queries import pairs_of

    marker = tuple(bx.centre_box(*[F.col(c) for c in ("x", "y", "w", "h")]).values())
    x, y = F.col("fov_x"), F.col("fov_y")
    fov = (x, y, x + F.col("fov_w"), y + F.col("fov_h"))
    return pairs_of(t).select("marker_id", "fov_id", F.round(bx.iou(marker, fov), 6).alias("iou"))


@query(
    "iou_plus1",
    """SELECT p.gt_id, round(i/((p.x2-p.x1+1)*(p.y2-p.y1+1) + (m.w+1)*(m.h+1) - i), 6) AS iou FROM {preds} p JOIN {markers} m ON m.id = p.gt_id,
 LATERAL (SELECT greatest(0, least(p.x2, m.x+m.w/2) - greatest(p.x1, m.x-m.w/2) + 1) * greatest(0, least(p.y2, m.y+m.h/2) - greatest(p.y1, m.y-m.h/2) + 1) AS i) z""",
)
def iou_plus1(t: Tables) -> DataFrame:
    m = t.markers.select(F.col("id").alias("gt_id"), "x", "y", "w", "h")
    own = tuple(bx.centre_box(*[F.col(c) for c in ("x", "y", "w", "h")]).values())
    return t.preds.join(m, "gt_id").select("gt_id", F.round(bx.iou_plus1(bx.box(), own), 6).alias("iou"))


@query("argmax_class", "SELECT vec_id, query, CASE WHEN logit0 >= greatest(logit1, logit2, logit3) THEN 0 WHEN logit1 >= greatest(logit2, logit3) THEN 1 WHEN logit2 >= logit3 THEN 2 ELSE 3 END AS class_id FROM {raw_queries}")
def argmax_class(t: Tables) -> DataFrame:
    logits = F.array(*[f"logit{k}" for k in range(4)])
    return t.raw_queries.select("vec_id", "query", sc.argmax(logits).alias("class_id"))


@query(
    "labels_sequential",
    "SELECT slide_name, channel, tile_y, tile_x, MIN(l) >= 0 AND COUNT(DISTINCT l) FILTER (l > 0) = MAX(l) AS ok FROM (SELECT *, CAST(floor(v / 4000) - 3 - CASE WHEN v >= 20000 THEN 1 ELSE 0 END AS INT) AS l FROM {pixels}) q GROUP BY slide_name, channel, tile_y, tile_x",
)
def labels_sequential(t: Tables) -> DataFrame:
    label = F.transform("px", lambda v: (F.floor(v / 4000) - 3 - F.when(v >= 20000, 1).otherwise(0)).cast("int"))
    rows = t.tiles.withColumn("l", label)
    return rows.select("slide_name", "channel", "tile_y", "tile_x", sc.labels_sequential(F.col("l")).alias("ok"))


def nms_sql(threshold: float, source: str) -> dict[str, str]:
    """Greedy box suppression as a recursive walk that carries the kept boxes."""
    hit = (
        "greatest(0, least(k.x2, r.x2) - greatest(k.x1, r.x1) + 1) * greatest(0, least(k.y2, r.y2) - greatest(k.y1, r.y1) + 1)"
    )
    area = "({0}.x2 - {0}.x1 + 1) * ({0}.y2 - {0}.y1 + 1)"
    over = f"{hit} / ({area.format('k')} + {area.format('r')} - {hit}) > {threshold}"
    return {
        "nr": f"SELECT *, row_number() OVER (PARTITION BY slide_name, fov_id, marker ORDER BY score DESC, gt_id DESC) AS rn FROM {source}",
        "nw": f"""SELECT slide_name, fov_id, marker, rn, [{{{{'gt_id': gt_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}}}] AS kept FROM {{nr}} WHERE rn = 1
UNION ALL
SELECT r.slide_name, r.fov_id, r.marker, r.rn, CASE WHEN len(list_filter(w.kept, lambda k: {over})) > 0 THEN w.kept
 ELSE list_append(w.kept, {{{{'gt_id': r.gt_id, 'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}}}}) END
FROM nw w JOIN {{nr}} r ON r.slide_name = w.slide_name AND r.fov_id = w.fov_id AND r.marker = w.marker AND r.rn = w.rn + 1""",
        "nk": """SELECT slide_name, fov_id, marker, u.k.gt_id AS gt_id FROM (SELECT slide_name, fov_id, marker, unnest(kept) AS k FROM (
 SELECT *, row_number() OVER (PARTITION BY slide_name, fov_id, marker ORDER BY rn DESC) AS last FROM {nw}) a WHERE last = 1) u""",
    }


@query("nms_boxes", "SELECT slide_name, fov_id, marker, gt_id AS key FROM {nk}", {**NAIVE, **nms_sql(0.1, "{prb}")}, recursive=True)
def nms_boxes(t: Tables) -> DataFrame:
    return dt.nms_boxes(pred_boxes(t), 0.1, GROUP).select(*GROUP, "key")


EVAL = {
    **greedy_sql(bx.IOU_THRESHOLD),
    **nms_sql(0.1, "{praw}"),
    "gtb": NAIVE["gtb"] + """ AND slide_name IN (SELECT slide_name FROM {slides} WHERE slide_path NOT LIKE '%.svs')
 AND EXISTS (SELECT 1 FROM {channels} c WHERE c.slide_name = mf.slide_name AND c.name = mf.biomarker)""",
    "praw": NAIVE["prb"] + " AND p.score > 0.25 AND EXISTS (SELECT 1 FROM {gtb} g WHERE g.slide_name = p.slide_name AND g.fov_id = f.id AND g.marker = p.biomarker)",
    "prb": "SELECT p.* FROM {praw} p JOIN {nk} k ON k.slide_name = p.slide_name AND k.fov_id = p.fov_id AND k.marker = p.marker AND k.gt_id = p.gt_id",
}


@query("evaluate_detector", RATIO_SQL.replace("{by}", "") + METRICS_SQL.replace("{src}", "{matched}") + ") a) b", EVAL, recursive=True)
def evaluate_detector(t: Tables) -> DataFrame:
    readable = t.slides.select("slide_name", (~F.endswith("slide_path", F.lit(".svs"))).alias("readable"))
    out = dt.evaluate_detector(gt_boxes(t), pred_boxes(t), readable, t.channels, score=0.25, nms=0.1)
    return rounded(out["metrics"], "precision", "recall", "f1")


@query(
    "star_candidates",
    """SELECT id, i, prob, cy, cx, round(len * 1.0::DOUBLE, 6) AS first_ray FROM (SELECT vec_id AS id, i, abs(CAST(e AS DOUBLE)) AS prob, CAST(floor(i/8)*2 AS INT) AS cy, CAST(i%8*2 AS INT) AS cx,
 greatest(CAST(e AS DOUBLE)*10, 0.001) AS len FROM {emb_long} WHERE floor(i/8) BETWEEN 2 AND 5 AND i%8 BETWEEN 2 AND 5) q WHERE prob > 0.05""",
)
def star_candidates(t: Tables) -> DataFrame:
    value = lambda e: e.cast("double")
    maps = t.embeddings.select(
        F.col("vec_id").alias("id"),
        F.lit(8).alias("rows"),
        F.lit(8).alias("cols"),
        F.transform("embedding", lambda e: F.abs(value(e))).alias("prob"),
        F.transform("embedding", lambda e: F.array(value(e) * 10, value(e) * 5)).alias("dist"),
    )
    out = dt.star_candidates(maps, 0.05)
    cell = (F.col("cy") / 2 * 8 + F.col("cx") / 2).cast("int")
    return out.select("id", cell.alias("i"), "prob", "cy", "cx", F.round(F.get("dist", 0), 6).alias("first_ray"))


STAR = {
    "vert": "SELECT id, fov_id, ray, cx + dist*cos(2*pi()*ray/32) AS x, cy + dist*sin(2*pi()*ray/32) AS y FROM {star_rays}",
    "sedge": "SELECT id, x AS x1, y AS y1, COALESCE(lead(x) OVER w, first_value(x) OVER w) AS x2, COALESCE(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM {vert} WINDOW w AS (PARTITION BY id ORDER BY ray)",
    "shit": """SELECT id, yy, x1 + (yy - y1) * (x2 - x1) / (y2 - y1) AS xc FROM (
 SELECT *, unnest(generate_series(CAST(ceil(least(y1,y2)) AS BIGINT), CAST(ceil(greatest(y1,y2)) AS BIGINT) - 1)) AS yy FROM {sedge}) q""",
    "sruns": """SELECT id, yy, CAST(ceil(xc) AS BIGINT) AS x0, CAST(ceil(nxt) AS BIGINT) - 1 AS x1 FROM (
 SELECT *, lead(xc) OVER w AS nxt, row_number() OVER w AS rn FROM {shit} WINDOW w AS (PARTITION BY id, yy ORDER BY xc)) q WHERE rn % 2 = 1 AND ceil(xc) <= ceil(nxt) - 1""",
    "sarea": "SELECT id, SUM(x1 - x0 + 1) AS area FROM {sruns} GROUP BY id",
    "smeta": "SELECT DISTINCT r.id, r.fov_id, s.prob FROM {star_rays} r JOIN {star_scores} s ON s.id = r.id",
    "sover": """SELECT a.id AS a, b.id AS b, SUM(greatest(0, least(p.x1, q.x1) - greatest(p.x0, q.x0) + 1)) AS px FROM {smeta} a JOIN {smeta} b ON a.fov_id = b.fov_id AND a.id <> b.id
 JOIN {sruns} p ON p.id = a.id JOIN {sruns} q ON q.id = b.id AND q.yy = p.yy AND q.x0 <= p.x1 AND p.x0 <= q.x1 GROUP BY a.id, b.id""",
    "sbad": "SELECT o.a, list(o.b) AS bs FROM {sover} o JOIN {sarea} x ON x.id = o.a JOIN {sarea} y ON y.id = o.b WHERE o.px / CAST(least(x.area, y.area) AS DOUBLE) > 0.3 GROUP BY o.a",
    "sr": "SELECT m.id, m.fov_id, COALESCE(z.bs, []) AS bs, row_number() OVER (PARTITION BY m.fov_id ORDER BY m.prob DESC, m.id DESC) AS rn FROM {smeta} m LEFT JOIN {sbad} z ON z.a = m.id",
    "sw": """SELECT fov_id, rn, [id] AS kept FROM {sr} WHERE rn = 1
UNION ALL
SELECT r.fov_id, r.rn, CASE WHEN list_has_any(w.kept, r.bs) THEN w.kept ELSE list_append(w.kept, r.id) END FROM sw w JOIN {sr} r ON r.fov_id = w.fov_id AND r.rn = w.rn + 1""",
}


@query("star_polygon", "SELECT id, ray, round(x, 6) AS x, round(y, 6) AS y FROM {vert}", STAR)
def star_polygon(t: Tables) -> DataFrame:
    verts = t.star_polygons.select("id", F.posexplode(dt.star_polygon(F.col("cy"), F.col("cx"), F.col("dist"))).alias("ray", "v"))
    return verts.select("id", "ray", F.round("v.x", 6).alias("x"), F.round("v.y", 6).alias("y"))


@query(
    "nms_polygons",
    "SELECT fov_id, unnest(kept) AS id FROM (SELECT *, row_number() OVER (PARTITION BY fov_id ORDER BY rn DESC) AS last FROM {sw}) q WHERE last = 1",
    STAR,
    recursive=True,
)
def nms_polygons(t: Tables) -> DataFrame:
    return dt.nms_polygons(t.star_polygons, 0.3, ["fov_id"]).select("fov_id", "id")


@query(
    "label_runs",
    """SELECT fov_id, CAST(yy AS INT) AS row, CAST(MIN(xx) AS INT) AS x0, CAST(MAX(xx) AS INT) AS x1, id + 1 AS label FROM (
 SELECT fov_id, yy, xx, id, xx - row_number() OVER (PARTITION BY fov_id, yy, id ORDER BY xx) AS island FROM (
  SELECT *, row_number() OVER (PARTITION BY fov_id, yy, xx ORDER BY prob DESC, id DESC) AS rn FROM (
  SELECT m.fov_id, m.id, m.prob, r.yy, unnest(generate_series(greatest(r.x0, 0), least(r.x1, 499))) AS xx FROM {sruns} r JOIN {smeta} m ON m.id = r.id WHERE r.yy BETWEEN 0 AND 499) a) b WHERE rn = 1) c
 GROUP BY fov_id, yy, id, island""",
    STAR,
)
def label_runs(t: Tables) -> DataFrame:
    return dt.label_runs(t.star_polygons.withColumnRenamed("id", "idx"), "fov_id", 500, 500)


@query(
    "label_image",
    """SELECT fov_id, CAST(yy AS INT) AS row, CAST(xx AS INT) AS col, id + 1 AS label FROM (SELECT *, row_number() OVER (PARTITION BY fov_id, yy, xx ORDER BY prob DESC, id DESC) AS rn FROM (
 SELECT m.fov_id, m.id, m.prob, r.yy, unnest(generate_series(greatest(r.x0, 0), least(r.x1, 499))) AS xx FROM {sruns} r JOIN {smeta} m ON m.id = r.id WHERE m.prob > 0.2 AND r.yy BETWEEN 0 AND 499) a) b WHERE rn = 1""",
    STAR,
)
def label_image(t: Tables) -> DataFrame:
    return dt.label_image(t.star_polygons.withColumnRenamed("id", "idx"), "fov_id", 500, 500, 0.2)


@query(
    "detector_family",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'queries' ELSE 'corners' END AS family FROM {part}",
)
def detector_family(t: Tables) -> DataFrame:
    names = lambda *v: F.array(*[F.lit(x) for x in v])
    k = F.col("p_size") % 3
    inputs = F.when(k == 1, names("images", "orig_target_sizes")).otherwise(names("input"))
    outputs = F.when(k == 2, names("labels", "boxes", "scores")).otherwise(names("labels", "dets", "extra"))
    return t.part.select("p_partkey", dt.detector_family(inputs, outputs).alias("family"))


@query(
    "attach_classes",
    """SELECT m.id, m.fov_id, CASE WHEN z.p0 >= greatest(z.p1, z.p2) THEN 0 WHEN z.p1 >= z.p2 THEN 1 ELSE 2 END AS class_id FROM (SELECT DISTINCT id, fov_id, cy, cx FROM {star_rays}) m JOIN (
 SELECT fov_id, gy, gx, MAX(dist) AS p0, MAX(CASE WHEN ray % 2 = 1 THEN dist END) AS p1, MIN(dist)*3 AS p2 FROM (SELECT *, CAST(floor(cy/2) AS INT) AS gy, CAST(floor(cx/2) AS INT) AS gx FROM {star_rays}) q GROUP BY fov_id, gy, gx) z
 ON z.fov_id = m.fov_id AND z.gy = floor(m.cy/2) AND z.gx = floor(m.cx/2)""",
)
def attach_classes(t: Tables) -> DataFrame:
    at = t.star_rays.withColumns({"gy": F.floor(F.col("cy") / 2).cast("int"), "gx": F.floor(F.col("cx") / 2).cast("int")})
    odd = F.max(F.when(F.col("ray") % 2 == 1, F.col("dist")))
    classes = at.groupBy("fov_id", "gy", "gx").agg(F.array(F.max("dist"), odd, F.min("dist") * 3).alias("probs"))
    return dt.attach_classes(t.star_polygons, classes, "fov_id").select("id", "fov_id", "class_id")
