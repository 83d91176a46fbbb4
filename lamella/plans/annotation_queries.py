"""Queries on the annotation tables: defaults, filters, counts, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.functions import names as nm
from lamella.operators import annotations as an
from lamella.plans.flagship import NAIVE
from lamella.plans.registry import query
from lamella.session import durable, is_small, numbered, scratch_path
from lamella.sources import tables as tb
from lamella.sources.derived import Tables
from lamella.sources.sqlview import run_sql

FLAT = ["id", "type", "created_at", "slide_name", "biomarker", "x", "y", "w", "h"]


@query("read_annotations", f"SELECT {', '.join(FLAT)} FROM {{annotations}}")
def read_annotations(t: Tables) -> DataFrame:
    root = scratch_path(t.spark, "annotations")
    points = t.region_points.join(t.regions.select(F.col("id").alias("annotation_id"), "slide_name"), "annotation_id")
    slides = t.annotations.select("slide_name").distinct()
    tb.save_annotations(t.annotations, points, slides, root, F.current_timestamp())
    t.slides.write.parquet(f"{root}/slide_paths")
    back = tb.read_annotations(t.spark, root)["annotations"]
    return back.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).select(*FLAT)


@query(
    "upgrade_region_points",
    "SELECT annotation_id, seq, px, py, CASE WHEN ring = 0 THEN 0 ELSE COALESCE(ring, 0) END AS ring FROM {region_points}",
)
def upgrade_region_points(t: Tables) -> DataFrame:
    old = t.region_points.withColumn("ring", F.when(F.col("ring") != 0, F.col("ring")))
    return tb.upgrade_region_points(old)


@query(
    "save_annotations",
    """SELECT id, type, slide_name, biomarker, CASE WHEN again THEN x + 1 ELSE x END AS x, CAST(again AS INT) AS saved, coalesce(n, 0) AS n_points FROM (
 SELECT a.*, coalesce(s.slide_path LIKE '%/test/%', false) AS again, p.n FROM {annotations} a LEFT JOIN {slides} s ON s.slide_name = a.slide_name
 LEFT JOIN (SELECT annotation_id, COUNT(*) AS n FROM {region_points} GROUP BY annotation_id) p ON p.annotation_id = a.id) q
 WHERE NOT (again AND biomarker = '')""",
)
def save_annotations(t: Tables) -> DataFrame:
    """Everything saved once, then some slides again with moved markers, fewer regions and fields of view."""
    root = scratch_path(t.spark, "annotations")
    everything = durable(t.annotations)
    # Points belong to regions, so no other annotation is looked up for them.
    owner = everything.where("type = 'region'").select(F.col("id").alias("annotation_id"), "slide_name")
    points = durable(t.region_points.join(owner, "annotation_id"))
    slides = durable(t.slides.where(F.contains("slide_path", F.lit("/test/"))).select("slide_name"))
    tb.save_annotations(everything, points, everything.select("slide_name"), root, F.lit("2024-01-01").cast("timestamp"))
    again = F.broadcast(slides) if is_small(slides) else slides
    kept = everything.join(again, "slide_name", "left_semi").where("biomarker <> ''").withColumn("x", F.col("x") + 1)
    regions = kept.where("type = 'region'").select(F.col("id").alias("annotation_id"))
    left = points.join(regions, "annotation_id", "left_semi")
    tb.save_annotations(kept, left, slides, root, F.lit("2024-02-01").cast("timestamp"))
    back = tb.read_annotations(t.spark, root)
    n = back["region_points"].groupBy(F.col("annotation_id").alias("id")).agg(F.count("*").alias("n"))
    saved = (F.col("modified_at") > F.lit("2024-01-15").cast("timestamp")).cast("int").alias("saved")
    rows = back["annotations"].select("id", "type", "slide_name", "biomarker", "x", saved)
    return rows.join(n, "id", "left").withColumn("n_points", F.coalesce("n", F.lit(0))).drop("n")


@query(
    "record_slide_paths",
    """SELECT slide_name, CASE WHEN slide_path LIKE '%.czi' THEN '/moved/' || slide_name ELSE slide_path END AS slide_path FROM {slides}""",
)
def record_slide_paths(t: Tables) -> DataFrame:
    moved = t.slides.where(F.endswith("slide_path", F.lit(".czi"))).withColumn("slide_path", F.concat(F.lit("/moved/"), "slide_name"))
    return an.record_slide_paths(t.slides, moved)


@query(
    "with_load_defaults",
    """SELECT id, type, CASE WHEN type = 'region' THEN raw_w WHEN raw_w IS NULL OR raw_w = 0 THEN CASE WHEN type = 'fov' THEN 512.0::DOUBLE ELSE 10.0::DOUBLE END ELSE raw_w END AS w,
 CASE WHEN type = 'region' THEN h WHEN h IS NULL THEN 10.0::DOUBLE ELSE h END AS h, CASE WHEN red = 0 THEN 255 ELSE red END AS color_r
 FROM (SELECT *, CASE WHEN biomarker = 'CD8' THEN 0 WHEN biomarker = 'CD68' THEN NULL ELSE w END AS raw_w,
  CAST(CASE WHEN biomarker = 'PanCK' THEN 0 ELSE 17 END AS INT) AS red FROM {annotations}) q""",
)
def with_load_defaults(t: Tables) -> DataFrame:
    b = F.col("biomarker")
    raw = t.annotations.withColumns(
        {
            "w": F.when(b == "CD8", F.lit(0.0)).when(b == "CD68", F.lit(None)).otherwise(F.col("w")),
            "color_r": F.when(b == "PanCK", 0).otherwise(17),
        }
    )
    return an.with_load_defaults(raw).select("id", "type", "w", "h", "color_r")


@query("marker_box", "SELECT id, x - w/2 AS x1, y - h/2 AS y1, x + w/2 AS x2, y + h/2 AS y2 FROM {markers}")
def marker_box(t: Tables) -> DataFrame:
    sides = bx.centre_box(*[F.col(c) for c in ("x", "y", "w", "h")])
    return t.markers.select("id", *[c.alias(k) for k, c in sides.items()])


@query(
    "marker_export_box",
    """SELECT marker_id, fov_id, CAST(round_even(x-10-fov_x,0) AS INT) AS x1, CAST(round_even(y-10-fov_y,0) AS INT) AS y1,
 CAST(round_even(x+10-fov_x,0) AS INT) AS x2, CAST(round_even(y+10-fov_y,0) AS INT) AS y2 FROM {mf}""",
    NAIVE,
)
def marker_export_box(t: Tables) -> DataFrame:
    sides = bx.export_box(*[F.col(c) for c in ("x", "y", "fov_x", "fov_y")])
    return pairs_of(t).select("marker_id", "fov_id", *[c.alias(k) for k, c in sides.items()])


def pairs_of(t: Tables) -> DataFrame:
    from lamella.operators.spatial import markers_in_fovs

    return markers_in_fovs(t.markers, t.fovs)


@query("fov_from_center", "SELECT id, x - 256 AS x, y - 256 AS y FROM {fovs}")
def fov_from_center(t: Tables) -> DataFrame:
    corner = bx.fov_corner(*[F.col(c) for c in ("x", "y", "w", "h")])
    return t.fovs.select("id", *[c.alias(k) for k, c in corner.items()])


@query(
    "detections_to_markers",
    "SELECT slide_name, 'CD8' AS biomarker, (x1+x2)/2 AS x, (y1+y2)/2 AS y, x2-x1 AS w, y2-y1 AS h, CAST(64 AS INT) AS id_length FROM {preds}",
)
def detections_to_markers(t: Tables) -> DataFrame:
    return an.detections_to_markers(t.preds, "CD8").withColumn("id_length", F.length("id")).drop("id")


@query("translate_annotations", "SELECT id, type, x + 2.5 AS x, y - 1.25 AS y FROM {annotations}")
def translate_annotations(t: Tables) -> DataFrame:
    return an.translate(t.annotations, 2.5, -1.25).select("id", "type", "x", "y")


@query("select_channels", "SELECT id, biomarker FROM {markers} WHERE biomarker IN ('CD8', 'PanCK')")
def select_channels(t: Tables) -> DataFrame:
    return an.select_channels(t.markers, ["CD8", "PanCK"]).select("id", "biomarker")


@query(
    "select_in_rect",
    """SELECT id, type FROM {annotations} WHERE (type = 'cell_marker' AND x BETWEEN 1000 AND 1800 AND y BETWEEN 900 AND 2100)
 OR (type = 'fov' AND x <= 1800 AND x + w >= 1000 AND y <= 2100 AND y + h >= 900)""",
)
def select_in_rect(t: Tables) -> DataFrame:
    return an.select_in_rect(t.annotations, 1000, 900, 800, 1200).select("id", "type")


@query("delete_annotations", "SELECT id, type FROM {annotations} WHERE id NOT IN (SELECT gt_id FROM {preds} WHERE score > 0.5)")
def delete_annotations(t: Tables) -> DataFrame:
    ids = t.preds.where("score > 0.5").select(F.col("gt_id").alias("id"))
    return an.delete_annotations(t.annotations, ids).select("id", "type")


@query("visible_annotations", "SELECT id, type FROM {annotations} WHERE biomarker = 'CD68'")
def visible_annotations(t: Tables) -> DataFrame:
    return an.visible_annotations(t.annotations, "CD68").select("id", "type")


@query(
    "target_fovs",
    """SELECT id, slide_name, sel AS selected FROM (SELECT *, MAX(CAST(sel AS INT)) OVER (PARTITION BY slide_name) AS any_sel
 FROM (SELECT *, x > 3400 AS sel FROM {fovs}) a) b WHERE CASE WHEN any_sel = 1 THEN sel ELSE biomarker = 'CD8' END""",
)
def target_fovs(t: Tables) -> DataFrame:
    flagged = t.fovs.withColumn("selected", F.col("x") > 3400)
    return an.target_fovs(flagged, "CD8").select("id", "slide_name", "selected")


@query(
    "filter_by_groups",
    """SELECT slide_name, g FROM (SELECT slide_name, CASE WHEN slide_path LIKE '/data/test/%' THEN 'test' WHEN slide_path LIKE '/data/misc/%' THEN NULL ELSE 'train' END AS g FROM {slides}) q
 WHERE g IS NULL OR g = 'test'""",
)
def filter_by_groups(t: Tables) -> DataFrame:
    group = nm.classify_group(F.col("slide_path"), "/data")
    known = F.when(~F.startswith("slide_path", F.lit("/data/misc/")), F.array(group))
    items = t.slides.withColumn("groups", known)
    return an.filter_by_groups(items, ["test"]).select("slide_name", F.get("groups", 0).alias("g"))


@query(
    "counts_by_slide",
    """SELECT slide_name, COUNT(*) FILTER (type = 'cell_marker') AS cell_marker, COUNT(*) FILTER (type = 'region') AS region, COUNT(*) FILTER (type = 'fov') AS fov
 FROM {annotations} GROUP BY slide_name""",
)
def counts_by_slide(t: Tables) -> DataFrame:
    return an.counts_by_slide(t.annotations)


@query(
    "summary",
    """SELECT type, COUNT(*) AS n, COUNT(DISTINCT slide_name) AS slides, CASE WHEN type = 'cell_marker' THEN COUNT(DISTINCT biomarker) FILTER (biomarker <> '') ELSE 0 END AS biomarkers,
 CASE WHEN type = 'cell_marker' THEN COALESCE(string_agg(DISTINCT biomarker, ',' ORDER BY biomarker) FILTER (biomarker <> ''), '') ELSE '' END AS biomarker_names
 FROM {annotations} GROUP BY type""",
)
def summary(t: Tables) -> DataFrame:
    return an.summary(t.annotations)


@query("distinct_channels", "SELECT DISTINCT biomarker FROM {markers} WHERE biomarker <> ''")
def distinct_channels(t: Tables) -> DataFrame:
    return an.distinct_channels(t.annotations, "cell_marker")


@query(
    "channels_by_slide",
    "SELECT slide_name, string_agg(DISTINCT biomarker, ',' ORDER BY biomarker) AS channels FROM {markers} WHERE biomarker <> '' GROUP BY slide_name",
)
def channels_by_slide(t: Tables) -> DataFrame:
    out = an.channels_by_slide(t.annotations, "cell_marker")
    return out.withColumn("channels", nm.csv_join(F.col("channels")))


@query("fov_counts_by_channel", "SELECT slide_name, biomarker, COUNT(*) AS n FROM {fovs} GROUP BY slide_name, biomarker")
def fov_counts_by_channel(t: Tables) -> DataFrame:
    return an.fov_counts_by_channel(t.fovs)


@query(
    "annotated_channels",
    "SELECT slide_name, idx, name FROM {channels} c WHERE EXISTS (SELECT 1 FROM {fovs} f WHERE f.slide_name = c.slide_name AND f.biomarker = c.name)",
)
def annotated_channels(t: Tables) -> DataFrame:
    return an.annotated_channels(t.channels, t.fovs)


@query(
    "all_annotations",
    """SELECT id, 'cell_marker' AS type, slide_name, x, CAST(NULL AS DOUBLE) AS rad FROM {markers} UNION ALL SELECT id, 'region', slide_name, NULL, rad FROM {regions}
 UNION ALL SELECT id, 'fov', slide_name, x, NULL FROM {fovs}""",
)
def all_annotations(t: Tables) -> DataFrame:
    return an.all_annotations(t.markers, t.regions, t.fovs).select("id", "type", "slide_name", "x", "rad")


@query("marker_channels_selected", "SELECT DISTINCT biomarker FROM {markers} WHERE biomarker IN (SELECT name FROM {channels})")
def marker_channels_selected(t: Tables) -> DataFrame:
    selected = t.channels.select(F.col("name").alias("biomarker"))
    return t.markers.select("biomarker").intersect(selected)


@query(
    "stale_files",
    """SELECT slide_name, file_name FROM {fov_files} EXCEPT SELECT slide_name,
 slide_name || '_' || biomarker || '_' || CAST(CAST(round_even(x,0) AS BIGINT) AS STRING) || '_' || CAST(CAST(round_even(y,0) AS BIGINT) AS STRING) || '.png' FROM {fovs}""",
)
def stale_files(t: Tables) -> DataFrame:
    from lamella.operators.export import expected_names

    return t.fov_files.select("slide_name", "file_name").subtract(expected_names(t.fovs))


@query(
    "latest_per_key",
    """SELECT slide_name, biomarker, id, x FROM (SELECT *, row_number() OVER (PARTITION BY slide_name, biomarker ORDER BY created_at DESC, id DESC) AS rn FROM {markers}) q WHERE rn = 1""",
)
def latest_per_key(t: Tables) -> DataFrame:
    rows = t.markers.select("slide_name", "biomarker", "created_at", "id", "x")
    return an.latest_per_key(rows, ["slide_name", "biomarker"], ["created_at", "id"]).drop("created_at")


@query("load_order", "SELECT id, slide_name, row_number() OVER (PARTITION BY slide_name ORDER BY created_at, id) AS pos FROM {annotations}")
def load_order(t: Tables) -> DataFrame:
    order = [F.col("created_at").asc(), F.col("id").asc()]
    return numbered(an.load_order(t.annotations).select("id", "slide_name", "created_at"), order, ["slide_name"], "pos").drop("created_at")


@query(
    "slide_paths_of_annotated",
    """SELECT a.slide_name, s.slide_path FROM (SELECT DISTINCT slide_name FROM {annotations}) a LEFT JOIN (SELECT * FROM {slides} WHERE slide_path NOT LIKE '%/misc/%') s ON s.slide_name = a.slide_name""",
)
def slide_paths_of_annotated(t: Tables) -> DataFrame:
    known = t.slides.where(~F.contains("slide_path", F.lit("/misc/")))
    return an.slide_paths_of_annotated(t.annotations, known)


@query("sql_query", "SELECT type, COUNT(*) AS n, COUNT(DISTINCT slide_name) AS slides FROM {annotations} GROUP BY type")
def sql_query(t: Tables) -> DataFrame:
    return run_sql("SELECT type, COUNT(*) AS n, COUNT(DISTINCT slide_name) AS slides FROM annotations GROUP BY type", {"annotations": t.annotations})


@query(
    "sql_canned",
    "SELECT 'all' AS question, '' AS biomarker, COUNT(*) AS n FROM {annotations} UNION ALL SELECT 'per_biomarker', biomarker, COUNT(*) FROM {annotations} GROUP BY biomarker",
)
def sql_canned(t: Tables) -> DataFrame:
    every = an.count_all(t.annotations).select(F.lit("all").alias("question"), F.lit("").alias("biomarker"), "n")
    each = an.count_per_biomarker(t.annotations).select(F.lit("per_biomarker").alias("question"), "biomarker", "n")
    return every.unionByName(each)
