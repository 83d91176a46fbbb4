"""Queries on spatial joins, exports, imports and image-file plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.operators import export as ex
from lamella.operators import spatial as sp
from lamella.plans.annotation_queries import pairs_of
from lamella.plans.flagship import NAIVE, gt_boxes, pred_boxes, rounded
from lamella.plans.registry import query
from lamella.session import durable, scratch_path
from lamella.sources import files as fl
from lamella.sources import tables as tb
from lamella.sources.derived import Tables

FILE_NAME = "{0}.slide_name || '_' || {0}.{1} || '_' || CAST(CAST(round_even({0}.{2}x,0) AS BIGINT) AS STRING) || '_' || CAST(CAST(round_even({0}.{2}y,0) AS BIGINT) AS STRING) || '.png'"
BOX_TEXT = "CAST(CAST(round_even(x-10-fov_x,0) AS INT) AS STRING) || ',' || CAST(CAST(round_even(y-10-fov_y,0) AS INT) AS STRING) || ',' || CAST(CAST(round_even(x+10-fov_x,0) AS INT) AS STRING) || ',' || CAST(CAST(round_even(y+10-fov_y,0) AS INT) AS STRING)"


@query("markers_in_fovs", "SELECT slide_name, marker_id, biomarker, fov_id, fov_channel FROM {mf}", NAIVE)
def markers_in_fovs(t: Tables) -> DataFrame:
    return pairs_of(t).select("slide_name", "marker_id", "biomarker", "fov_id", "fov_channel")


@query("markers_in_fovs_same_channel", "SELECT slide_name, marker_id, fov_id FROM {mf} WHERE biomarker = fov_channel", NAIVE)
def markers_in_fovs_same_channel(t: Tables) -> DataFrame:
    return sp.markers_in_fovs(t.markers, t.fovs, same_channel=True).select("slide_name", "marker_id", "fov_id")


@query("iou_join", "SELECT slide_name, fov_id, marker, pred, gt, round(iou, 6) AS iou FROM {ov} WHERE iou >= 0.3", NAIVE)
def iou_join(t: Tables) -> DataFrame:
    out = sp.iou_join(pred_boxes(t), gt_boxes(t), ["slide_name", "fov_id", "marker"], 0.3)
    return rounded(out.withColumn("gt", F.col("gt.marker_id")), "iou")


@query(
    "ground_truth_boxes",
    "SELECT g.slide_name, fov_id, marker, marker_id, x1, y1, x2, y2 FROM {gtb} g JOIN {slides} s ON s.slide_name = g.slide_name WHERE marker IN ('CD8', 'CD68')",
    NAIVE,
)
def ground_truth_boxes(t: Tables) -> DataFrame:
    from lamella.operators.evaluation import ground_truth_boxes as boxes

    out = boxes(pairs_of(t), t.slides, ["CD8", "CD68"])
    return out.select("slide_name", "fov_id", "marker", F.col("key.marker_id").alias("marker_id"), "x1", "y1", "x2", "y2")


@query(
    "find_fov",
    """SELECT e.slide_name, e.x, e.y, e.file_name, f.id AS fov_id FROM (SELECT slide_name, file_name,
 CAST(regexp_extract(file_name, '_(-?\\d+)_(-?\\d+)\\.png$', 1) AS BIGINT) AS x, CAST(regexp_extract(file_name, '_(-?\\d+)_(-?\\d+)\\.png$', 2) AS BIGINT) AS y FROM {fov_files}) e
 JOIN (SELECT *, row_number() OVER (PARTITION BY slide_name, round_even(x,0), round_even(y,0) ORDER BY created_at, id) AS rn FROM {fovs}) f
 ON f.slide_name = e.slide_name AND f.rn = 1 AND round_even(f.x,0) = e.x AND round_even(f.y,0) = e.y""",
)
def find_fov(t: Tables) -> DataFrame:
    e = t.fov_files.withColumn("p", nm.parse_fov_name(F.col("file_name")))
    entries = e.select("slide_name", F.col("p.x").alias("x"), F.col("p.y").alias("y"), "file_name")
    return sp.find_fov(entries, t.fovs)


@query(
    "nearest_marker",
    """SELECT slide_name, point_id, marker_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY slide_name, point_id ORDER BY d2, marker_id) AS rn FROM (
 SELECT f.slide_name, f.id AS point_id, m.id AS marker_id, (m.x-f.x)*(m.x-f.x) + (m.y-f.y)*(m.y-f.y) AS d2 FROM {fovs} f JOIN {markers} m ON m.slide_name = f.slide_name) a WHERE d2 <= 10000) b WHERE rn = 1""",
)
def nearest_marker(t: Tables) -> DataFrame:
    points = t.fovs.select("slide_name", F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return sp.nearest_marker(points, t.markers, 100.0)


@query(
    "fov_annotation_counts",
    "SELECT f.id AS fov_id, f.slide_name, COUNT(q.marker_id) AS n FROM {fovs} f LEFT JOIN (SELECT * FROM {mf} WHERE biomarker = fov_channel) q ON q.fov_id = f.id GROUP BY f.id, f.slide_name",
    NAIVE,
)
def fov_annotation_counts(t: Tables) -> DataFrame:
    entries = t.fovs.select(F.col("id").alias("fov_id"), "slide_name")
    return sp.fov_annotation_counts(entries, sp.markers_in_fovs(t.markers, t.fovs, same_channel=True))


@query(
    "export_box_text",
    f"""SELECT slide_name, biomarker, fov_id, slide_name || '_' || CAST(CAST(round_even(fov_x,0) AS BIGINT) AS STRING) || '_' || CAST(CAST(round_even(fov_y,0) AS BIGINT) AS STRING)
 || ': ' || string_agg({BOX_TEXT}, ' ' ORDER BY created_at, marker_id) AS line FROM {{mf}} GROUP BY slide_name, biomarker, fov_id, fov_x, fov_y""",
    NAIVE,
)
def export_box_text(t: Tables) -> DataFrame:
    return ex.box_text_lines(pairs_of(t)).select("slide_name", "biomarker", "fov_id", "line")


@query(
    "box_text_files",
    f"""SELECT slide_name || '_' || biomarker || '.txt' AS file_name, slide_name || '_' || CAST(CAST(round_even(fov_x,0) AS BIGINT) AS STRING) || '_' || CAST(CAST(round_even(fov_y,0) AS BIGINT) AS STRING)
 || ': ' || string_agg({BOX_TEXT}, ' ' ORDER BY created_at, marker_id) AS line FROM {{mf}} WHERE biomarker IN ('CD8', 'CD68', 'PanCK') GROUP BY slide_name, biomarker, fov_id, fov_x, fov_y""",
    NAIVE,
)
def box_text_files(t: Tables) -> DataFrame:
    """The lines of the files written for some channels, as another tool reads them."""
    root = scratch_path(t.spark, "boxes")
    ex.export_box_text(pairs_of(t), root, ["CD8", "CD68", "PanCK"])
    return t.spark.read.text(root).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("line"))


IMAGES = {
    **NAIVE,
    "imgs": "SELECT *, row_number() OVER (PARTITION BY slide_name ORDER BY biomarker, fov_created_at, fov_id) AS id FROM (SELECT DISTINCT slide_name, biomarker, fov_id, fov_created_at, fov_x, fov_y, fov_w, fov_h FROM {mf}) q",
    "cats": "SELECT slide_name, name, row_number() OVER (PARTITION BY slide_name ORDER BY name) AS id FROM (SELECT DISTINCT slide_name, biomarker AS name FROM {markers}) q",
}


@query("export_coco_categories", "SELECT slide_name, id, name FROM {cats}", IMAGES)
def export_coco_categories(t: Tables) -> DataFrame:
    return ex.coco_categories(t.markers)


@query(
    "export_coco_images",
    f"SELECT i.slide_name, i.id, {FILE_NAME.format('i', 'biomarker', 'fov_')} AS file_name, CAST(i.fov_w AS INT) AS width, CAST(i.fov_h AS INT) AS height FROM {{imgs}} i",
    IMAGES,
)
def export_coco_images(t: Tables) -> DataFrame:
    return ex.coco_images(pairs_of(t)).select("slide_name", "id", "file_name", "width", "height")


@query(
    "export_coco",
    """SELECT slide_name, id, image_id, category_id, bbox_x, bbox_y, 20 AS bbox_w, 20 AS bbox_h, 400 AS area, 0 AS iscrowd FROM (
 SELECT q.slide_name, i.id AS image_id, c.id AS category_id, round_even(q.x-10-q.fov_x,2) AS bbox_x, round_even(q.y-10-q.fov_y,2) AS bbox_y,
  row_number() OVER (PARTITION BY q.slide_name ORDER BY i.id, q.created_at, q.marker_id) AS id
 FROM {mf} q JOIN {imgs} i ON i.slide_name = q.slide_name AND i.biomarker = q.biomarker AND i.fov_id = q.fov_id JOIN {cats} c ON c.slide_name = q.slide_name AND c.name = q.biomarker) z""",
    IMAGES,
)
def export_coco(t: Tables) -> DataFrame:
    # Read for the images and for the annotations: the join is made once.
    pairs = durable(pairs_of(t))
    return ex.coco_annotations(pairs, ex.coco_images(pairs), ex.coco_categories(t.markers))


CHOSEN = {
    **NAIVE,
    "cm": "SELECT * FROM {mf} WHERE biomarker IN ('CD8', 'FOXP3')",
    "ci": "SELECT *, row_number() OVER (PARTITION BY slide_name ORDER BY biomarker, fov_created_at, fov_id) AS id FROM (SELECT DISTINCT slide_name, biomarker, fov_id, fov_created_at, fov_x, fov_y, fov_w, fov_h FROM {cm}) q",
    "cc": "SELECT slide_name, name, row_number() OVER (PARTITION BY slide_name ORDER BY name) AS id FROM (SELECT DISTINCT slide_name, biomarker AS name FROM {markers} WHERE biomarker IN ('CD8', 'FOXP3')) q",
}


@query(
    "coco_files",
    f"""SELECT m.slide_name || '_coco.json' AS document, m.slide_name, row_number() OVER (PARTITION BY m.slide_name ORDER BY i.id, m.created_at, m.marker_id) AS id, i.id AS image_id,
 {FILE_NAME.format('i', 'biomarker', 'fov_')} AS file_name, CAST(i.fov_w AS INT) AS width, CAST(i.fov_h AS INT) AS height, c.id AS category_id, m.biomarker,
 round_even(m.x-10-m.fov_x,2) AS bbox_x, round_even(m.y-10-m.fov_y,2) AS bbox_y, 20::DOUBLE AS bbox_w, 20::DOUBLE AS bbox_h, 400::DOUBLE AS area, CAST(0 AS INT) AS iscrowd
 FROM {{cm}} m JOIN {{ci}} i ON i.slide_name = m.slide_name AND i.biomarker = m.biomarker AND i.fov_id = m.fov_id JOIN {{cc}} c ON c.slide_name = m.slide_name AND c.name = m.biomarker""",
    CHOSEN,
)
def coco_files(t: Tables) -> DataFrame:
    """The annotations of the documents written for two channels, read back whole."""
    root = scratch_path(t.spark, "coco")
    ex.export_coco(pairs_of(t), t.markers, root, ["CD8", "FOXP3"])
    return fl.read_coco(t.spark, root)


@query(
    "coco_ids",
    """SELECT q.slide_name, q.marker_id, q.fov_id, i.id AS image_id, row_number() OVER (PARTITION BY q.slide_name ORDER BY i.id, q.created_at, q.marker_id) AS ann_id
 FROM {mf} q JOIN {imgs} i ON i.slide_name = q.slide_name AND i.biomarker = q.biomarker AND i.fov_id = q.fov_id""",
    IMAGES,
)
def coco_ids(t: Tables) -> DataFrame:
    from lamella.session import numbered

    pairs = durable(pairs_of(t).select(*ex.FOV_GROUP, "marker_id", "created_at", "fov_created_at", "fov_x", "fov_y", "fov_w", "fov_h"))
    link = ex.coco_images(pairs).select(*ex.FOV_GROUP, F.col("id").alias("image_id"))
    rows = pairs.join(link, ex.FOV_GROUP).select("slide_name", "marker_id", "fov_id", "image_id", "created_at")
    order = [F.col(c).asc() for c in ("image_id", "created_at", "marker_id")]
    return numbered(rows, order, ["slide_name"], "ann_id").drop("created_at")


@query("fov_file_name", f"SELECT f.id, {FILE_NAME.format('f', 'biomarker', '')} AS file_name FROM {{fovs}} f")
def fov_file_name(t: Tables) -> DataFrame:
    return t.fovs.select("id", nm.fov_file_name(*[F.col(c) for c in ("slide_name", "biomarker", "x", "y")]).alias("file_name"))


@query(
    "parse_fov_filename",
    r"""SELECT file_name, CASE WHEN head LIKE '%\_%' ESCAPE '\' THEN regexp_extract(head, '^(.*)_[^_]*$', 1) ELSE '' END AS slide_name, regexp_extract(head, '([^_]*)$', 1) AS channel, x, y FROM (
 SELECT file_name, regexp_extract(file_name, '^(.+)_(-?\d+)_(-?\d+)\.png$', 1) AS head, CAST(regexp_extract(file_name, '^(.+)_(-?\d+)_(-?\d+)\.png$', 2) AS BIGINT) AS x,
  CAST(regexp_extract(file_name, '^(.+)_(-?\d+)_(-?\d+)\.png$', 3) AS BIGINT) AS y FROM {fov_files}) q""",
)
def parse_fov_filename(t: Tables) -> DataFrame:
    return t.fov_files.select("file_name", nm.parse_fov_name(F.col("file_name")).alias("p")).select("file_name", "p.*")


EXPECTED = {
    **NAIVE,
    "want": f"SELECT DISTINCT f.slide_name, {FILE_NAME.format('f', 'biomarker', '')} AS file_name FROM {{fovs}} f",
    "wantm": f"SELECT DISTINCT q.slide_name, {FILE_NAME.format('q', 'biomarker', 'fov_')} AS file_name FROM {{mf}} q",
    "wantr": f"SELECT DISTINCT f.slide_name, {FILE_NAME.format('f', 'biomarker', '')} AS file_name FROM {{fovs}} f WHERE EXISTS (SELECT 1 FROM {{regions}} r WHERE r.slide_name = f.slide_name AND r.biomarker = f.biomarker)",
}


@query(
    "fov_sync_plan",
    """SELECT COALESCE(w.slide_name, d.slide_name) AS slide_name, COALESCE(w.file_name, d.file_name) AS file_name,
 CASE WHEN w.file_name IS NULL THEN 'delete' WHEN d.file_name IS NULL THEN 'write' ELSE 'keep' END AS action
 FROM {want} w FULL OUTER JOIN (SELECT DISTINCT slide_name, file_name FROM {fov_files}) d ON d.slide_name = w.slide_name AND d.file_name = w.file_name""",
    EXPECTED,
)
def fov_sync_plan(t: Tables) -> DataFrame:
    files = ex.files_of_slides(t.fov_files.select("file_name"), t.slides)
    return ex.fov_sync_plan(t.fovs, files)


MISSING = "SELECT DISTINCT w.slide_name FROM {0} w LEFT JOIN {{fov_files}} d ON d.slide_name = w.slide_name AND d.file_name = w.file_name WHERE d.file_name IS NULL"


@query("missing_fov_images_marker", MISSING.format("{wantm}"), EXPECTED)
def missing_fov_images_marker(t: Tables) -> DataFrame:
    return ex.missing_fov_images(ex.expected_marker_images(pairs_of(t)), t.fov_files)


@query("missing_fov_images", MISSING.format("{wantr}"), EXPECTED)
def missing_fov_images(t: Tables) -> DataFrame:
    return ex.missing_fov_images(ex.expected_region_images(t.fovs, t.regions), t.fov_files)


BOXES = {
    **NAIVE,
    "rb": """SELECT slide_name, biomarker, CAST(round_even(fov_x,0) AS INT) AS fov_x, CAST(round_even(fov_y,0) AS INT) AS fov_y,
 round_even(fov_x,0) + (round_even(x-10-fov_x,0) + round_even(x+10-fov_x,0))/2 AS x, round_even(fov_y,0) + (round_even(y-10-fov_y,0) + round_even(y+10-fov_y,0))/2 AS y FROM {mf}""",
}


def parsed_boxes(t: Tables) -> DataFrame:
    lines = ex.box_text_lines(pairs_of(t)).withColumnRenamed("line", "value")
    stems = lines.select("value", F.concat_ws("_", "slide_name", "biomarker").alias("stem"))
    return fl.parse_box_text(fl.of_slides(stems, t.slides, "stem").withColumnRenamed("rest", "biomarker"))


@query("read_box_text", "SELECT slide_name, biomarker, fov_x, fov_y, x, y FROM {rb}", BOXES)
def read_box_text(t: Tables) -> DataFrame:
    return parsed_boxes(t)


@query(
    "load_structured",
    r"""SELECT 'cell_marker' AS type, slide_name, biomarker, x, y, CAST(10 AS DOUBLE) AS w, CAST(10 AS DOUBLE) AS h FROM {rb}
 UNION ALL SELECT 'fov', slide_name, '', CAST(fov_x AS DOUBLE), CAST(fov_y AS DOUBLE), 512, 512 FROM (SELECT slide_name, fov_x, fov_y FROM {rb}
  UNION SELECT slide_name, CAST(regexp_extract(file_name, '_(-?\d+)_(-?\d+)\.png$', 1) AS INT), CAST(regexp_extract(file_name, '_(-?\d+)_(-?\d+)\.png$', 2) AS INT) FROM {fov_files}) u
 UNION ALL SELECT 'region', slide_name, biomarker, NULL, NULL, NULL, NULL FROM {regions}""",
    BOXES,
)
def load_structured(t: Tables) -> DataFrame:
    return structured(t).select("type", "slide_name", "biomarker", "x", "y", "w", "h")


def structured(t: Tables) -> DataFrame:
    from lamella.plans.region_queries import region_table

    docs = ex.regions_json(region_table(t))
    parsed = docs.select("slide_name", F.from_json("js", fl.REGION_JSON).alias("d")).select("slide_name", "d.*")
    fovs = fl.region_image_fovs(t.fov_files, t.slides)
    return fl.load_structured(parsed_boxes(t), fovs, fl.regions_from_json(parsed))


@query(
    "import_structured",
    r"""SELECT type, slide_name, biomarker, x, y, n_points, CAST(1 AS BIGINT) AS same_id, true AS dated FROM (
 SELECT 'cell_marker' AS type, slide_name, biomarker, x, y, CAST(0 AS BIGINT) AS n_points FROM {rb}
 UNION ALL SELECT 'fov', slide_name, '', CAST(fov_x AS DOUBLE), CAST(fov_y AS DOUBLE), 0 FROM (SELECT slide_name, fov_x, fov_y FROM {rb}
  UNION SELECT slide_name, CAST(regexp_extract(file_name, '_(-?\d+)_(-?\d+)\.png$', 1) AS INT), CAST(regexp_extract(file_name, '_(-?\d+)_(-?\d+)\.png$', 2) AS INT) FROM {fov_files}) u
 UNION ALL SELECT 'region', r.slide_name, r.biomarker, NULL, NULL, COUNT(*) FROM {regions} r JOIN {region_points} p ON p.annotation_id = r.id GROUP BY r.id, r.slide_name, r.biomarker) q""",
    BOXES,
)
def import_structured(t: Tables) -> DataFrame:
    """Parsed files saved as annotations and read back: every row has an id of its own and a time."""
    from lamella.operators.regions import explode_region_points

    root = scratch_path(t.spark, "imported")
    rows = durable(structured(t))
    regions = rows.where("type = 'region'")
    points = explode_region_points(regions, ["slide_name"])
    tb.save_annotations(rows.drop("rings"), points, rows.select("slide_name"), root, F.current_timestamp())
    back = tb.read_annotations(t.spark, root)
    n = back["region_points"].groupBy(F.col("annotation_id").alias("id")).agg(F.count("*").alias("n"))
    same = F.count("*").over(Window.partitionBy("id"))
    out = back["annotations"].withColumn("same_id", same).join(n, "id", "left")
    return out.select(
        "type", "slide_name", "biomarker", "x", "y", F.coalesce("n", F.lit(0)).alias("n_points"), "same_id", F.col("created_at").isNotNull().alias("dated")
    )
