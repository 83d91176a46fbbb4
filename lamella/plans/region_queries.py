"""Queries on region geometry, masks, components, merge and subtraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import rings as rg
from lamella.operators import export as ex
from lamella.operators import regions as rn
from lamella.operators import spatial as sp
from lamella.plans.registry import query
from lamella.session import durable, scratch_path
from lamella.sources import files as fl
from lamella.sources import tables as tb
from lamella.sources.derived import Tables


def region_table(t: Tables) -> DataFrame:
    """Regions with slide, channel and rings."""
    meta = t.regions.select("id", "slide_name", "biomarker")
    return rn.assemble_regions(t.region_points).join(meta, "id")


def bboxes(t: Tables) -> DataFrame:
    meta = t.regions.select(F.col("id").alias("region_id"), "slide_name", "biomarker")
    return rn.region_bboxes(t.region_points).join(meta, "region_id")


GEO = {
    "edge": """SELECT p.annotation_id AS id, r.slide_name, r.biomarker, p.ring, p.seq, p.px AS x1, p.py AS y1,
 COALESCE(lead(p.px) OVER w, first_value(p.px) OVER w) AS x2, COALESCE(lead(p.py) OVER w, first_value(p.py) OVER w) AS y2
 FROM {region_points} p JOIN {regions} r ON r.id = p.annotation_id WINDOW w AS (PARTITION BY p.annotation_id, p.ring ORDER BY p.seq)""",
    "bb": "SELECT r.id, r.slide_name, r.biomarker, MIN(p.px) AS x1, MIN(p.py) AS y1, MAX(p.px) AS x2, MAX(p.py) AS y2 FROM {region_points} p JOIN {regions} r ON r.id = p.annotation_id WHERE p.ring = 0 GROUP BY r.id, r.slide_name, r.biomarker",
    "rf": """SELECT b.slide_name, b.biomarker, b.id AS region_id, f.id AS fov_id, f.x AS fov_x, f.y AS fov_y, CAST(f.w AS INT) AS w, CAST(f.h AS INT) AS h FROM {bb} b JOIN {fovs} f
 ON f.slide_name = b.slide_name AND f.biomarker = b.biomarker AND NOT (b.x2 < f.x OR b.x1 > f.x + f.w OR b.y2 < f.y OR b.y1 > f.y + f.h)""",
    "cand": "SELECT a.id AS a, b.id AS b, a.slide_name, a.biomarker FROM {bb} a JOIN {bb} b ON a.slide_name = b.slide_name AND a.biomarker = b.biomarker AND a.id < b.id AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2",
    "crossing_pairs": """SELECT DISTINCT c.a, c.b FROM {cand} c JOIN {edge} e ON e.id = c.a JOIN {edge} g ON g.id = c.b
 WHERE greatest(e.x1,e.x2) >= least(g.x1,g.x2) AND greatest(g.x1,g.x2) >= least(e.x1,e.x2) AND greatest(e.y1,e.y2) >= least(g.y1,g.y2) AND greatest(g.y1,g.y2) >= least(e.y1,e.y2)
 AND ((e.x2-e.x1)*(g.y1-e.y1)-(e.y2-e.y1)*(g.x1-e.x1)) * ((e.x2-e.x1)*(g.y2-e.y1)-(e.y2-e.y1)*(g.x2-e.x1)) <= 0
 AND ((g.x2-g.x1)*(e.y1-g.y1)-(g.y2-g.y1)*(e.x1-g.x1)) * ((g.x2-g.x1)*(e.y2-g.y1)-(g.y2-g.y1)*(e.x2-g.x1)) <= 0""",
    "inside_pairs": """SELECT c.a, c.b FROM {cand} c JOIN {edge} p ON p.id = c.a AND p.seq = 0 JOIN {edge} e ON e.id = c.b
  WHERE (e.y1 > p.y1) <> (e.y2 > p.y1) AND p.x1 < (e.x2-e.x1)*(p.y1-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY c.a, c.b HAVING COUNT(*) % 2 = 1
 UNION ALL SELECT c.a, c.b FROM {cand} c JOIN {edge} p ON p.id = c.b AND p.seq = 0 JOIN {edge} e ON e.id = c.a
  WHERE (e.y1 > p.y1) <> (e.y2 > p.y1) AND p.x1 < (e.x2-e.x1)*(p.y1-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY c.a, c.b HAVING COUNT(*) % 2 = 1""",
    "touch": "SELECT DISTINCT c.slide_name, c.biomarker, c.a, c.b FROM {cand} c JOIN (SELECT a, b FROM {crossing_pairs} UNION SELECT a, b FROM {inside_pairs}) h ON h.a = c.a AND h.b = c.b",
}

CC = {
    **GEO,
    "reach": """SELECT a AS id, a AS label FROM {touch} UNION SELECT b, b FROM {touch}
UNION
SELECT CASE WHEN t.a = reach.id THEN t.b ELSE t.a END, reach.label FROM reach JOIN {touch} t ON t.a = reach.id OR t.b = reach.id""",
    "comp": "SELECT id, MIN(label) AS label FROM {reach} GROUP BY id",
}

# Scan-line runs in slide pixels, for merge and subtraction.
RUNS = {
    **CC,
    "slide_hit": """SELECT id, yy, x1 + (yy + 0.5 - y1) * (x2 - x1) / (y2 - y1) AS xc FROM (
 SELECT id, x1, y1, x2, y2, unnest(generate_series(CAST(ceil(least(y1,y2) - 0.5) AS BIGINT), CAST(ceil(greatest(y1,y2) - 0.5) AS BIGINT) - 1)) AS yy FROM {edge}) q""",
    "slide_runs": """SELECT id, yy, CAST(ceil(xc - 0.5) AS BIGINT) AS x0, CAST(ceil(nxt - 0.5) AS BIGINT) - 1 AS x1 FROM (
 SELECT id, yy, xc, lead(xc) OVER w AS nxt, row_number() OVER w AS rn FROM {slide_hit} WINDOW w AS (PARTITION BY id, yy ORDER BY xc)) q WHERE rn % 2 = 1 AND ceil(xc - 0.5) <= ceil(nxt - 0.5) - 1""",
    "lab_runs": "SELECT c.label, r.yy, r.x0, r.x1 FROM {slide_runs} r JOIN {comp} c ON c.id = r.id",
    "lab_px": """SELECT label, CAST(SUM(hi - lo + 1) AS BIGINT) AS pixels FROM (SELECT label, yy, island, MIN(x0) AS lo, MAX(x1) AS hi FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY label, yy ORDER BY x0, x1) AS island FROM (
  SELECT *, CASE WHEN x0 <= MAX(x1) OVER (PARTITION BY label, yy ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {lab_runs}) a) b GROUP BY label, yy, island) c GROUP BY label""",
}

# Unions whose runs do not touch, and the corners of their outlines: run ends of a row that
# the row above does not share.
OUTLINES = {
    **RUNS,
    "lab_union": """SELECT label, yy, MIN(x0) AS x0, MAX(x1) AS x1 FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY label, yy ORDER BY x0, x1) AS island FROM (
  SELECT *, CASE WHEN x0 <= 1 + MAX(x1) OVER (PARTITION BY label, yy ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {lab_runs}) a) b GROUP BY label, yy, island""",
    "corners": """SELECT label, COUNT(*) AS n_points FROM (SELECT label, y, x, s FROM (
 SELECT label, yy AS y, x0 AS x, 0 AS s FROM {lab_union} UNION ALL SELECT label, yy, x1 + 1, 1 FROM {lab_union}
 UNION ALL SELECT label, yy + 1, x0, 0 FROM {lab_union} UNION ALL SELECT label, yy + 1, x1 + 1, 1 FROM {lab_union}) e
 GROUP BY label, y, x, s HAVING COUNT(*) = 1) c GROUP BY label""",
}

FOV_RUNS = {
    **GEO,
    "fov_hit": """SELECT slide_name, biomarker, fov_id, region_id, w, yy, ax + (yy + 0.5 - ay) * (bx - ax) / (by_ - ay) AS xc FROM (
 SELECT p.slide_name, p.biomarker, p.fov_id, p.region_id, p.w, e.x1 - p.fov_x AS ax, e.y1 - p.fov_y AS ay, e.x2 - p.fov_x AS bx, e.y2 - p.fov_y AS by_,
  unnest(generate_series(greatest(0, CAST(ceil(least(e.y1,e.y2) - p.fov_y - 0.5) AS BIGINT)), least(p.h - 1, CAST(ceil(greatest(e.y1,e.y2) - p.fov_y - 0.5) AS BIGINT) - 1))) AS yy
 FROM {rf} p JOIN {edge} e ON e.id = p.region_id) q""",
    "fov_runs": """SELECT slide_name, biomarker, fov_id, region_id, yy, greatest(0, CAST(ceil(xc - 0.5) AS BIGINT)) AS x0, least(w - 1, CAST(ceil(nxt - 0.5) AS BIGINT) - 1) AS x1 FROM (
 SELECT *, lead(xc) OVER k AS nxt, row_number() OVER k AS rn FROM {fov_hit} WINDOW k AS (PARTITION BY fov_id, region_id, yy ORDER BY xc)) q
 WHERE rn % 2 = 1 AND greatest(0, ceil(xc - 0.5)) <= least(w - 1, ceil(nxt - 0.5) - 1)""",
    "fov_union": """SELECT slide_name, biomarker, fov_id, CAST(yy AS INT) AS row, CAST(MIN(x0) AS INT) AS x0, CAST(MAX(x1) AS INT) AS x1 FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY fov_id, yy ORDER BY x0, x1) AS island FROM (
  SELECT *, CASE WHEN x0 <= 1 + MAX(x1) OVER (PARTITION BY fov_id, yy ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {fov_runs}) a) b GROUP BY slide_name, biomarker, fov_id, yy, island""",
}


@query("regions_in_fovs", "SELECT slide_name, biomarker, region_id, fov_id FROM {rf}", GEO)
def regions_in_fovs(t: Tables) -> DataFrame:
    return sp.regions_in_fovs(bboxes(t), t.fovs).select("slide_name", "biomarker", "region_id", "fov_id")


@query("fov_region_counts", "SELECT f.id AS fov_id, COUNT(p.region_id) AS n FROM {fovs} f LEFT JOIN {rf} p ON p.fov_id = f.id GROUP BY f.id", GEO)
def fov_region_counts(t: Tables) -> DataFrame:
    entries = t.fovs.select(F.col("id").alias("fov_id"))
    return sp.fov_annotation_counts(entries, sp.regions_in_fovs(bboxes(t), t.fovs))


@query(
    "assemble_regions",
    "SELECT annotation_id AS id, string_agg(CAST(ring AS STRING) || ':' || CAST(CAST(px*8 AS BIGINT) AS STRING) || ',' || CAST(CAST(py*8 AS BIGINT) AS STRING), ' ' ORDER BY ring, seq) AS points FROM {region_points} GROUP BY annotation_id",
)
def assemble_regions(t: Tables) -> DataFrame:
    def text(ring, k):
        return F.transform(ring, lambda p: F.concat(k.cast("string"), F.lit(":"), (p["x"] * 8).cast("bigint"), F.lit(","), (p["y"] * 8).cast("bigint")))

    out = rn.assemble_regions(t.region_points)
    return out.select("id", F.array_join(F.flatten(F.transform("rings", text)), " ").alias("points"))


@query("explode_region_points", "SELECT annotation_id, seq, px, py, ring FROM {region_points}")
def explode_region_points(t: Tables) -> DataFrame:
    return rn.explode_region_points(rn.assemble_regions(t.region_points))


@query("ring_area", "SELECT id, ring, round(SUM(x1*y2 - x2*y1)/2, 6) AS area FROM {edge} GROUP BY id, ring", GEO)
def ring_area(t: Tables) -> DataFrame:
    rings = region_table(t).select("id", F.posexplode("rings").alias("ring", "pts"))
    return rings.select("id", "ring", F.round(rg.ring_area(F.col("pts")), 6).alias("area"))


@query(
    "split_outer_holes",
    "SELECT id, CAST(8 AS INT) AS outer_points, CAST(CASE WHEN has_hole THEN 1 ELSE 0 END AS INT) AS n_holes FROM {regions}",
)
def split_outer_holes(t: Tables) -> DataFrame:
    backwards = region_table(t).withColumn("rings", F.reverse("rings"))
    parts = rg.split_outer_holes(F.col("rings"))
    return backwards.select("id", F.size(parts["outer"]).alias("outer_points"), F.size(parts["holes"]).alias("n_holes"))


@query(
    "clean_rings",
    "SELECT id, CAST(CASE WHEN has_hole THEN 2 ELSE 1 END AS INT) AS n_rings, CAST(CASE WHEN has_hole THEN 12 ELSE 8 END AS INT) AS n_points FROM {regions}",
)
def clean_rings(t: Tables) -> DataFrame:
    # Close every ring and add a ring of two points; both must go.
    closed = F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1)))
    short = F.array(F.slice(F.get("rings", 0), 1, 2))
    dirty = region_table(t).withColumn("rings", rg.clean_rings(F.concat(closed, short)))
    return dirty.select("id", F.size("rings").alias("n_rings"), F.size(F.flatten("rings")).alias("n_points"))


@query(
    "point_in_region",
    "SELECT id, NOT has_hole AS centre, true AS edge_zone FROM {regions}",
)
def point_in_region(t: Tables) -> DataFrame:
    rows = region_table(t).join(t.regions.select("id", "cx", "cy", "rad"), "id")
    inside = lambda x, y: rg.point_in_region(F.col("rings"), x, y)
    return rows.select("id", inside(F.col("cx"), F.col("cy")).alias("centre"), inside(F.col("cx") + F.col("rad") * 0.75, F.col("cy")).alias("edge_zone"))


@query("region_bbox", "SELECT id, x1, y1, x2, y2 FROM {bb}", GEO)
def region_bbox(t: Tables) -> DataFrame:
    outer = F.get("rings", 0)
    return region_table(t).select("id", *[c.alias(k) for k, c in rg.ring_bbox(outer).items()])


@query(
    "rasterize_region",
    "SELECT fov_id, region_id, CAST(SUM(x1 - x0 + 1) AS BIGINT) AS pixels, CAST(MIN(yy) AS INT) AS first_row, CAST(MAX(yy) AS INT) AS last_row FROM {fov_runs} GROUP BY fov_id, region_id",
    FOV_RUNS,
)
def rasterize_region(t: Tables) -> DataFrame:
    runs = rn.region_masks(region_table(t), sp.regions_in_fovs(bboxes(t), t.fovs))
    return runs.groupBy("fov_id", "region_id").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("pixels"), F.min("row").alias("first_row"), F.max("row").alias("last_row")
    )


@query("export_region_masks", "SELECT slide_name, biomarker, fov_id, row, x0, x1 FROM {fov_union}", FOV_RUNS)
def export_region_masks(t: Tables) -> DataFrame:
    return rn.export_region_masks(region_table(t), sp.regions_in_fovs(bboxes(t), t.fovs))


@query(
    "region_mask_files",
    """SELECT f.slide_name || '_' || f.biomarker || '_' || CAST(CAST(round_even(f.x,0) AS BIGINT) AS STRING) || '_' || CAST(CAST(round_even(f.y,0) AS BIGINT) AS STRING) || '.png' AS file_name,
 CAST(f.w AS INT) AS width, CAST(f.h AS INT) AS height, CAST(COUNT(*) AS INT) AS n_runs, string_agg(CAST(u.row AS STRING) || ':' || CAST(u.x0 AS STRING) || '-' || CAST(u.x1 AS STRING), ' ' ORDER BY u.row, u.x0) AS runs
 FROM {fov_union} u JOIN {fovs} f ON f.id = u.fov_id GROUP BY f.id, f.slide_name, f.biomarker, f.x, f.y, f.w, f.h""",
    FOV_RUNS,
)
def region_mask_files(t: Tables) -> DataFrame:
    masks = rn.export_region_masks(region_table(t), sp.regions_in_fovs(bboxes(t), t.fovs))
    text = F.transform("runs", lambda r: F.concat(r["row"], F.lit(":"), r["x0"], F.lit("-"), r["x1"]))
    return rn.mask_files(masks, t.fovs).select("file_name", "width", "height", F.size("runs").alias("n_runs"), F.array_join(text, " ").alias("runs"))


@query("touching_regions", "SELECT slide_name, biomarker, a, b FROM {touch}", GEO)
def touching_regions(t: Tables) -> DataFrame:
    return rn.touching_regions(region_table(t))


@query("connected_components", "SELECT id, label FROM {comp}", CC, recursive=True)
def connected_components(t: Tables) -> DataFrame:
    # Edges, points and boxes of the regions are read one by one: rings are assembled once.
    return rn.connected_components(rn.component_edges(durable(region_table(t))))


@query(
    "merge_regions",
    """SELECT r.slide_name, r.biomarker, c.label, arg_min(c.id, reverse(c.id)) AS first_id, MIN(reverse(c.id)) AS created_at, COUNT(*) AS n_members, MAX(p.pixels) AS pixels,
 CAST(MAX(o.n_points) AS INT) AS n_points, CAST(MAX(p.pixels) AS DOUBLE) AS area
 FROM {comp} c JOIN {regions} r ON r.id = c.id JOIN {lab_px} p ON p.label = c.label JOIN {corners} o ON o.label = c.label GROUP BY r.slide_name, r.biomarker, c.label""",
    OUTLINES,
    recursive=True,
)
def merge_regions(t: Tables) -> DataFrame:
    # A load order that is not the order of the ids.
    merged = rn.merge_regions(region_table(t).withColumn("created_at", F.reverse("id")))["merged"]
    # Outer rings and holes turn in opposite ways, so their areas add up to the region's.
    area = F.aggregate(F.transform("rings", rg.ring_area), F.lit(0.0), lambda a, v: a + v)
    return merged.withColumns({"n_points": F.size(F.flatten("rings")), "area": area}).drop("rings")


@query(
    "merged_region_fill",
    "SELECT label, CAST(yy AS INT) AS row, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1 FROM {lab_union}",
    OUTLINES,
    recursive=True,
)
def merged_region_fill(t: Tables) -> DataFrame:
    """The pixel runs inside the rings of the merged regions."""
    merged = rn.merge_regions(region_table(t))["merged"]
    return rn.rasterize(rn.region_edge_rows(merged, ["label"]), ["label"]).select("label", "row", "x0", "x1")


@query(
    "saved_merged_regions",
    """SELECT r.slide_name, r.biomarker, coalesce(sha256('merged:' || c.label), r.id) AS id, MAX(coalesce(p.pixels, q.pixels)) AS pixels
 FROM {regions} r LEFT JOIN {comp} c ON c.id = r.id LEFT JOIN {lab_px} p ON p.label = c.label
 LEFT JOIN (SELECT id, CAST(SUM(x1 - x0 + 1) AS BIGINT) AS pixels FROM {slide_runs} GROUP BY id) q ON q.id = r.id
 GROUP BY r.slide_name, r.biomarker, coalesce(sha256('merged:' || c.label), r.id)""",
    OUTLINES,
    recursive=True,
)
def saved_merged_regions(t: Tables) -> DataFrame:
    """Merged regions after saving and reading the table, and exporting and reading documents."""
    root = scratch_path(t.spark, "merged")
    before = durable(region_table(t))
    after = durable(rn.merged_regions(before, rn.merge_regions(before)))
    points = rn.explode_region_points(after, ["slide_name"])
    rows = after.select("id", "slide_name", "biomarker", F.lit("region").alias("type"))
    tb.save_annotations(rows, points, rows.select("slide_name"), root, F.current_timestamp())
    read = tb.read_annotations(t.spark, root)
    regions = rn.assemble_regions(read["region_points"]).join(read["annotations"].select("id", "slide_name", "biomarker"), "id")
    ex.export_regions_json(regions, f"{root}/documents")
    drawn = durable(fl.read_regions_json(t.spark, f"{root}/documents"))
    pixels = rn.pixel_count(rn.rasterize(rn.region_edge_rows(drawn, ["id"]), ["id"]), ["id"])
    return drawn.select("slide_name", "biomarker", "id").join(pixels, "id", "left")


def _covered(x1: str, y1: str, x2: str, y2: str, also: str = "") -> str:
    """Pixels of run r inside a rectangle, as SQL; 0 without one."""
    return (
        f"coalesce(CASE WHEN {also}r.yy >= ceil({y1} - 0.5) AND r.yy <= ceil({y2} - 0.5) - 1 "
        f"THEN greatest(0, least(r.x1, ceil({x2} - 0.5) - 1) - greatest(r.x0, ceil({x1} - 0.5)) + 1) ELSE 0 END, 0)"
    )


LOOP = {
    **RUNS,
    "loop": """SELECT 'a' AS lid, slide_name, biomarker, MIN(x) AS x1, MIN(y) AS y1, MIN(x) + 700 AS x2, MIN(y) + 900 AS y2 FROM {fovs} GROUP BY slide_name, biomarker
 UNION ALL SELECT 'b', slide_name, biomarker, MIN(x) + 350, MIN(y) + 450, MIN(x) + 1050, MIN(y) + 1350 FROM {fovs} GROUP BY slide_name, biomarker""",
    "hit": """SELECT b.id, l.lid, l.x1, l.y1, l.x2, l.y2 FROM {bb} b JOIN {loop} l ON l.slide_name = b.slide_name AND l.biomarker = b.biomarker WHERE
 EXISTS (SELECT 1 FROM {edge} e WHERE e.id = b.id AND greatest(e.x1,e.x2) >= l.x1 AND least(e.x1,e.x2) <= l.x2 AND greatest(e.y1,e.y2) >= l.y1 AND least(e.y1,e.y2) <= l.y2
   AND NOT (least(e.x1,e.x2) > l.x1 AND greatest(e.x1,e.x2) < l.x2 AND least(e.y1,e.y2) > l.y1 AND greatest(e.y1,e.y2) < l.y2)
   AND least((e.x2-e.x1)*(l.y1-e.y1)-(e.y2-e.y1)*(l.x1-e.x1), (e.x2-e.x1)*(l.y1-e.y1)-(e.y2-e.y1)*(l.x2-e.x1), (e.x2-e.x1)*(l.y2-e.y1)-(e.y2-e.y1)*(l.x1-e.x1), (e.x2-e.x1)*(l.y2-e.y1)-(e.y2-e.y1)*(l.x2-e.x1)) <= 0
   AND greatest((e.x2-e.x1)*(l.y1-e.y1)-(e.y2-e.y1)*(l.x1-e.x1), (e.x2-e.x1)*(l.y1-e.y1)-(e.y2-e.y1)*(l.x2-e.x1), (e.x2-e.x1)*(l.y2-e.y1)-(e.y2-e.y1)*(l.x1-e.x1), (e.x2-e.x1)*(l.y2-e.y1)-(e.y2-e.y1)*(l.x2-e.x1)) >= 0)
 OR EXISTS (SELECT 1 FROM {edge} e WHERE e.id = b.id AND e.seq = 0 AND e.x1 BETWEEN l.x1 AND l.x2 AND e.y1 BETWEEN l.y1 AND l.y2)
 OR (SELECT COUNT(*) FROM {edge} e WHERE e.id = b.id AND (e.y1 > l.y1) <> (e.y2 > l.y1) AND l.x1 < (e.x2-e.x1)*(l.y1-e.y1)/(e.y2-e.y1)+e.x1) % 2 = 1""",
    "cut_runs": f"""SELECT r.id, r.yy, r.x1 - r.x0 + 1 AS n, {_covered("h.x1", "h.y1", "h.x2", "h.y2")} AS ca, {_covered("k.x1", "k.y1", "k.x2", "k.y2")} AS cb,
  {_covered("greatest(h.x1, k.x1)", "greatest(h.y1, k.y1)", "least(h.x2, k.x2)", "least(h.y2, k.y2)", "h.x1 IS NOT NULL AND k.x1 IS NOT NULL AND ")} AS cab
 FROM {{slide_runs}} r LEFT JOIN {{hit}} h ON h.id = r.id AND h.lid = 'a' LEFT JOIN {{hit}} k ON k.id = r.id AND k.lid = 'b' WHERE h.id IS NOT NULL OR k.id IS NOT NULL""",
    "cut": "SELECT id, SUM(n) AS before, SUM(n - ca) AS a, SUM(n - cb) AS b, SUM(n - ca - cb + cab) AS ab FROM {cut_runs} GROUP BY id",
    # Where both loops erase a region, the first one that leaves something counts alone.
    "remaining": "SELECT id, before, CASE WHEN ab > 0 THEN ab WHEN a > 0 AND a < before THEN a WHEN b > 0 AND b < before THEN b END AS after FROM {cut}",
}


def loops(t: Tables) -> DataFrame:
    """Two overlapping rectangles per slide and channel."""
    box = t.fovs.groupBy("slide_name", "biomarker").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    x, y = F.col("x"), F.col("y")
    rings = {"a": rg.rect_ring(x, y, x + 700, y + 900), "b": rg.rect_ring(x + 350, y + 450, x + 1050, y + 1350)}
    a, b = [box.select("slide_name", "biomarker", F.lit(k).alias("id"), F.array(v).alias("rings")) for k, v in rings.items()]
    return a.unionByName(b)


@query("subtract_region", "SELECT id, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM {remaining} WHERE after > 0", LOOP)
def subtract_region(t: Tables) -> DataFrame:
    return rn.subtract_loops(region_table(t), loops(t))["counts"]


@query(
    "cut_region_rows",
    """SELECT id, CAST(yy AS INT) AS row, CAST(SUM(n - CASE how WHEN 'ab' THEN ca + cb - cab WHEN 'a' THEN ca ELSE cb END) AS BIGINT) AS pixels FROM {cut_runs} r
 JOIN (SELECT id, CASE WHEN ab > 0 THEN 'ab' WHEN a > 0 AND a < before THEN 'a' WHEN b > 0 AND b < before THEN 'b' END AS how FROM {cut}) c USING (id)
 WHERE how IS NOT NULL GROUP BY id, yy HAVING SUM(n - CASE how WHEN 'ab' THEN ca + cb - cab WHEN 'a' THEN ca ELSE cb END) > 0""",
    LOOP,
)
def cut_region_rows(t: Tables) -> DataFrame:
    """Pixels per row inside the rings of the regions that loops have cut."""
    before = region_table(t)
    cut = rn.subtract_loops(before, loops(t))
    after = rn.cut_regions(before, cut).join(cut["counts"].select("id"), "id", "left_semi")
    return rn.pixel_count(rn.rasterize(rn.region_edge_rows(after, ["id"]), ["id"]), ["id", "row"])


@query(
    "select_regions_in_rect",
    LOOP["hit"].replace("SELECT b.id, l.lid, l.x1, l.y1, l.x2, l.y2 FROM {bb} b JOIN {loop} l ON l.slide_name = b.slide_name AND l.biomarker = b.biomarker", "SELECT b.id FROM {bb} b JOIN (SELECT 500.0::DOUBLE AS x1, 600.0::DOUBLE AS y1, 900.0::DOUBLE AS x2, 1400.0::DOUBLE AS y2) l ON true"),
    GEO,
)
def select_regions_in_rect(t: Tables) -> DataFrame:
    return rn.select_regions_in_rect(region_table(t), 500, 600, 400, 800).select("id")


@query(
    "hit_test",
    """SELECT slide_name, point_id, id FROM (SELECT *, row_number() OVER (PARTITION BY slide_name, point_id ORDER BY z DESC, d2, id_rank) AS rn FROM (
  SELECT f.slide_name, f.id AS point_id, m.id, 10 AS z, (m.x-f.x)*(m.x-f.x) + (m.y-f.y)*(m.y-f.y) AS d2, row_number() OVER (ORDER BY m.id) AS id_rank FROM {fovs} f JOIN {markers} m ON m.slide_name = f.slide_name AND (m.x-f.x)*(m.x-f.x) + (m.y-f.y)*(m.y-f.y) <= 2500
  UNION ALL SELECT f.slide_name, f.id, e.id, 9, 0, -row_number() OVER (ORDER BY e.id) FROM {fovs} f JOIN {edge} e ON e.slide_name = f.slide_name AND (e.y1 > f.y) <> (e.y2 > f.y) AND f.x < (e.x2-e.x1)*(f.y-e.y1)/(e.y2-e.y1)+e.x1 GROUP BY f.slide_name, f.id, e.id HAVING COUNT(*) % 2 = 1
  UNION ALL SELECT f.slide_name, f.id, g.id, 8, 0, -row_number() OVER (ORDER BY g.id) FROM {fovs} f JOIN {fovs} g ON g.slide_name = f.slide_name AND f.x BETWEEN g.x AND g.x + g.w AND f.y BETWEEN g.y AND g.y + g.h) q) r WHERE rn = 1""",
    GEO,
)
def hit_test(t: Tables) -> DataFrame:
    points = t.fovs.select("slide_name", F.col("id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    return rn.hit_test(points, t.markers, region_table(t), t.fovs, 50.0)


@query(
    "export_regions_json",
    "SELECT slide_name, id, biomarker AS channel, CAST(8 AS INT) AS n_points, CAST(CASE WHEN has_hole THEN 1 ELSE 0 END AS INT) AS n_holes FROM {regions}",
)
def export_regions_json(t: Tables) -> DataFrame:
    docs = ex.regions_json(region_table(t)).select("slide_name", "id", F.from_json("js", fl.REGION_JSON).alias("d"))
    return docs.select("slide_name", "id", "d.channel", F.size("d.points").alias("n_points"), F.size("d.holes").alias("n_holes"))


@query(
    "read_regions_json",
    "SELECT r.id, r.biomarker, COUNT(*) AS n_points, SUM(px) AS sum_x, SUM(py) AS sum_y FROM {regions} r JOIN {region_points} p ON p.annotation_id = r.id GROUP BY r.id, r.biomarker",
)
def read_regions_json(t: Tables) -> DataFrame:
    docs = ex.regions_json(region_table(t)).select(F.from_json("js", fl.REGION_JSON).alias("d")).select("d.*")
    points = fl.regions_from_json(docs).select("id", "biomarker", F.explode(F.flatten("rings")).alias("p"))
    return points.groupBy("id", "biomarker").agg(F.count("*").alias("n_points"), F.sum("p.x").alias("sum_x"), F.sum("p.y").alias("sum_y"))
