"""Queries on slides, groups, channels, levels and view settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.operators import annotations as an
from lamella.operators import catalog as ct
from lamella.plans.registry import query
from lamella.session import numbered
from lamella.sources.derived import Tables

SLIDE_SQL = {
    "files": r"""SELECT slide_path AS path, regexp_extract(slide_path, '([^/]*)$', 1) AS name, regexp_replace(regexp_extract(slide_path, '([^/]*)$', 1), '\.[^.]+$', '') AS stem,
 CASE WHEN slide_path LIKE '/data/test/%' THEN 'test' ELSE 'train' END AS slide_group FROM {slides}""",
    "ok_files": "SELECT * FROM {files} WHERE lower(name) NOT LIKE '%mask%' AND (lower(name) LIKE '%.ome.tif' OR lower(name) LIKE '%.ome.tiff' OR lower(name) LIKE '%.ims' OR lower(name) LIKE '%.czi')",
    "cat": "SELECT stem AS slide_name, MAX(path) AS slide_path, arg_max(slide_group, path) AS slide_group FROM {ok_files} GROUP BY stem",
    "cnt": "SELECT slide_name, COUNT(*) FILTER (type = 'cell_marker') AS cell_marker, COUNT(*) FILTER (type = 'region') AS region, COUNT(*) FILTER (type = 'fov') AS fov FROM {annotations} GROUP BY slide_name",
}


def listing(t: Tables) -> DataFrame:
    return t.slides.select(F.col("slide_path").alias("path"))


def catalog_of(t: Tables) -> DataFrame:
    return ct.slide_catalog(listing(t), "/data")


@query("slide_catalog", "SELECT slide_name, slide_path, slide_group FROM {cat}", SLIDE_SQL)
def slide_catalog(t: Tables) -> DataFrame:
    return catalog_of(t)


@query("classify_group", "SELECT path, slide_group FROM {files}", SLIDE_SQL)
def classify_group(t: Tables) -> DataFrame:
    return listing(t).withColumn("slide_group", nm.classify_group(F.col("path"), "/data/"))


@query("is_slide_file", "SELECT path, path IN (SELECT path FROM {ok_files}) AS is_slide FROM {files}", SLIDE_SQL)
def is_slide_file(t: Tables) -> DataFrame:
    return listing(t).withColumn("is_slide", nm.is_slide_file(nm.base_name(F.col("path"))))


@query(
    "slide_format",
    "SELECT path, CASE WHEN lower(path) LIKE '%.czi' THEN 'czi' WHEN lower(path) LIKE '%.ims' THEN 'ims' WHEN lower(path) LIKE '%.svs' OR lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff' THEN 'tiff' END AS family FROM {files}",
    SLIDE_SQL,
)
def slide_format(t: Tables) -> DataFrame:
    return listing(t).withColumn("family", nm.slide_format(F.col("path")))


@query(
    "refresh_locations",
    """SELECT a.slide_name, CASE WHEN c.slide_path IS NULL THEN 'not_found' WHEN c.slide_path = a.slide_path THEN 'unchanged' ELSE 'updated' END AS status, COALESCE(c.slide_path, a.slide_path) AS slide_path
 FROM (SELECT slide_name, CASE WHEN slide_path LIKE '%.czi' THEN '/old/' || slide_name ELSE slide_path END AS slide_path FROM {slides}) a LEFT JOIN {cat} c ON c.slide_name = a.slide_name""",
    SLIDE_SQL,
)
def refresh_locations(t: Tables) -> DataFrame:
    moved = F.when(F.endswith("slide_path", F.lit(".czi")), F.concat(F.lit("/old/"), "slide_name")).otherwise(F.col("slide_path"))
    recorded = an.slide_paths_of_annotated(t.annotations, t.slides.withColumn("slide_path", moved))
    return ct.refresh_locations(recorded, catalog_of(t))


@query(
    "image_list",
    """SELECT f.name AS file_name, f.path AS slide_path, f.stem AS slide_name, f.slide_group, COALESCE(c.cell_marker, 0) AS cell_marker, COALESCE(c.region, 0) AS region, COALESCE(c.fov, 0) AS fov
 FROM {ok_files} f LEFT JOIN {cnt} c ON c.slide_name = f.stem""",
    SLIDE_SQL,
)
def image_list(t: Tables) -> DataFrame:
    return ct.image_list(listing(t), an.counts_by_slide(t.annotations), "/data")


@query("catalog_order", "SELECT name AS file_name, row_number() OVER (ORDER BY lower(name), path) AS pos FROM {ok_files}", SLIDE_SQL)
def catalog_order(t: Tables) -> DataFrame:
    rows = ct.image_list(listing(t), an.counts_by_slide(t.annotations), "/data").select("file_name", "slide_path")
    return numbered(rows, [F.lower("file_name").asc(), F.col("slide_path").asc()], (), "pos").drop("slide_path")


@query(
    "marker_groups",
    "SELECT biomarker, string_agg(DISTINCT COALESCE(c.slide_group, 'train'), ',' ORDER BY COALESCE(c.slide_group, 'train')) AS groups FROM {markers} m LEFT JOIN {cat} c ON c.slide_name = m.slide_name WHERE biomarker <> '' GROUP BY biomarker",
    SLIDE_SQL,
)
def marker_groups(t: Tables) -> DataFrame:
    by_slide = an.channels_by_slide(t.annotations, "cell_marker")
    return ct.marker_groups(by_slide, catalog_of(t)).withColumn("groups", nm.csv_join(F.col("groups")))


@query(
    "review_fovs",
    "SELECT f.slide_name, f.biomarker AS channel, f.id FROM {fovs} f LEFT JOIN {cat} c ON c.slide_name = f.slide_name WHERE f.biomarker IN ('CD8', 'FOXP3') AND COALESCE(c.slide_group, 'train') = 'train'",
    SLIDE_SQL,
)
def review_fovs(t: Tables) -> DataFrame:
    entries = t.fovs.select("slide_name", F.col("biomarker").alias("channel"), "id")
    return ct.review_fovs(entries, catalog_of(t), ["CD8", "FOXP3"], ["train"])


@query(
    "ome_metadata",
    """SELECT p_partkey, CAST(p_size % 4 + 1 AS INT) AS num_channels, round((p_size + 0.5) * CASE p_size % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 1000.0 ELSE 1.0 END::DOUBLE, 6) AS pixel_size_x,
 CAST(0 AS DOUBLE) AS pixel_size_y, p_brand || '|' AS channel_names, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END AS DOUBLE) AS magnification FROM {part}""",
)
def ome_metadata(t: Tables) -> DataFrame:
    out = ct.ome_metadata(t.ome_xml, "xml").drop("xml")
    return out.withColumns({"channel_names": F.array_join("channel_names", "|"), "pixel_size_x": F.round("pixel_size_x", 6)})


@query(
    "to_microns",
    "SELECT p_partkey, round(p_retailprice * CASE p_size % 7 WHEN 0 THEN 1e6 WHEN 1 THEN 1e4 WHEN 2 THEN 1e3 WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 WHEN 5 THEN 1e-3 ELSE 1.0 END, 6) AS um FROM {part}",
)
def to_microns(t: Tables) -> DataFrame:
    units = F.array(*[F.lit(u) for u in ("m", "cm", "mm", "µm", "um", "nm", "px")])
    unit = F.element_at(units, F.col("p_size") % 7 + 1)
    return t.part.select("p_partkey", F.round(nm.to_microns(F.col("p_retailprice"), unit), 6).alias("um"))


@query("channel_label", "SELECT slide_name, idx, CASE WHEN trim(raw_name) = '' THEN 'Ch' || CAST(idx AS STRING) ELSE trim(raw_name) END AS label FROM {raw_channels}")
def channel_label(t: Tables) -> DataFrame:
    return t.raw_channels.select("slide_name", "idx", nm.channel_label(F.col("raw_name"), F.col("idx")).alias("label"))


@query(
    "channel_color",
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 0 WHEN 3 THEN 255 ELSE CASE p_partkey % 12 WHEN 0 THEN 0 WHEN 1 THEN 255 WHEN 2 THEN 0 WHEN 3 THEN 255 WHEN 4 THEN 200 WHEN 5 THEN 255 WHEN 6 THEN 0 WHEN 7 THEN 128 WHEN 8 THEN 255 WHEN 9 THEN 100 WHEN 10 THEN 0 ELSE 255 END END AS r,
 CASE p_size % 5 WHEN 0 THEN 102 WHEN 1 THEN 165 WHEN 2 THEN 220 WHEN 3 THEN 100 ELSE CASE p_partkey % 12 WHEN 0 THEN 255 WHEN 1 THEN 255 WHEN 2 THEN 200 WHEN 3 THEN 128 WHEN 4 THEN 0 WHEN 5 THEN 0 WHEN 6 THEN 255 WHEN 7 THEN 255 WHEN 8 THEN 200 WHEN 9 THEN 100 WHEN 10 THEN 128 ELSE 255 END END AS g FROM {part}""",
)
def channel_color(t: Tables) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("DAPI (nuclei)", "Cy-3", "Alexa 488", "PE", "CD8")])
    rows = t.part.select("p_partkey", F.element_at(names, F.col("p_size") % 5 + 1).alias("name"))
    rgb = nm.channel_color(F.col("name"), F.col("p_partkey"))
    return rows.select("p_partkey", rgb["r"].alias("r"), rgb["g"].alias("g"))


@query("nuclear_channel", "SELECT slide_name, MIN(CASE WHEN contains(lower(name), 'dapi') OR contains(lower(name), 'hoechst') THEN idx END) AS idx FROM {channels} GROUP BY slide_name")
def nuclear_channel(t: Tables) -> DataFrame:
    return ct.nuclear_channel(t.channels)


@query(
    "default_model",
    "SELECT p_brand, arg_min(p_name, (CASE WHEN p_size > 45 THEN 0 ELSE 1 END) * 10000000000 + p_partkey) AS name FROM {part} GROUP BY p_brand",
)
def default_model(t: Tables) -> DataFrame:
    return ct.first_flagged(t.part.withColumnRenamed("p_name", "name"), ["p_brand"], F.col("p_size") > 45, "p_partkey", "name")


VIEW_SQL = {
    "saved": """SELECT 'slide_' || CAST(s_suppkey AS STRING) AS slide_name, CAST(0 AS INT) AS pos, 'DAPI' AS name, s_suppkey % 2 = 0 AS visible, CAST(s_suppkey AS DOUBLE) AS min_val, CAST(30000 AS DOUBLE) AS max_val FROM {supplier} WHERE s_suppkey % 5 <> 4
 UNION ALL SELECT 'slide_' || CAST(s_suppkey AS STRING), CAST(1 AS INT), 'CD8', true, 100, NULL FROM {supplier} WHERE s_suppkey % 5 <> 4""",
}


@query("read_view_settings", "SELECT slide_name, pos, name, visible, min_val, max_val FROM {saved}", VIEW_SQL)
def read_view_settings(t: Tables) -> DataFrame:
    return ct.read_view_settings(t.view_settings, "js")


@query(
    "apply_view_settings",
    """SELECT c.slide_name, c.idx, c.name, COALESCE(s.visible, c.visible) AS visible, COALESCE(s.min_val, c.min_val) AS min_val, COALESCE(s.max_val, c.max_val) AS max_val, s.name IS NOT NULL AS applied
 FROM {channel_settings} c LEFT JOIN {saved} s ON s.slide_name = c.slide_name AND s.name = c.name""",
    VIEW_SQL,
)
def apply_view_settings(t: Tables) -> DataFrame:
    defaults = t.channel_settings.select("slide_name", "idx", "name", "visible", "min_val", "max_val")
    return ct.apply_view_settings(defaults, ct.read_view_settings(t.view_settings, "js"))


@query(
    "view_settings_json",
    """SELECT slide_name, '{{"channels":[' || string_agg('{{"name":"' || name || '","visible":' || CASE WHEN visible THEN 'true' ELSE 'false' END || ',"min":' || CAST(CAST(min_val AS INT) AS STRING) || '.0,"max":' || CAST(CAST(max_val AS INT) AS STRING) || '.0}}', ',' ORDER BY idx) || ']}}' AS js FROM {channel_settings} GROUP BY slide_name""",
)
def view_settings_json(t: Tables) -> DataFrame:
    return ct.view_settings_json(t.channel_settings)


@query("pyramid_levels", "SELECT slide_name, level, factor, width, height FROM {levels}")
def pyramid_levels(t: Tables) -> DataFrame:
    return ct.pyramid_levels(t.slide_dims)


REQ_SQL = {
    "req": """SELECT o_orderkey AS request_id, 'slide_' || CAST(o_custkey % (SELECT COUNT(*) FROM {supplier}) AS STRING) AS slide_name, CAST(1 + o_custkey % 50 AS DOUBLE)/100 AS zoom,
 CAST(o_orderkey % 4000 AS DOUBLE) * 2 AS lft, CAST(o_custkey % 3000 AS DOUBLE) AS top, CAST(o_orderkey % 4000 AS DOUBLE) * 2 + 1000.5 AS rgt, CAST(o_custkey % 3000 AS DOUBLE) + 700.25 AS bottom FROM {orders}""",
    "lvl": """SELECT r.request_id, r.slide_name, COALESCE(MAX(CASE WHEN l.factor <= greatest(1.0/greatest(r.zoom, 1e-6), 1.0) + 1e-6 THEN l.level END), 0) AS level FROM {req} r JOIN {levels} l ON l.slide_name = r.slide_name GROUP BY r.request_id, r.slide_name""",
}


def requests(t: Tables) -> DataFrame:
    sql = REQ_SQL["req"]
    return t.spark.sql(sql, supplier=t.supplier, orders=t.orders).withColumnsRenamed({"lft": "left", "rgt": "right"})


@query("best_level", "SELECT request_id, slide_name, level FROM {lvl}", REQ_SQL)
def best_level(t: Tables) -> DataFrame:
    r = requests(t).withColumn("downsample", F.greatest(F.lit(1.0) / F.col("zoom"), F.lit(1.0)))
    return ct.best_level(r, t.levels)


@query(
    "best_pow2_level",
    "SELECT slide_name, level, CAST(power(2, level) AS INT) AS level_factor FROM (SELECT slide_name, CAST(COALESCE(list_max(list_filter(generate_series(0, n_levels - 1), lambda k: power(2, k) <= width / 4000)), 0) AS INT) AS level FROM {slide_dims}) q",
)
def best_pow2_level(t: Tables) -> DataFrame:
    best = ct.best_pow2_level(F.col("width") / 4000, F.col("n_levels"))
    return t.slide_dims.select("slide_name", best["level"].alias("level"), best["level_factor"].alias("level_factor"))


TILE_SQL = {
    **REQ_SQL,
    "vt": """SELECT request_id, slide_name, level, factor, tile_y, unnest(generate_series(x0, x1)) AS tile_x FROM (
 SELECT *, unnest(generate_series(y0, y1)) AS tile_y FROM (
  SELECT r.request_id, r.slide_name, l.level, l.factor, greatest(0, CAST(trunc(r.lft/l.factor/512) AS BIGINT)) AS x0, greatest(0, CAST(trunc(r.top/l.factor/512) AS BIGINT)) AS y0,
   least(CAST(floor((l.width+511)/512) AS BIGINT), CAST(trunc(r.rgt/l.factor/512) AS BIGINT) + 1) AS x1, least(CAST(floor((l.height+511)/512) AS BIGINT), CAST(trunc(r.bottom/l.factor/512) AS BIGINT) + 1) AS y1
  FROM {req} r JOIN {lvl} v ON v.request_id = r.request_id JOIN {levels} l ON l.slide_name = r.slide_name AND l.level = v.level) a) b""",
}


@query("viewport_tiles", "SELECT request_id, slide_name, level, tile_y, tile_x FROM {vt}", TILE_SQL)
def viewport_tiles(t: Tables) -> DataFrame:
    return ct.viewport_tiles(requests(t), t.levels).drop("factor")


@query(
    "tile_scene_origin",
    "SELECT request_id, tile_y, tile_x, tile_x*512*factor AS scene_x, tile_y*512*factor AS scene_y FROM {vt}",
    TILE_SQL,
)
def tile_scene_origin(t: Tables) -> DataFrame:
    tiles = ct.viewport_tiles(requests(t), t.levels)
    at = ct.tile_scene_origin(*[F.col(c) for c in ("tile_y", "tile_x", "factor")])
    return tiles.select("request_id", "tile_y", "tile_x", *[c.alias(k) for k, c in at.items()])
