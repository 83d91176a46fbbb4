"""Annotation tables derived from the given parquet tables.

The inputs hold no annotations, so each annotation table is a fixed rule over whole
input tables. A rule is one SQL text in the dialect Spark and DuckDB share; ``{name}``
refers to an input table or to another derived table. The few rules that explode an
array have a text per engine.

Coordinates are multiples of 1/8, so sums and comparisons are exact in DOUBLE.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_BIOMARKER = "CASE {0} % 5 WHEN 0 THEN 'CD8' WHEN 1 THEN 'CD68' WHEN 2 THEN 'FOXP3' WHEN 3 THEN 'PanCK' ELSE '' END"

RULES: dict[str, str] = {}
SPARK_RULES: dict[str, str] = {}

RULES["slides"] = """
SELECT 'slide_' || CAST(s_suppkey AS STRING) AS slide_name,
 '/data/' || CASE s_suppkey % 4 WHEN 0 THEN 'test/' WHEN 1 THEN 'Train/' WHEN 2 THEN 'train/test/' ELSE 'misc/' END
 || 'slide_' || CAST(s_suppkey AS STRING)
 || CASE s_suppkey % 7 WHEN 0 THEN '_mask.ome.tif' WHEN 1 THEN '.czi' WHEN 2 THEN '.ims' WHEN 3 THEN '.svs' ELSE '.OME.TIFF' END AS slide_path
FROM {supplier}"""

RULES["markers"] = f"""
SELECT 'm_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) || '_' || CAST(l_suppkey AS STRING) AS id,
 'slide_' || CAST(l_suppkey AS STRING) AS slide_name,
 {_BIOMARKER.format('l_partkey')} AS biomarker,
 CAST((l_orderkey*7919 + l_partkey*613 + l_linenumber*104729) % 32768 AS DOUBLE)/8.0 AS x,
 CAST((l_orderkey*6101 + l_partkey*2741 + l_linenumber*7577) % 32768 AS DOUBLE)/8.0 AS y,
 CAST(10 + l_linenumber AS DOUBLE) AS w, CAST(10 + l_linenumber AS DOUBLE) AS h,
 MAX(l_shipdate) AS created_at
FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey"""

# One field of view per ordering customer, placed by the first and last order.
RULES["fovs"] = f"""
SELECT 'f_' || CAST(o_custkey AS STRING) AS id,
 'slide_' || CAST(o_custkey % n AS STRING) AS slide_name,
 {_BIOMARKER.format('CAST(floor(o_custkey / n) AS BIGINT)')} AS biomarker,
 CAST((first_key*7919 + last_key*31) % 28672 AS DOUBLE)/8.0 AS x,
 CAST((first_key*6101 + last_key*17) % 28672 AS DOUBLE)/8.0 AS y,
 CAST(512 AS DOUBLE) AS w, CAST(512 AS DOUBLE) AS h, created_at
FROM (SELECT o_custkey, MIN(o_orderkey) AS first_key, MAX(o_orderkey) AS last_key,
  MIN(o_orderdate) AS created_at, (SELECT COUNT(*) FROM {{supplier}}) AS n
 FROM {{orders}} GROUP BY o_custkey) q"""

RULES["regions"] = """
SELECT 'r_' || CAST(c_custkey AS STRING) AS id, 'slide_' || CAST(c_custkey % n AS STRING) AS slide_name,
 CASE k % 3 WHEN 0 THEN 'CD8' WHEN 1 THEN 'CD68' ELSE 'PanCK' END AS biomarker,
 CAST(300 + (k*331 + c_nationkey*97) % 1500 AS DOUBLE) AS cx, CAST(300 + (k*577 + c_nationkey*41) % 1500 AS DOUBLE) AS cy,
 CAST(60 + c_custkey % 200 AS DOUBLE) AS rad, c_custkey % 3 = 0 AS has_hole
FROM (SELECT c_custkey, c_nationkey, n, CAST(floor(c_custkey / n) AS BIGINT) AS k
 FROM (SELECT c_custkey, c_nationkey, (SELECT COUNT(*) FROM {supplier}) AS n FROM {customer}) s) q"""

# Unit octagon (ring 0) and square hole (ring 1): ring, k, ux, uy.
_UNIT_POINTS = (
    "(0,0,1.00,-0.50),(0,1,1.00,0.50),(0,2,0.50,1.00),(0,3,-0.50,1.00),"
    "(0,4,-1.00,0.50),(0,5,-1.00,-0.50),(0,6,-0.50,-1.00),(0,7,0.50,-1.00),"
    "(1,0,-0.25,-0.25),(1,1,0.25,-0.25),(1,2,0.25,0.25),(1,3,-0.25,0.25)"
)
_POINT_COLUMNS = (
    "SELECT r.id AS annotation_id, CAST(v.ring*8 + v.k AS INT) AS seq, r.cx + r.rad*CAST(v.ux AS DOUBLE) AS px, "
    "r.cy + r.rad*CAST(v.uy AS DOUBLE) AS py, CAST(v.ring AS INT) AS ring"
)
RULES["region_points"] = (
    _POINT_COLUMNS
    + f" FROM {{regions}} r CROSS JOIN (VALUES {_UNIT_POINTS}) AS v(ring,k,ux,uy) WHERE v.ring = 0 OR r.has_hole"
)
SPARK_RULES["region_points"] = (
    _POINT_COLUMNS
    + " FROM {regions} r LATERAL VIEW inline(array("
    + ",".join(f"struct{p}" for p in re.findall(r"\([^)]*\)", _UNIT_POINTS))
    + ")) v AS ring, k, ux, uy WHERE v.ring = 0 OR r.has_hole"
)

RULES["annotations"] = """
SELECT id, 'cell_marker' AS type, created_at, slide_name, biomarker, x, y, w, h FROM {markers}
UNION ALL SELECT id, 'fov' AS type, created_at, slide_name, biomarker, x, y, w, h FROM {fovs}
UNION ALL SELECT id, 'region' AS type, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at, slide_name, biomarker,
 CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS h FROM {regions}"""

SPARK_RULES["annotations"] = RULES["annotations"].replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")

# Displaced, partly missing detections: cells of width 17 are never detected, cells of
# width 13 only beside their place.
RULES["preds"] = """
SELECT id AS gt_id, slide_name, biomarker, cx, cy, cx - w/2 AS x1, cy - h/2 AS y1, cx + w/2 AS x2, cy + h/2 AS y2,
 CAST(CAST(cx*8 + cy*8 + 8000 AS BIGINT) % 1000 AS DOUBLE)/1000.0 AS score FROM (
 SELECT id, slide_name, biomarker, w, h, x + CAST(CAST(x*8 AS BIGINT) % 9 - 4 AS DOUBLE) + CASE WHEN w = 13 THEN 12 ELSE 0 END AS cx,
  y + CAST(CAST(y*8 AS BIGINT) % 7 - 3 AS DOUBLE) AS cy FROM {markers}) q WHERE w < 17"""

# Image files on disk: FOXP3 was never exported, names truncate, some are stale.
RULES["fov_files"] = """
SELECT slide_name, slide_name || '_' || biomarker || '_' || CAST(CAST(floor(x) AS BIGINT) + CASE WHEN o % 5 = 0 THEN 1 ELSE 0 END AS STRING)
 || '_' || CAST(CAST(floor(y) AS BIGINT) AS STRING) || '.png' AS file_name
FROM (SELECT slide_name, biomarker, x, y, CAST(substr(id,3) AS BIGINT) AS o FROM {fovs}) q WHERE biomarker <> 'FOXP3'"""

RULES["eval_models"] = """
SELECT n_nationkey AS id, lower(n_name) AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'segmentation' ELSE 'detection' END AS model_type FROM {nation}"""

RULES["evaluations"] = """
SELECT o_orderkey AS id, o_custkey % 25 AS model_id, o_orderdate AS created_at,
 CASE WHEN (o_custkey % 25) % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS iou_threshold FROM {orders}"""

RULES["evaluation_counts"] = f"""
SELECT evaluation_id, marker, tp, fp, fn, n_fovs FROM (
 SELECT e.id AS evaluation_id, {_BIOMARKER.format('l.l_linenumber')} AS marker,
  CAST(SUM(l.l_quantity) AS BIGINT) AS tp, CAST(SUM(l.l_linenumber) AS BIGINT) AS fp, CAST(COUNT(*) AS BIGINT) AS fn, CAST(COUNT(*) AS BIGINT) AS n_fovs
 FROM {{evaluations}} e JOIN {{lineitem}} l ON l.l_orderkey = e.id
 GROUP BY e.id, {_BIOMARKER.format('l.l_linenumber')}) q"""

RULES["edit_log"] = """
SELECT slide_name, seq, op, CASE WHEN op='add' THEN 'e_' || CAST(seq AS STRING) WHEN op IN ('move','delete') THEN 'e_' || CAST(prev AS STRING) END AS ann_id,
 CASE WHEN op IN ('add','move') THEN v END AS x, CASE WHEN op IN ('add','move') THEN v*2 END AS y, ts FROM (
 SELECT slide_name, seq, ts, v, op, MAX(CASE WHEN op='add' THEN seq END) OVER (PARTITION BY slide_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
  SELECT 'slide_' || CAST(user_id AS STRING) AS slide_name, event_id AS seq, ts, value AS v,
   CASE event_type WHEN 'signup' THEN 'add' WHEN 'click' THEN 'add' WHEN 'view' THEN 'move' WHEN 'error' THEN 'undo'
   ELSE CASE event_id % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'redo' ELSE 'add' END END AS op FROM {events}) q) w"""

RULES["emb_long"] = (
    "SELECT vec_id, CAST(generate_subscripts(embedding,1)-1 AS INT) AS i, unnest(embedding) AS e FROM {embeddings}"
)
SPARK_RULES["emb_long"] = (
    "SELECT vec_id, CAST(p.i AS INT) AS i, p.e FROM {embeddings} LATERAL VIEW posexplode(embedding) p AS i, e"
)

RULES["pixels"] = """
SELECT 'slide_' || CAST(vec_id % 10 AS STRING) AS slide_name,
 CASE CAST(floor(vec_id/10) AS BIGINT) % 4 WHEN 0 THEN 'DAPI' WHEN 1 THEN 'CD8' WHEN 2 THEN 'CD68' ELSE 'PanCK' END AS channel,
 CAST(floor(CAST(floor(vec_id/40) AS BIGINT) / 4) AS INT) AS tile_y, CAST(CAST(floor(vec_id/40) AS BIGINT) % 4 AS INT) AS tile_x,
 CAST(i AS INT) AS i, CAST(floor((CAST(e AS DOUBLE)+1)*20000) AS INT) AS v FROM {emb_long}"""

RULES["mask_pixels"] = """
SELECT slide_name, channel, tile_y, tile_x, i, v > 20200 AS gt, v > 20000 AND i % 5 <> 0 AS pred FROM {pixels}"""

RULES["tiles"] = """
SELECT slide_name, channel, CAST(0 AS INT) AS level, tile_y, tile_x, CAST(8 AS INT) AS h, CAST(8 AS INT) AS w, list(v ORDER BY i) AS px
FROM {pixels} GROUP BY slide_name, channel, tile_y, tile_x"""
SPARK_RULES["tiles"] = """
SELECT slide_name, channel, CAST(0 AS INT) AS level, tile_y, tile_x, CAST(8 AS INT) AS h, CAST(8 AS INT) AS w,
 transform(sort_array(collect_list(struct(i, v))), p -> p.v) AS px
FROM {pixels} GROUP BY slide_name, channel, tile_y, tile_x"""

# Four channels per slide; the second slide in three lost its name for channel 3.
_CHANNEL_COLUMNS = (
    "SELECT 'slide_' || CAST(s.s_suppkey AS STRING) AS slide_name, CAST(v.idx AS INT) AS idx, "
    "CASE WHEN s.s_suppkey % 3 = 1 AND v.idx = 3 THEN ' ' ELSE v.raw_name END AS raw_name"
)
_CHANNEL_NAMES = "(0,'DAPI'),(1,'CD8'),(2,'CD68'),(3,'PanCK')"
RULES["raw_channels"] = _CHANNEL_COLUMNS + f" FROM {{supplier}} s CROSS JOIN (VALUES {_CHANNEL_NAMES}) AS v(idx, raw_name)"
SPARK_RULES["raw_channels"] = (
    _CHANNEL_COLUMNS
    + " FROM {supplier} s LATERAL VIEW inline(array("
    + ",".join(f"struct{p}" for p in re.findall(r"\([^)]*\)", _CHANNEL_NAMES))
    + ")) v AS idx, raw_name"
)
RULES["channels"] = """
SELECT slide_name, idx, CASE WHEN trim(raw_name) = '' THEN 'Ch' || CAST(idx AS STRING) ELSE trim(raw_name) END AS name FROM {raw_channels}"""

# Colors and ranges of the channels that the pixel table holds.
RULES["channel_settings"] = """
SELECT slide_name, name, idx, idx <> 2 OR CAST(substr(slide_name, 7) AS BIGINT) % 2 = 0 AS visible,
 CAST(CASE idx WHEN 1 THEN 0 ELSE 64*idx END AS INT) AS r, CAST(CASE idx WHEN 0 THEN 102 ELSE 255 END AS INT) AS g, CAST(CASE idx WHEN 0 THEN 255 ELSE 32 END AS INT) AS b,
 CAST(15000 + 500*idx AS DOUBLE) AS min_val, CAST(25000 + 1000*idx AS DOUBLE) AS max_val
FROM {channels}"""

RULES["view_settings"] = """
SELECT 'slide_' || CAST(s_suppkey AS STRING) AS slide_name, CASE WHEN s_suppkey % 5 = 4 THEN 'not json'
 ELSE '{{"channels": [{{"name": "DAPI", "visible": ' || CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "min": ' || CAST(s_suppkey AS STRING)
 || ', "max": 30000}}, {{"name": "CD8", "visible": true, "min": 100}}]}}' END AS js FROM {supplier}"""

# A pyramid per slide: width and height from the supplier row.
RULES["slide_dims"] = """
SELECT 'slide_' || CAST(s_suppkey AS STRING) AS slide_name, CAST(20000 + (s_suppkey*7919) % 30000 AS INT) AS width,
 CAST(15000 + (s_suppkey*6101) % 20000 AS INT) AS height, CAST(2 + s_suppkey % 3 AS INT) AS factor, CAST(1 + s_suppkey % 6 AS INT) AS n_levels FROM {supplier}"""
_LEVEL_COLUMNS = """
SELECT slide_name, CAST(lv AS INT) AS level, CAST(power(factor, lv) AS DOUBLE) AS factor,
 CAST(greatest(1, floor(width / power(factor, lv))) AS INT) AS width, CAST(greatest(1, floor(height / power(factor, lv))) AS INT) AS height
FROM """
RULES["levels"] = _LEVEL_COLUMNS + "(SELECT *, unnest(generate_series(0, n_levels - 1)) AS lv FROM {slide_dims}) d"
SPARK_RULES["levels"] = _LEVEL_COLUMNS + "{slide_dims} LATERAL VIEW explode(sequence(0, n_levels - 1)) t AS lv"

# Every embedding holds two polygons of 32 rays; the score is its largest ray value.
RULES["star_rays"] = """
SELECT vec_id*2 + CAST(floor(i/32) AS BIGINT) AS id, 'f_' || CAST(vec_id % 15 AS STRING) AS fov_id,
 CAST((vec_id*37 + CAST(floor(i/32) AS BIGINT)*11) % 480 AS DOUBLE) + 16 AS cy, CAST((vec_id*53) % 480 AS DOUBLE) + 16 AS cx,
 CAST(i % 32 AS INT) AS ray, 6 + 20*abs(CAST(e AS DOUBLE)) AS dist FROM {emb_long}"""
RULES["star_scores"] = """
SELECT vec_id*2 + CAST(floor(i/32) AS BIGINT) AS id, MAX(abs(CAST(e AS DOUBLE))) AS prob FROM {emb_long} GROUP BY vec_id*2 + CAST(floor(i/32) AS BIGINT)"""
RULES["star_polygons"] = """
SELECT r.id, r.fov_id, r.cy, r.cx, s.prob, list(r.dist ORDER BY r.ray) AS dist
FROM {star_rays} r JOIN {star_scores} s ON s.id = r.id GROUP BY r.id, r.fov_id, r.cy, r.cx, s.prob"""
SPARK_RULES["star_polygons"] = """
SELECT r.id, r.fov_id, r.cy, r.cx, s.prob, transform(sort_array(collect_list(struct(r.ray, r.dist))), p -> p.dist) AS dist
FROM {star_rays} r JOIN {star_scores} s ON s.id = r.id GROUP BY r.id, r.fov_id, r.cy, r.cx, s.prob"""

# Eight values of an embedding make one undecoded detector query.
_Q = "MAX(CASE WHEN i % 8 = {0} THEN {1} END) AS {2}"
RULES["raw_queries"] = (
    "SELECT vec_id, CAST(floor(i/8) AS INT) AS query, "
    + ", ".join(
        _Q.format(k, e, n)
        for k, e, n in [
            (0, "CAST(e AS DOUBLE)+0.5", "cx"),
            (1, "CAST(e AS DOUBLE)+0.5", "cy"),
            (2, "abs(CAST(e AS DOUBLE))", "w"),
            (3, "abs(CAST(e AS DOUBLE))", "h"),
            (4, "CAST(e AS DOUBLE)*10", "logit0"),
            (5, "CAST(e AS DOUBLE)*10", "logit1"),
            (6, "CAST(e AS DOUBLE)*10", "logit2"),
            (7, "CAST(e AS DOUBLE)*10", "logit3"),
        ]
    )
    + " FROM {emb_long} GROUP BY vec_id, CAST(floor(i/8) AS INT)"
)

RULES["ome_xml"] = """
SELECT p_partkey, '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06">' || CASE p_size % 2 WHEN 0 THEN '<Instrument><Objective NominalMagnification="' || CAST(p_size AS STRING) || '"/></Instrument>' ELSE '' END
 || '<Image><Pixels SizeC="' || CAST(p_size % 4 + 1 AS STRING) || '" PhysicalSizeX="' || CAST(p_size AS STRING) || '.5"'
 || CASE p_size % 3 WHEN 0 THEN ' PhysicalSizeXUnit="nm"' WHEN 1 THEN ' PhysicalSizeXUnit="mm"' ELSE '' END
 || '><Channel Name="' || p_brand || '"/><Channel/></Pixels></Image></OME>' AS xml FROM {part}"""

RULES["slide_count"] = "SELECT COUNT(*) AS n FROM {supplier}"


def _refs(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)) if n]


class Tables:
    """Lazy access to input and derived tables as DataFrames: ``t.markers``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in RULES:
                text = SPARK_RULES.get(name, RULES[name])
                df = self.spark.sql(text, **{n: getattr(self, n) for n in _refs(text)})
            else:
                raise AttributeError(name)
            self._known[name] = df
        return self._known[name]


def with_chain(sql: str, extra: dict[str, str] | None = None) -> str:
    """Complete oracle SQL: ``sql`` preceded by the derived tables it names.

    ``extra`` maps further common table expressions, usable in ``sql`` as ``{name}``.
    """
    extra = extra or {}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _refs(text):
            if name in BASE or name in order:
                continue
            visit(extra.get(name) or RULES[name])
            if name not in order:
                order.append(name)

    def fill(text: str) -> str:
        return text.format(**{n: n for n in _refs(text)}).strip()

    visit(sql)
    parts = [f"{n} AS (\n{fill(extra.get(n) or RULES[n])}\n)" for n in order]
    body = fill(sql)
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
