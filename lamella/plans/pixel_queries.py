"""Queries on pixel tiles and mask scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import catalog as ct
from lamella.operators import evaluation as ev
from lamella.operators import pixel_kernels as pk
from lamella.operators import pixels as px
from lamella.plans.flagship import rounded
from lamella.plans.registry import query
from lamella.sources.derived import Tables

TILE_KEY = ["slide_name", "channel", "tile_y", "tile_x"]
EDGE = 8


def long(df: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """One row per pixel ``i`` with the values of the arrays."""
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("i", "p"))
    return zipped.select(*keys, "i", *[F.col(f"p.{a}").alias(a) for a in arrays])


QUANT = {
    "q": "SELECT slide_name, channel, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi FROM {pixels} GROUP BY slide_name, channel",
    "ar": """SELECT slide_name, channel, tile_y, tile_x, top, CAST(floor(q[1]) AS INT) AS lo, CAST(floor(q[2]) AS INT) AS hi FROM (
 SELECT slide_name, channel, tile_y, tile_x, top, list_transform([0.01::DOUBLE, 0.99::DOUBLE], lambda p: CASE WHEN (len(vs)-1)*p - floor((len(vs)-1)*p) < 0.5
  THEN vs[CAST(floor((len(vs)-1)*p) AS INT)+1] + (vs[CAST(floor((len(vs)-1)*p) AS INT)+2] - vs[CAST(floor((len(vs)-1)*p) AS INT)+1]) * ((len(vs)-1)*p - floor((len(vs)-1)*p))
  ELSE vs[CAST(floor((len(vs)-1)*p) AS INT)+2] - (vs[CAST(floor((len(vs)-1)*p) AS INT)+2] - vs[CAST(floor((len(vs)-1)*p) AS INT)+1]) * (1 - ((len(vs)-1)*p - floor((len(vs)-1)*p))) END) AS q
 FROM (SELECT slide_name, channel, tile_y, tile_x, MAX(v) AS top, list(v ORDER BY v) AS vs FROM {flat} GROUP BY slide_name, channel, tile_y, tile_x) a) b""",
    "flat": "SELECT slide_name, channel, tile_y, tile_x, i, CASE WHEN tile_x = 1 THEN 0 WHEN tile_x = 2 THEN 7 ELSE v END AS v FROM {pixels}",
}


@query("channel_quantiles", "SELECT slide_name, channel, round(greatest(lo, 0), 6) AS lo, round(greatest(hi, lo + 1), 6) AS hi FROM {q}", QUANT)
def channel_quantiles(t: Tables) -> DataFrame:
    return rounded(px.channel_quantiles(t.tiles), "lo", "hi")


@query(
    "default_channel_settings",
    "SELECT c.slide_name, c.idx, c.name, c.idx < 10 AS visible, round(greatest(lo, 0), 6) AS min_val, round(greatest(hi, lo + 1), 6) AS max_val FROM {channels} c JOIN {q} ON q.slide_name = c.slide_name AND q.channel = c.name",
    QUANT,
)
def default_channel_settings(t: Tables) -> DataFrame:
    return rounded(ct.default_channel_settings(t.channels, px.channel_quantiles(t.tiles)), "min_val", "max_val")


def flat_tiles(t: Tables) -> DataFrame:
    """Tiles with all-zero and constant ones among them."""
    x = F.col("tile_x")
    return t.tiles.withColumn("px", F.transform("px", lambda v: F.when(x == 1, 0).when(x == 2, 7).otherwise(v)))


@query(
    "auto_range",
    "SELECT slide_name, channel, tile_y, tile_x, CASE WHEN top = 0 THEN 0 ELSE lo END AS lo, CASE WHEN top = 0 THEN 65535 WHEN hi <= lo THEN least(lo + 256, 65535) ELSE hi END AS hi FROM {ar}",
    QUANT,
)
def auto_range(t: Tables) -> DataFrame:
    return px.auto_range(flat_tiles(t), TILE_KEY)


@query(
    "slider_bounds",
    "SELECT slide_name, channel, tile_y, tile_x, CASE WHEN top = 0 THEN 65535 ELSE CAST(least(round_even(top * 1.2::DOUBLE, 0), 65535) AS INT) END AS bound FROM {ar}",
    QUANT,
)
def slider_bounds(t: Tables) -> DataFrame:
    return px.slider_bounds(flat_tiles(t), TILE_KEY)


COMP = {
    "lay": """SELECT p.slide_name, p.tile_y, p.tile_x, p.i, s.idx, s.r, s.g, s.b, CASE WHEN s.visible THEN least(greatest((p.v - s.min_val) / greatest(s.max_val - s.min_val, 1.0), 0.0), 1.0) END AS f
 FROM {pixels} p LEFT JOIN {channel_settings} s ON s.slide_name = p.slide_name AND s.name = p.channel""",
    "rgb": """SELECT slide_name, tile_y, tile_x, i, """
    + ", ".join(f"CAST(floor(least(greatest(COALESCE(SUM(f * ({c} / 255.0::DOUBLE) ORDER BY idx), 0), 0), 1) * 255) AS SMALLINT) AS {c}" for c in "rgb")
    + " FROM {lay} GROUP BY slide_name, tile_y, tile_x, i",
    "small": "SELECT slide_name FROM {levels} GROUP BY slide_name HAVING COUNT(*) >= 2 AND arg_max(CAST(width AS BIGINT) * height, level) <= 4000000",
}


@query("composite", "SELECT slide_name, tile_y, tile_x, i, r, g, b, CAST(255 AS SMALLINT) AS a FROM {rgb}", COMP)
def composite(t: Tables) -> DataFrame:
    out = pk.composite(t.tiles, t.channel_settings)
    return long(out, ["slide_name", "tile_y", "tile_x"], "r", "g", "b", "a")


@query("thumbnail", "SELECT slide_name, tile_y, tile_x, i, r, g, b FROM {rgb} WHERE slide_name IN (SELECT slide_name FROM {small})", COMP)
def thumbnail(t: Tables) -> DataFrame:
    last = t.slide_dims.select("slide_name", (F.col("n_levels") - 1).alias("level"))
    tiles = t.tiles.drop("level").join(last, "slide_name")
    return long(pk.thumbnail(tiles, t.levels, t.channel_settings), ["slide_name", "tile_y", "tile_x"], "r", "g", "b")


@query(
    "normalize_minmax",
    "SELECT slide_name, channel, tile_y, tile_x, i, CAST(trunc(least(greatest((v - 15000) / (25000.0::DOUBLE - 15000 + 1e-6::DOUBLE) * 255, 0), 255)) AS SMALLINT) AS n FROM {pixels}",
)
def normalize_minmax(t: Tables) -> DataFrame:
    ranged = t.tiles.withColumns({"lo": F.lit(15000.0), "hi": F.lit(25000.0)})
    return long(pk.normalize_minmax(ranged, "lo", "hi", "n"), TILE_KEY, "n")


@query(
    "normalize_percentile",
    """SELECT slide_name, channel, tile_y, tile_x, i, round(least(greatest((v - lo) / (hi - lo + 1e-8::DOUBLE), 0), 1), 6) AS norm FROM {pixels} JOIN
 (SELECT slide_name, channel, tile_y, tile_x, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.998) AS hi FROM {pixels} GROUP BY slide_name, channel, tile_y, tile_x) q USING (slide_name, channel, tile_y, tile_x)""",
)
def normalize_percentile(t: Tables) -> DataFrame:
    return rounded(long(pk.normalize_percentile(t.tiles), TILE_KEY, "norm"), "norm")


STACK = {
    "stk": """SELECT p.slide_name, p.channel, p.tile_y, p.tile_x, p.i, p.v AS red, CAST(0 AS INT) AS green, COALESCE(d.v, 0) AS blue FROM {pixels} p
 LEFT JOIN (SELECT x.* FROM {pixels} x JOIN (SELECT slide_name, arg_min(name, idx) AS name FROM {channels} WHERE contains(lower(name), 'dapi') OR contains(lower(name), 'hoechst') GROUP BY slide_name) c ON c.slide_name = x.slide_name AND c.name = x.channel) d
 ON d.slide_name = p.slide_name AND d.tile_y = p.tile_y AND d.tile_x = p.tile_x AND d.i = p.i"""
}


def stacks(t: Tables) -> DataFrame:
    first = ct.nuclear_channel(t.channels)
    stain = t.channels.join(first, ["slide_name", "idx"]).select("slide_name", F.col("name").alias("channel"))
    return px.stack_rgb16(t.tiles, stain)


@query("stack_rgb16", "SELECT slide_name, channel, tile_y, tile_x, i, red, green, blue FROM {stk}", STACK)
def stack_rgb16(t: Tables) -> DataFrame:
    return long(stacks(t), TILE_KEY, *px.BANDS)


@query("swap_rb", "SELECT slide_name, channel, tile_y, tile_x, i, blue AS red, green, red AS blue FROM {stk}", STACK)
def swap_rb(t: Tables) -> DataFrame:
    return long(px.swap_rb(stacks(t)), TILE_KEY, *px.BANDS)


@query(
    "normalize_meanstd",
    "SELECT slide_name, channel, tile_y, tile_x, i, round((red - 500.0::DOUBLE) / 1000.0::DOUBLE, 6) AS red, round(green / 1.0::DOUBLE, 6) AS green, round((blue - 4000.0::DOUBLE) / 10000.0::DOUBLE, 6) AS blue FROM {stk}",
    STACK,
)
def normalize_meanstd(t: Tables) -> DataFrame:
    out = pk.normalize_meanstd(stacks(t), *px.normalization_values("v1"))
    return rounded(long(out, TILE_KEY, *px.BANDS), *px.BANDS)


@query(
    "normalize_scale",
    "SELECT slide_name, channel, tile_y, tile_x, i, round((red/65535.0::DOUBLE - 0.485::DOUBLE)/0.229::DOUBLE, 6) AS red, round((green/65535.0::DOUBLE - 0.456::DOUBLE)/0.224::DOUBLE, 6) AS green, round((blue/65535.0::DOUBLE - 0.406::DOUBLE)/0.225::DOUBLE, 6) AS blue FROM {stk}",
    STACK,
)
def normalize_scale(t: Tables) -> DataFrame:
    return rounded(long(pk.normalize_scale(stacks(t)), TILE_KEY, *px.BANDS), *px.BANDS)


@query(
    "fov_tiles",
    """SELECT slide_name, fov_id, ox, oy, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, CAST(least(200, 512 - ty) AS INT) AS h, CAST(least(200, 512 - tx) AS INT) AS w FROM (
 SELECT slide_name, id AS fov_id, CAST(trunc(x) AS INT) AS ox, CAST(trunc(y) AS INT) AS oy, unnest([0, 200, 400]) AS ty, txs FROM (SELECT *, [0, 200, 400] AS txs FROM {fovs}) a) b, UNNEST(txs) AS u(tx)""",
)
def fov_tiles(t: Tables) -> DataFrame:
    return px.fov_tiles(t.fovs, 200)


REGION = {
    "rq": "SELECT id AS request_id, slide_name, CAST(floor(x/64) AS INT) - 8 AS x, CAST(floor(y/64) AS INT) - 8 AS y, CAST(12 AS INT) AS w, CAST(9 AS INT) AS h FROM {fovs}",
    "chn": "SELECT DISTINCT slide_name, channel FROM {pixels}",
    "lat": """SELECT r.request_id, r.slide_name, c.channel, yy, xx, greatest(r.x, 0) + xx AS sx, greatest(r.y, 0) + yy AS sy FROM (SELECT *, unnest(generate_series(0, h - 1)) AS yy, w AS ww FROM {rq}) r JOIN {chn} c ON c.slide_name = r.slide_name, generate_series(0, 11) AS g(xx)""",
    "abs_px": "SELECT slide_name, channel, tile_y*8 + CAST(floor(i/8) AS INT) AS sy, tile_x*8 + i%8 AS sx, v FROM {pixels}",
}


@query(
    "read_region",
    "SELECT l.request_id, l.channel, CAST(yy AS INT) AS row, CAST(xx AS INT) AS col, COALESCE(p.v, 0) AS v FROM {lat} l LEFT JOIN {abs_px} p ON p.slide_name = l.slide_name AND p.channel = l.channel AND p.sy = l.sy AND p.sx = l.sx",
    REGION,
)
def read_region(t: Tables) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / 64).cast("int") - 8
    requests = t.fovs.select(
        F.col("id").alias("request_id"), "slide_name", F.lit(0).alias("level"), cell("x").alias("x"), cell("y").alias("y"), F.lit(12).alias("w"), F.lit(9).alias("h")
    )
    channels = t.tiles.select("slide_name", "channel").distinct()
    strips = px.read_region(t.tiles, requests, channels, EDGE)
    return strips.select("request_id", "channel", "row", F.posexplode("px").alias("col", "v"))


DOWN = {
    **REGION,
    "dims": "SELECT slide_name, CAST(MAX(sx) + 1 AS INT) AS width, CAST(MAX(sy) + 1 AS INT) AS height FROM {abs_px} GROUP BY slide_name",
    "ry": "SELECT slide_name, k, CAST(CASE WHEN n > 1 AND k = n - 1 THEN height - 1 ELSE round_even(k * ((height - 1) / CAST(greatest(n - 1, 1) AS DOUBLE)), 0) END AS INT) AS sy FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, CAST(floor(height / 2.5) AS INT) AS n FROM {dims}) a) b",
    "rx": "SELECT slide_name, k, CAST(CASE WHEN n > 1 AND k = n - 1 THEN width - 1 ELSE round_even(k * ((width - 1) / CAST(greatest(n - 1, 1) AS DOUBLE)), 0) END AS INT) AS sx FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM (SELECT *, CAST(floor(width / 2.5) AS INT) AS n FROM {dims}) a) b",
}


@query(
    "downsample_nearest",
    "SELECT p.slide_name, p.channel, CAST(ry.k AS INT) AS row, string_agg(CAST(p.v AS STRING), ',' ORDER BY rx.k) AS vs FROM {abs_px} p JOIN {ry} ON ry.slide_name = p.slide_name AND ry.sy = p.sy JOIN {rx} ON rx.slide_name = p.slide_name AND rx.sx = p.sx GROUP BY p.slide_name, p.channel, ry.k",
    DOWN,
)
def downsample_nearest(t: Tables) -> DataFrame:
    extent = lambda c: ((F.max(c) + 1) * EDGE).cast("int")
    dims = t.tiles.groupBy("slide_name").agg(extent("tile_x").alias("width"), extent("tile_y").alias("height"))
    strips = px.downsample_nearest(t.tiles, dims, 2.5, EDGE)
    return strips.select("slide_name", "channel", "row", F.array_join("px", ",").alias("vs"))


@query(
    "pad_tile",
    """SELECT t.slide_name, t.channel, t.tile_y, t.tile_x, CAST(g.i AS INT) AS i, COALESCE(p.v, 0) AS v FROM (SELECT DISTINCT slide_name, channel, tile_y, tile_x FROM {pixels}) t, generate_series(0, 99) AS g(i)
 LEFT JOIN {pixels} p ON g.i % 10 < 8 AND p.slide_name = t.slide_name AND p.channel = t.channel AND p.tile_y = t.tile_y AND p.tile_x = t.tile_x AND p.i = floor(g.i/10)*8 + g.i % 10 AND floor(g.i/10) < 8""",
)
def pad_tile(t: Tables) -> DataFrame:
    padded = pk.pad_tiles(t.tiles.select(*TILE_KEY, "h", "w", "px"), 10)
    return long(padded.withColumnRenamed("px", "v"), TILE_KEY, "v")


MASKS = {
    "ms": """SELECT slide_name, channel, tile_y, tile_x, round(CASE WHEN total = 0 THEN 1 ELSE 2.0::DOUBLE*both_/total END, 6) AS dice, round(same/CAST(n AS DOUBLE), 6) AS accuracy FROM (
 SELECT slide_name, channel, tile_y, tile_x, SUM(CAST(gt AS INT)) + SUM(CAST(pred AS INT)) AS total, SUM(CAST(gt AND pred AS INT)) AS both_, SUM(CAST(gt = pred AS INT)) AS same, COUNT(*) AS n FROM {mask_pixels} GROUP BY slide_name, channel, tile_y, tile_x) q"""
}


@query("mask_scores", "SELECT slide_name, channel, tile_y, tile_x, dice, accuracy FROM {ms}", MASKS)
def mask_scores(t: Tables) -> DataFrame:
    return rounded(ev.mask_scores(t.mask_pixels, TILE_KEY), "dice", "accuracy")


@query("mask_scores_arrays", "SELECT slide_name, channel, tile_y, tile_x, dice, accuracy FROM {ms}", MASKS)
def mask_scores_arrays(t: Tables) -> DataFrame:
    gt = F.transform("px", lambda v: v > 20200)
    pred = F.transform("px", lambda v, i: (v > 20000) & (i % 5 != 0))
    cols = ev.mask_scores_arrays(F.col("gt"), F.col("pred"))
    masks = t.tiles.select(*TILE_KEY, gt.alias("gt"), pred.alias("pred"))
    return rounded(masks.select(*TILE_KEY, *[c.alias(k) for k, c in cols.items()]), "dice", "accuracy")


@query(
    "segmentation_metrics",
    "SELECT COALESCE(channel, '__overall__') AS marker, channel IS NULL AS is_overall, round(AVG(dice), 4) AS mean_dice, round(AVG(accuracy), 4) AS mean_accuracy, COUNT(*) AS n_fovs FROM {ms} GROUP BY GROUPING SETS ((channel), ())",
    MASKS,
)
def segmentation_metrics(t: Tables) -> DataFrame:
    scores = ev.mask_scores(t.mask_pixels, TILE_KEY).withColumnRenamed("channel", "marker")
    out = ev.segmentation_metrics(rounded(scores, "dice", "accuracy"))
    return out.withColumns({c: F.round(c, 4) for c in ("mean_dice", "mean_accuracy")})
