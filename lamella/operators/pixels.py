"""Pixel tiles: statistics, compositing, normalisation, cropping, resampling.

A tile row holds slide_name, channel, level, tile_y, tile_x, h, w and ``px``, its pixels
row by row. Work on one tile stays inside the row as array functions; ``pixel_kernels`` has
the same for whole batches of tiles. Crops and resampling move row strips, not single
pixels, between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Normalisation constants per scheme, the 16-bit range, the tile edge.
MEAN_STD = {
    "v0": ([123.675, 116.28, 103.53], [58.395, 57.12, 57.375]),
    "v1": ([500.0, 0.0, 4000.0], [1000.0, 1.0, 10000.0]),
    "v2": ([500.0, 0.0, 500.0], [1000.0, 1.0, 1000.0]),
}
IMAGENET = ([0.485, 0.456, 0.406], [0.229, 0.224, 0.225])
TOP = 65535
TILE = 512
THUMBNAIL_PIXELS = 2000 * 2000

BANDS = ("red", "green", "blue")


def histogram(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, v, n): how often each value occurs; at most 65,536 rows per key."""
    return tiles.select(*keys, F.explode("px").alias("v")).groupBy(*keys, "v").agg(F.count("*").alias("n"))


def _between(a: Column, b: Column, part: Column) -> Column:
    """Linear interpolation, from the nearer end."""
    return F.when(part < 0.5, a + (b - a) * part).otherwise(b - (b - a) * (F.lit(1.0) - part))


def _quantiles(tiles: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Exact quantiles q0, q1, .. and the maximum ``top`` per key, from the histogram."""
    upto = Window.partitionBy(*keys).orderBy("v")
    whole = Window.partitionBy(*keys)
    ranked = histogram(tiles, keys).withColumns({"_upto": F.sum("n").over(upto), "_n": F.sum("n").over(whole)})

    def at_rank(k: Column) -> Column:
        return F.min(F.when(F.col("_upto") > k, F.col("v")))

    cols = []
    for i, p in enumerate(points):
        place = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(place)
        cols += [
            at_rank(low).alias(f"_a{i}"),
            at_rank(F.least(low + 1, F.col("_n") - 1)).alias(f"_b{i}"),
            F.first(place - low).alias(f"_t{i}"),
        ]
    found = ranked.groupBy(*keys).agg(F.max("v").alias("top"), *cols)
    values = [_between(F.col(f"_a{i}"), F.col(f"_b{i}"), F.col(f"_t{i}")).alias(f"q{i}") for i in range(len(points))]
    return found.select(*keys, "top", *values)


def channel_quantiles(tiles: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Exact display range per slide and channel of the given tiles (one level)."""
    q = _quantiles(tiles, ["slide_name", "channel"], (low, high))
    lo, hi = F.col("q0"), F.col("q1")
    return q.select(
        "slide_name", "channel", F.greatest(lo, F.lit(0.0)).alias("lo"), F.greatest(hi, lo + F.lit(1.0)).alias("hi")
    )


def coarsest(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """Tiles of the last pyramid level of their slide."""
    last = levels.groupBy("slide_name").agg(F.max("level").alias("level"))
    return tiles.join(last, ["slide_name", "level"]).select(*tiles.columns)


def auto_range(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1st and 99th percentile as whole numbers; fallbacks for flat and empty images."""
    q = _quantiles(tiles, keys, (0.01, 0.99))
    lo, hi = F.col("q0").cast("int"), F.col("q1").cast("int")
    wide = F.when(hi <= lo, F.least(lo + 256, F.lit(TOP))).otherwise(hi)
    empty = F.col("top") == 0
    return q.select(
        *keys, F.when(empty, 0).otherwise(lo).alias("lo"), F.when(empty, TOP).otherwise(wide).alias("hi")
    )


def slider_bounds(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """20% above the greatest value, at most the 16-bit range; that range when all is 0."""
    top = tiles.groupBy(*keys).agg(F.max(F.array_max("px")).alias("top"))
    bound = F.least(F.rint(F.col("top") * 1.2), F.lit(float(TOP))).cast("int")
    return top.select(*keys, F.when(F.col("top") == 0, TOP).otherwise(bound).alias("bound"))


def _clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def composite(tiles: DataFrame, settings: DataFrame) -> DataFrame:
    """RGBA tiles of the visible channels.

    Each channel is scaled to its range and clipped, weighted by its color and added in
    channel order; the sum is clipped and truncated to 0..255. Invisible channels and
    channels without settings add nothing; a tile position with none of them is black.
    ``settings`` holds slide_name, name, idx, visible, r, g, b, min_val and max_val. The
    channels of one position meet in one row, which their number bounds.
    """
    s = settings.where("visible").select("slide_name", F.col("name").alias("channel"), "idx", "r", "g", "b", "min_val", "max_val")
    place = ["slide_name", "level", "tile_y", "tile_x", "h", "w"]
    span = F.greatest(F.col("max_val") - F.col("min_val"), F.lit(1.0))
    scaled = F.transform("px", lambda v: _clip((v - F.col("min_val")) / span, 0.0, 1.0))
    layer = F.when(F.col("idx").isNotNull(), F.struct("idx", "r", "g", "b", scaled.alias("v")))
    stacked = tiles.join(s, ["slide_name", "channel"], "left").groupBy(*place).agg(
        F.sort_array(F.collect_list(layer)).alias("layers")
    )
    black = F.array_repeat(F.lit(0.0), F.col("h") * F.col("w"))

    def band(c: str) -> Column:
        total = F.aggregate(
            "layers",
            black,
            lambda acc, a: F.zip_with(acc, a["v"], lambda t, v: t + v * (a[c] / F.lit(255.0))),
        )
        return F.transform(total, lambda v: F.floor(_clip(v, 0.0, 1.0) * 255.0).cast("smallint"))

    return stacked.select(
        *place,
        *[band(c).alias(c) for c in "rgb"],
        F.array_repeat(F.lit(255).cast("smallint"), F.col("h") * F.col("w")).alias("a"),
    )


def thumbnail_levels(levels: DataFrame) -> DataFrame:
    """(slide_name, level, factor): the coarsest level of slides with several and a small last one."""
    last = levels.groupBy("slide_name").agg(
        F.count("*").alias("n"), F.max_by(F.struct("level", "factor", "width", "height"), "level").alias("l")
    )
    fit = last.where((F.col("n") >= 2) & (F.col("l.width").cast("bigint") * F.col("l.height") <= THUMBNAIL_PIXELS))
    return fit.select("slide_name", "l.level", "l.factor")


def normalize_minmax(px: Column, lo: Column, hi: Column) -> Column:
    """Pixels of a range as 0..255, truncated."""
    span = hi - lo + F.lit(1e-6)
    return F.transform(px, lambda v: _clip((v - lo) / span * 255.0, 0.0, 255.0).cast("smallint"))


def array_quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array with linear interpolation."""
    at = (F.size(values) - 1) * F.lit(float(q))
    below = F.floor(at).cast("int")
    a, b = F.get(values, below), F.get(values, F.ceil(at).cast("int"))
    return _between(a, b, at - below)


def normalize_percentile(tiles: DataFrame, low: float = 1.0, high: float = 99.8) -> DataFrame:
    """Pixels between two percentiles of their tile as 0..1, as column ``norm``."""
    ranged = tiles.withColumn("_s", F.sort_array("px")).withColumns(
        {"_lo": array_quantile(F.col("_s"), low / 100), "_hi": array_quantile(F.col("_s"), high / 100)}
    )
    span = F.col("_hi") - F.col("_lo") + F.lit(1e-8)
    norm = F.transform("px", lambda v: _clip((v - F.col("_lo")) / span, 0.0, 1.0))
    return ranged.withColumn("norm", norm).drop("_s", "_lo", "_hi")


def normalization_values(
    scheme: str = "v2", depth16: bool = True, mean: Sequence[float] | None = None, std: Sequence[float] | None = None
) -> tuple[list[float], list[float]]:
    """Mean and standard deviation per band; given values win, 8-bit data uses v0."""
    if mean is not None and std is not None:
        return list(mean), list(std)
    return MEAN_STD.get(scheme if depth16 else "v0", MEAN_STD["v2"])


def normalize_meanstd(stacks: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """(v - mean) / std for the three band arrays."""
    def band(name: str, m: float, s: float) -> Column:
        return F.transform(name, lambda v: (v - F.lit(float(m))) * F.lit(1.0 / float(s)))

    return stacks.withColumns({b: band(b, m, s) for b, m, s in zip(BANDS, mean, std)})


def normalize_scale(stacks: DataFrame, scheme: str = "imagenet", scale: float = float(TOP)) -> DataFrame:
    """Bands as 0..1, then the scheme's mean and deviation unless it is ``none``."""
    unit = stacks.withColumns({b: F.transform(b, lambda v: v / F.lit(scale)) for b in BANDS})
    return unit if scheme == "none" else normalize_meanstd(unit, *IMAGENET)


def swap_rb(stacks: DataFrame) -> DataFrame:
    return stacks.withColumns({"red": F.col("blue"), "blue": F.col("red")})


PLACE = ("slide_name", "level", "tile_y", "tile_x")


def stack_rgb16(tiles: DataFrame, nuclear: DataFrame, place: Sequence[str] = PLACE) -> DataFrame:
    """Three-band tiles per marker channel: red the marker, green 0, blue the nuclear stain.

    ``place`` names the columns that tell one tile of a channel from another.

    ``nuclear`` holds slide_name and the channel name of the stain; without one, or
    where its tile is missing, blue is 0.
    """
    place = list(place)
    stain = nuclear.select("slide_name", "channel")
    blue = tiles.join(stain, ["slide_name", "channel"], "left_semi").select(*place, F.col("px").alias("_blue"))
    zeros = F.transform("px", lambda v: F.lit(0))
    return tiles.join(blue, place, "left").select(
        *place, "channel", "h", "w", F.col("px").alias("red"), zeros.alias("green"), F.coalesce("_blue", zeros).alias("blue")
    )


def fov_tiles(fovs: DataFrame, size: int = TILE) -> DataFrame:
    """Tile grid of each field of view: whole-number corner, offsets and valid extent."""
    w, h = F.col("w").cast("int"), F.col("h").cast("int")

    def steps(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))

    rows = fovs.select(
        "slide_name",
        F.col("id").alias("fov_id"),
        F.col("x").cast("int").alias("ox"),
        F.col("y").cast("int").alias("oy"),
        w.alias("_w"),
        h.alias("_h"),
        F.explode(steps(h)).alias("ty"),
    ).withColumn("tx", F.explode(steps(F.col("_w"))))
    return rows.select(
        "slide_name",
        "fov_id",
        "ox",
        "oy",
        "ty",
        "tx",
        F.least(F.lit(size), F.col("_h") - F.col("ty")).alias("h"),
        F.least(F.lit(size), F.col("_w") - F.col("tx")).alias("w"),
    )


def _zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))


def read_region(tiles: DataFrame, requests: DataFrame, channels: DataFrame, size: int = TILE) -> DataFrame:
    """Row strips (request_id, channel, row, px) of a rectangle of one level.

    ``requests`` holds request_id, slide_name, level, x, y, w and h; ``channels`` holds
    slide_name and channel, and request_id where each request has its own. A negative corner moves to 0 without shrinking the
    rectangle; pixels outside the slide are 0. Every covered tile gives one segment per
    row, and the segments of a row are joined, so no step handles single pixels.
    """
    on = ["slide_name", *(["request_id"] if "request_id" in channels.columns else [])]
    at = requests.withColumns({c: F.greatest(c, F.lit(0)) for c in ("x", "y")}).join(channels, on)
    span = lambda c, n: F.sequence(F.floor(F.col(c) / size).cast("int"), F.floor((F.col(c) + F.col(n) - 1) / size).cast("int"))
    grid = at.withColumnsRenamed({"w": "_w", "h": "_h"}).where("_w > 0 AND _h > 0")
    grid = grid.withColumn("tile_y", F.explode(span("y", "_h"))).withColumn("tile_x", F.explode(span("x", "_w")))
    have = tiles.select("slide_name", "channel", "level", "tile_y", "tile_x", "h", "w", "px")
    joined = grid.join(have, ["slide_name", "channel", "level", "tile_y", "tile_x"], "left")
    lo = lambda c, k: F.greatest(F.col(c), F.col(k) * size)
    hi = lambda c, n, k: F.least(F.col(c) + F.col(n), (F.col(k) + 1) * size)
    part = joined.select(
        "request_id",
        "channel",
        "tile_x",
        "h",
        "w",
        "px",
        (F.col("tile_y") * size).alias("_top"),
        F.col("y").alias("_y"),
        (lo("x", "tile_x") - F.col("tile_x") * size).alias("_c0"),
        (hi("x", "_w", "tile_x") - F.col("tile_x") * size).alias("_c1"),
        F.explode(F.sequence(lo("y", "tile_y"), hi("y", "_h", "tile_y") - 1)).alias("_row"),
    )
    local = F.col("_row") - F.col("_top")
    have_n = F.greatest(F.least("_c1", "w") - F.col("_c0"), F.lit(0))
    n = F.when(F.col("px").isNotNull() & (local < F.col("h")), have_n).otherwise(0)
    start = (local * F.col("w") + F.col("_c0") + 1).cast("int")
    got = F.when(n > 0, F.slice("px", start, n)).otherwise(F.array().cast("array<int>"))
    seg = F.concat(got, _zeros(F.col("_c1") - F.col("_c0") - n))
    rows = part.select("request_id", "channel", (F.col("_row") - F.col("_y")).alias("row"), F.struct("tile_x", seg.alias("v")).alias("s"))
    joined_rows = rows.groupBy("request_id", "channel", "row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return joined_rows.select("request_id", "channel", "row", F.flatten(F.transform("s", lambda a: a["v"])).alias("px"))


def downsample_nearest(tiles: DataFrame, dims: DataFrame, remaining: float, size: int = TILE) -> DataFrame:
    """Row strips (slide_name, channel, row, px) of a level shrunk by ``remaining``.

    ``dims`` holds slide_name, width and height of the level. Output row k takes the
    source row at k equal steps from the first to the last row, rounded half to even;
    columns likewise. Each tile picks its own share, so pixels that are not taken never
    leave the task. A factor of at most 1 leaves the image as it is.
    """
    sized = tiles.join(dims.select("slide_name", "width", "height"), "slide_name")

    def out(n: str) -> Column:
        return F.col(n) if remaining <= 1 else (F.col(n) / F.lit(float(remaining))).cast("int")

    def picks(n: str, tile: str, extent: str) -> Column:
        count = out(n)
        step = (F.col(n) - 1) / F.greatest(count - 1, F.lit(1))
        begin = F.col(tile) * size
        # The output rows whose source can lie in the tile, by arithmetic, with one to spare.
        low = F.greatest(F.floor((begin - 1) / F.nullif(step, F.lit(0.0))), F.lit(0))
        high = F.least(F.ceil((begin + F.col(extent) + 1) / F.nullif(step, F.lit(0.0))), count - 1)
        low, high = [F.coalesce(v, F.lit(0)).cast("int") for v in (low, high)]
        near = F.when((count > 0) & (high >= low), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        source = lambda k: F.when((k == count - 1) & (count > 1), F.col(n) - 1).otherwise(F.rint(k * step).cast("int"))
        pairs = F.transform(near, lambda k: F.struct(k.alias("k"), (source(k) - begin).alias("at")))
        return F.filter(pairs, lambda p: (p["at"] >= 0) & (p["at"] < F.col(extent)))

    chosen = sized.withColumns({"_rows": picks("height", "tile_y", "h"), "_cols": picks("width", "tile_x", "w")})
    rows = chosen.where(F.size("_cols") > 0).select("slide_name", "channel", "tile_x", "w", "px", "_cols", F.explode("_rows").alias("_r"))
    seg = F.transform("_cols", lambda c: F.get("px", (F.col("_r.at") * F.col("w") + c["at"]).cast("int")))
    strips = rows.select("slide_name", "channel", F.col("_r.k").alias("row"), F.struct("tile_x", seg.alias("v")).alias("s"))
    merged = strips.groupBy("slide_name", "channel", "row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return merged.select("slide_name", "channel", "row", F.flatten(F.transform("s", lambda a: a["v"])).alias("px"))


def pad_tile(px: Column, h: Column, w: Column, size: int = TILE) -> Column:
    """Zero padding at the bottom and right to a square of the given edge."""
    row = lambda r: F.concat(F.slice(px, (r * w + 1).cast("int"), w), _zeros(F.lit(size) - w))
    rows = F.transform(F.sequence(F.lit(0), h - 1), row)
    return F.concat(F.flatten(rows), _zeros((F.lit(size) - h) * size))
