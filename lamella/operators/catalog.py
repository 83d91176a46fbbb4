"""Slide catalogue, groups, channels, pyramid levels and view settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.operators.annotations import latest_per_key

SETTINGS_JSON = "channels array<struct<name:string, visible:boolean, min:double, max:double>>"
OME_XML = (
    "Instrument array<struct<Objective:array<struct<_NominalMagnification:double>>>>, "
    "Image array<struct<Pixels:array<struct<_SizeC:int, _PhysicalSizeX:double, _PhysicalSizeY:double, "
    "_PhysicalSizeXUnit:string, _PhysicalSizeYUnit:string, Channel:array<struct<_Name:string>>>>>>"
)


def slide_catalog(files: DataFrame, root: str) -> DataFrame:
    """One row per slide stem of a file listing (``path``): the greatest path wins."""
    name = nm.base_name(F.col("path"))
    rows = files.where(nm.is_slide_file(name)).select(
        nm.stem(name).alias("slide_name"), F.col("path").alias("slide_path")
    )
    best = rows.groupBy("slide_name").agg(F.max("slide_path").alias("slide_path"))
    return best.withColumn("slide_group", nm.classify_group(F.col("slide_path"), root))


def ome_metadata(df: DataFrame, xml: str) -> DataFrame:
    """Channel count and names, pixel sizes in micrometres and magnification of OME-XML."""
    parsed = df.withColumn("_ome", F.from_xml(xml, OME_XML, {"ignoreNamespace": "true", "attributePrefix": "_"}))
    pixels = F.get(F.get(F.col("_ome.Image"), 0)["Pixels"], 0)
    objective = F.get(F.get(F.col("_ome.Instrument"), 0)["Objective"], 0)

    def size(axis: str) -> Column:
        unit = F.coalesce(pixels[f"_PhysicalSize{axis}Unit"], F.lit("µm"))
        return F.coalesce(nm.to_microns(pixels[f"_PhysicalSize{axis}"], unit), F.lit(0.0))

    listed = F.transform(pixels["Channel"], lambda c: F.coalesce(c["_Name"], F.lit("")))
    return parsed.select(
        *df.columns,
        F.coalesce(pixels["_SizeC"], F.lit(0)).alias("num_channels"),
        size("X").alias("pixel_size_x"),
        size("Y").alias("pixel_size_y"),
        F.coalesce(listed, F.array().cast("array<string>")).alias("channel_names"),
        F.coalesce(objective["_NominalMagnification"], F.lit(0.0)).alias("magnification"),
    )


def read_view_settings(df: DataFrame, js: str) -> DataFrame:
    """One row per channel of a saved settings text; other text gives no rows."""
    parsed = df.select("slide_name", F.posexplode(F.from_json(js, SETTINGS_JSON)["channels"]).alias("pos", "c"))
    return parsed.select(
        "slide_name",
        "pos",
        F.col("c.name").alias("name"),
        F.col("c.visible").alias("visible"),
        F.col("c.min").alias("min_val"),
        F.col("c.max").alias("max_val"),
    )


def view_settings_json(settings: DataFrame) -> DataFrame:
    """Settings document per slide, channels in index order.

    A row per slide is the document itself; the group is the channel list of one slide.
    """
    item = F.struct(
        "idx", F.struct("name", "visible", F.col("min_val").alias("min"), F.col("max_val").alias("max")).alias("c")
    )
    return settings.groupBy("slide_name").agg(F.sort_array(F.collect_list(item)).alias("_all")).select(
        "slide_name", F.to_json(F.struct(F.transform("_all", lambda a: a["c"]).alias("channels"))).alias("js")
    )


def default_channel_settings(channels: DataFrame, quantiles: DataFrame) -> DataFrame:
    """The first ten channels visible, ranges from the channel quantiles."""
    q = quantiles.select("slide_name", F.col("channel").alias("name"), F.col("lo").alias("min_val"), F.col("hi").alias("max_val"))
    return channels.join(q, ["slide_name", "name"]).select(
        "slide_name", "idx", "name", (F.col("idx") < 10).alias("visible"), "min_val", "max_val"
    )


def apply_view_settings(settings: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved fields in place of the defaults, by channel name; the last duplicate wins."""
    last = latest_per_key(saved, ["slide_name", "name"], ["pos"])
    fields = ("visible", "min_val", "max_val")
    s = last.select("slide_name", "name", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    return settings.join(s, ["slide_name", "name"], "left").select(
        *[c for c in settings.columns if c not in fields],
        *[F.coalesce(f"_{c}", c).alias(c) for c in fields],
        F.coalesce("_hit", F.lit(False)).alias("applied"),
    )


def refresh_locations(recorded: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per annotated slide: updated, unchanged or not_found, and the path to keep."""
    c = catalog.select("slide_name", F.col("slide_path").alias("_new"))
    status = (
        F.when(F.col("_new").isNull(), "not_found")
        .when(F.col("slide_path").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("updated")
    )
    return recorded.join(c, "slide_name", "left").select(
        "slide_name", status.alias("status"), F.coalesce("_new", "slide_path").alias("slide_path")
    )


def image_list(files: DataFrame, counts: DataFrame, root: str) -> DataFrame:
    """Every slide file with its annotation counts and group, sorted by lower-case name."""
    name = nm.base_name(F.col("path"))
    rows = files.where(nm.is_slide_file(name)).select(
        name.alias("file_name"),
        F.col("path").alias("slide_path"),
        nm.stem(name).alias("slide_name"),
        nm.classify_group(F.col("path"), root).alias("slide_group"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    joined = rows.join(counts, "slide_name", "left")
    return joined.select(*rows.columns, *[zero(c) for c in ("cell_marker", "region", "fov")]).orderBy(
        F.lower("file_name"), "slide_path"
    )


def marker_groups(by_slide: DataFrame, catalog: DataFrame) -> DataFrame:
    """Channel to the sorted groups of its slides; slides not on disk count as train."""
    joined = by_slide.join(catalog.select("slide_name", "slide_group"), "slide_name", "left")
    group = F.coalesce("slide_group", F.lit(nm.DEFAULT_GROUP))
    rows = joined.select(F.explode("channels").alias("biomarker"), group.alias("g"))
    return rows.groupBy("biomarker").agg(F.sort_array(F.collect_set("g")).alias("groups"))


def review_fovs(entries: DataFrame, catalog: DataFrame, channels: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """Field-of-view entries of checked channels whose slide is in a checked group."""
    joined = entries.where(F.col("channel").isin(list(channels))).join(
        catalog.select("slide_name", "slide_group"), "slide_name", "left"
    )
    group = F.coalesce("slide_group", F.lit(nm.DEFAULT_GROUP))
    return joined.where(group.isin(list(groups))).select(*entries.columns)


def nuclear_channel(channels: DataFrame) -> DataFrame:
    """Index of the first nuclear stain per slide, NULL without one."""
    return channels.groupBy("slide_name").agg(F.min(F.when(nm.is_nuclear(F.col("name")), F.col("idx"))).alias("idx"))


def first_flagged(df: DataFrame, keys: Sequence[str], flag: Column, order: str, name: str) -> DataFrame:
    """Per key the first row with the flag, else the first row."""
    return df.groupBy(*keys).agg(F.min_by(name, F.struct(~flag, F.col(order))).alias(name))


def pyramid_levels(slides: DataFrame) -> DataFrame:
    """Factor, width and height of every level; an edge never falls below one pixel."""
    lv = slides.withColumn("level", F.explode(F.sequence(F.lit(0), F.greatest("n_levels", F.lit(1)) - 1)))
    factor = F.pow("factor", "level")
    edge = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) / factor)).cast("int").alias(c)
    return lv.select("slide_name", "level", factor.alias("factor"), edge("width"), edge("height"))


def best_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Last level whose factor is at most the requested downsampling, else 0.

    ``requests`` holds request_id, slide_name and downsample.
    """
    joined = requests.join(levels.select("slide_name", "level", "factor"), "slide_name")
    fits = F.when(F.col("factor") <= F.col("downsample") + F.lit(1e-6), F.col("level"))
    return joined.groupBy("slide_name", "request_id").agg(F.coalesce(F.max(fits), F.lit(0)).alias("level"))


def best_pow2_level(factor: Column, n: Column) -> Column:
    """Struct (level, level_factor): the largest power of two up to the factor."""
    ks = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.pow(F.lit(2.0), k) <= factor)
    k = F.coalesce(F.array_max(ks), F.lit(0))
    return F.struct(k.cast("int").alias("level"), F.pow(F.lit(2.0), k).cast("int").alias("level_factor"))


def viewport_tiles(requests: DataFrame, levels: DataFrame, size: int = 512) -> DataFrame:
    """Tiles of the level fitting the zoom that a viewport needs, upper bound included.

    ``requests`` holds request_id, slide_name, zoom, left, top, right, bottom.
    """
    zoomed = requests.withColumn(
        "downsample", F.greatest(F.lit(1.0) / F.greatest(F.col("zoom"), F.lit(1e-6)), F.lit(1.0))
    )
    level = best_level(zoomed, levels)
    rows = requests.join(level, ["slide_name", "request_id"]).join(levels, ["slide_name", "level"])
    index = lambda c: (F.col(c) / F.col("factor") / F.lit(float(size))).cast("bigint")
    tiles = lambda c: F.floor((F.col(c) + size - 1) / F.lit(size)).cast("bigint")

    def span(lo: str, hi: str, edge: str) -> Column:
        first = F.greatest(F.lit(0), index(lo))
        last = F.least(tiles(edge), index(hi) + 1)
        return F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    return (
        rows.withColumn("tile_y", span("top", "bottom", "height"))
        .withColumn("tile_x", span("left", "right", "width"))
        .select("slide_name", "request_id", "level", "factor", "tile_y", "tile_x")
    )


def tile_scene_origin(tile_y: Column, tile_x: Column, factor: Column, size: int = 512) -> dict[str, Column]:
    return {"scene_x": tile_x * size * factor, "scene_y": tile_y * size * factor}
