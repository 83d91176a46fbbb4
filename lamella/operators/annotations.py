"""Annotation tables: defaults, filters, projections, counts, set operations, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import boxes as bx

TYPES = ("cell_marker", "region", "fov")
LOAD_ORDER = ("created_at", "id")


def with_load_defaults(df: DataFrame) -> DataFrame:
    """0 and NULL sizes and color parts become their defaults; unknown types are dropped."""
    size = F.when(F.col("type") == "fov", F.lit(bx.FOV_SIZE)).otherwise(F.lit(bx.MARKER_SIZE))
    fill = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)), d)
    sized = F.col("type").isin("cell_marker", "fov")
    cols = {c: F.when(sized, fill(c, size)).otherwise(F.col(c)) for c in ("w", "h")}
    cols |= {c: fill(c, F.lit(bx.COLOR_DEFAULT)) for c in ("color_r", "color_g", "color_b") if c in df.columns}
    if "created_by" in df.columns:
        cols["created_by"] = F.coalesce("created_by", F.lit(""))
    return df.where(F.col("type").isin(*TYPES)).withColumns(cols)


def load_order(df: DataFrame) -> DataFrame:
    """Rows by slide, oldest first, ties by id."""
    return df.orderBy("slide_name", *LOAD_ORDER)


def detections_to_markers(dets: DataFrame, channel: str) -> DataFrame:
    """Centre markers of boxes; the id is a hash of the row, so reruns give the same id."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    return dets.select(
        "slide_name",
        F.lit(channel).alias("biomarker"),
        x.alias("x"),
        y.alias("y"),
        (F.col("x2") - F.col("x1")).alias("w"),
        (F.col("y2") - F.col("y1")).alias("h"),
    ).withColumn("id", F.sha2(F.to_json(F.struct("slide_name", "biomarker", "x", "y", "w", "h")), 256))


def translate(df: DataFrame, dx: float, dy: float) -> DataFrame:
    """Move markers and fields of view, and every ring point where there is ``rings``."""
    cols: dict[str, Column] = {"x": F.col("x") + dx, "y": F.col("y") + dy}
    if "rings" in df.columns:
        cols["rings"] = F.transform(
            "rings",
            lambda ring: F.transform(
                ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))
            ),
        )
    return df.withColumns(cols)


def select_channels(df: DataFrame, channels: Sequence[str] | DataFrame | None, name: str = "biomarker") -> DataFrame:
    """Rows of the channels; NULL keeps all. The channels may be a one-column table."""
    if channels is None:
        return df
    if isinstance(channels, DataFrame):
        wanted = channels.select(F.col(channels.columns[0]).alias(name)).distinct()
        return df.join(wanted, name, "left_semi").select(*df.columns)
    return df.where(F.col(name).isin(list(channels)))


def select_in_rect(df: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Markers whose centre, and fields of view whose rectangle, meets the rectangle."""
    rect = [F.lit(float(v)) for v in (x, y, w, h)]
    centre = bx.in_rect(F.col("x"), F.col("y"), *rect)
    meets = (
        (F.col("x") <= x + w) & (F.col("x") + F.col("w") >= x) & (F.col("y") <= y + h) & (F.col("y") + F.col("h") >= y)
    )
    return df.where(
        F.when(F.col("type") == "cell_marker", centre).when(F.col("type") == "fov", meets).otherwise(False)
    )


def delete_annotations(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed; unknown ids have no effect."""
    return df.join(ids.select("id"), "id", "left_anti").select(*df.columns)


def visible_annotations(df: DataFrame, active: str) -> DataFrame:
    return df if active == "" else df.where(F.col("biomarker") == active)


def target_fovs(fovs: DataFrame, active: str) -> DataFrame:
    """Per slide the fields of view flagged ``selected``, else those of the active channel."""
    some = fovs.where("selected").select("slide_name").distinct().withColumn("_some", F.lit(True))
    marked = fovs.join(some, "slide_name", "left")
    keep = F.when(F.col("_some"), F.col("selected")).otherwise(F.col("biomarker") == active)
    return marked.where(keep).select(*fovs.columns)


def filter_by_groups(items: DataFrame, active: Sequence[str]) -> DataFrame:
    """Items with a group in ``active``; items of unknown groups stay."""
    wanted = F.array(*[F.lit(g) for g in active]).cast("array<string>")
    return items.where(F.col("groups").isNull() | F.arrays_overlap("groups", wanted))


def counts_by_slide(df: DataFrame) -> DataFrame:
    """Markers, regions and fields of view per slide; a slide of other types only has zeros."""
    return df.groupBy("slide_name").agg(
        *[F.count_if(F.col("type") == t).cast("bigint").alias(t) for t in TYPES]
    )


def summary(df: DataFrame) -> DataFrame:
    """Rows, slides and (for markers) named biomarkers per known type, absent types 0.

    Spark takes the distinct values first, spread over the cluster; a type's own group
    only adds up partial counts and gathers the biomarker names.
    """
    named = F.when((F.col("type") == "cell_marker") & (F.col("biomarker") != ""), F.col("biomarker"))
    found = df.groupBy("type").agg(
        F.count("*").alias("n"),
        F.countDistinct("slide_name").alias("slides"),
        F.sort_array(F.collect_set(named)).alias("names"),
    )
    known = df.sparkSession.createDataFrame([(t,) for t in TYPES], "type string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return known.join(found, "type", "left").select(
        "type",
        zero("n").alias("n"),
        zero("slides").alias("slides"),
        F.size(names).cast("bigint").alias("biomarkers"),
        F.array_join(names, ",").alias("biomarker_names"),
    )


def distinct_channels(df: DataFrame, kind: str) -> DataFrame:
    rows = df.where((F.col("type") == kind) & (F.col("biomarker") != ""))
    return rows.select("biomarker").distinct().orderBy("biomarker")


def channels_by_slide(df: DataFrame, kind: str) -> DataFrame:
    """Sorted distinct channels per slide, as an array."""
    rows = df.where((F.col("type") == kind) & (F.col("biomarker") != ""))
    return rows.groupBy("slide_name").agg(F.sort_array(F.collect_set("biomarker")).alias("channels"))


def fov_counts_by_channel(df: DataFrame) -> DataFrame:
    return df.groupBy("slide_name", "biomarker").agg(F.count("*").cast("bigint").alias("n"))


def annotated_channels(channels: DataFrame, fovs: DataFrame) -> DataFrame:
    """Channels of a slide that have at least one field of view."""
    on = (channels["slide_name"] == fovs["slide_name"]) & (channels["name"] == fovs["biomarker"])
    return channels.join(fovs, on, "left_semi")


def all_annotations(markers: DataFrame, regions: DataFrame, fovs: DataFrame) -> DataFrame:
    """The three kinds in one table; columns a kind lacks are NULL."""
    kinds = zip(TYPES, (markers, regions, fovs))
    first, *rest = [df.withColumn("type", F.lit(t)) for t, df in kinds]
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    values = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def upsert(current: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``current`` with the rows of ``updates`` put in place of equal keys."""
    kept = current.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*current.columns).unionByName(updates.select(*current.columns))


def record_slide_paths(current: DataFrame, updates: DataFrame) -> DataFrame:
    return upsert(current, updates, ["slide_name"])


def replace_slides(current: DataFrame, saved: DataFrame, slides: DataFrame, now: Column) -> DataFrame:
    """The table after saving ``slides``: their old rows go, the saved rows come in.

    ``slides`` also names slides that were saved empty. ``modified_at`` becomes ``now``.
    """
    kept = current.join(slides.select("slide_name").distinct(), "slide_name", "left_anti")
    fresh = saved.withColumn("modified_at", now)
    return kept.select(*current.columns).unionByName(fresh.select(*current.columns))


def slide_paths_of_annotated(annotations: DataFrame, paths: DataFrame) -> DataFrame:
    """Every annotated slide with its path, NULL where none is recorded."""
    names = annotations.select("slide_name").distinct()
    return names.join(paths, "slide_name", "left").orderBy("slide_name")


def count_all(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def count_per_biomarker(df: DataFrame) -> DataFrame:
    return df.groupBy("biomarker").agg(F.count("*").alias("n"))
