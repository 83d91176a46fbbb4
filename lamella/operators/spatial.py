"""Spatial joins on grid cells of several sizes.

A range or overlap predicate alone would make Spark compare every pair inside a slide.
Here rectangles get the cells they cover on the grid of their own size, at most four; a
point, or a smaller rectangle, looks up its cells on every grid that the other side uses.
The join is an equi-join on slide, grid and cell, and the exact predicate stays as a
residual filter. A slide with many rows is so spread over its cells, AQE splits a cell
that is still too large, and a rectangle over a whole slide costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.session import durable

#: Cells of the finest grid in pixels, unless a caller says otherwise; grid k has cells 2 ** k
#: times as long.
FINEST = 1.0
COARSEST = 40


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("bigint")


def on_cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float) -> DataFrame:
    """One row per cell ``_cx, _cy`` of one grid that the closed box touches."""
    return df.withColumn(
        "_cx", F.explode(F.sequence(cell(x1, size), cell(x2, size)))
    ).withColumn("_cy", F.explode(F.sequence(cell(y1, size), cell(y2, size))))


def grid_of(x1: Column, y1: Column, x2: Column, y2: Column, size: float = FINEST) -> Column:
    """The finest grid whose cells are as long as the longer side of the box."""
    side = F.greatest(x2 - x1, y2 - y1, F.lit(float(size))) / F.lit(float(size))
    return F.least(F.ceil(F.log2(side)), F.lit(COARSEST)).cast("int")


def _on_grid(v: Column, size: float) -> Column:
    return F.floor(v / (F.lit(float(size)) * F.pow(F.lit(2.0), F.col("_grid")))).cast("bigint")


def grid_cells(df: DataFrame, x1: Column, y1: Column, x2: Column, y2: Column, size: float = FINEST) -> DataFrame:
    """One row per cell ``_cx, _cy`` of the grid ``_grid`` that the closed box touches."""
    for name, low, high in (("_cx", x1, x2), ("_cy", y1, y2)):
        df = df.withColumn(name, F.explode(F.sequence(_on_grid(low, size), _on_grid(high, size))))
    return df


def grids_in_use(df: DataFrame, grid: Column) -> Column:
    """The distinct grids of ``df`` as an array: one small row that is read as a value."""
    return df.agg(F.sort_array(F.collect_set(grid)).alias("_grids")).scalar()


def roomy_grid_of(x1: Column, y1: Column, x2: Column, y2: Column, size: float = FINEST) -> Column:
    """A grid of every second size whose cells are at least twice as long as the box.

    Most boxes then lie in one cell, and boxes of similar sizes on one grid.
    """
    side = F.greatest(x2 - x1, y2 - y1, F.lit(float(size) / 2)) * 2 / F.lit(float(size))
    return F.least(2 * F.ceil(F.log2(side) / 2), F.lit(COARSEST)).cast("int")


def overlap_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], size: float = FINEST, residual: Column | None = None
) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose closed boxes touch.

    Left boxes are ``l_x1..l_y2``, right boxes ``r_x1..r_y2``; ``keys`` exist on both
    sides and appear once in the result. A pair meets on the coarser of the two boxes'
    grids, in every cell there that both touch, and is kept in the lowest one only, which
    holds the lower corner of the common part.
    """
    sides = []
    for mine, p, its, q in ((left, "l_", right, "r_"), (right, "r_", left, "l_")):
        other = grids_in_use(its, roomy_grid_of(*bx.box(q), size))
        own = mine.withColumn(f"{p}_grid", roomy_grid_of(*bx.box(p), size))
        every = own.withColumn("_grid", F.explode(F.array_union(F.array(f"{p}_grid"), other)))
        sides.append(grid_cells(every.where(F.col("_grid") >= F.col(f"{p}_grid")), *bx.box(p), size))
    joined = sides[0].join(sides[1], [*keys, "_grid", "_cx", "_cy"])
    low_x = F.greatest("l_x1", "r_x1")
    low_y = F.greatest("l_y1", "r_y1")
    cond = (
        (F.col("_grid") == F.greatest("l__grid", "r__grid"))
        & (low_x <= F.least("l_x2", "r_x2"))
        & (low_y <= F.least("l_y2", "r_y2"))
        & (F.col("_cx") == _on_grid(low_x, size))
        & (F.col("_cy") == _on_grid(low_y, size))
    )
    if residual is not None:
        cond = cond & residual
    return joined.where(cond).drop("_grid", "_cx", "_cy", "l__grid", "r__grid")


def points_in_boxes(
    points: DataFrame, x: str, y: str, boxes: DataFrame, sides: Sequence[Column], keys: Sequence[str], size: float = FINEST
) -> DataFrame:
    """Candidates: points and boxes of equal ``keys`` in a common cell of the box's grid."""
    b = grid_cells(boxes.withColumn("_grid", grid_of(*sides, size)), *sides, size)
    p = points.withColumn("_grid", F.explode(grids_in_use(boxes, grid_of(*sides, size))))
    p = p.withColumns({"_cx": _on_grid(F.col(x), size), "_cy": _on_grid(F.col(y), size)})
    return p.join(b, [*keys, "_grid", "_cx", "_cy"]).drop("_grid", "_cx", "_cy")


def markers_in_fovs(
    markers: DataFrame, fovs: DataFrame, same_channel: bool = False, size: float = FINEST
) -> DataFrame:
    """Markers inside each field of view of their slide, sides included.

    A marker in several fields of view gives several rows. The channel of the field of
    view counts only with ``same_channel``.
    """
    f = fovs.select(
        "slide_name",
        F.col("id").alias("fov_id"),
        F.col("biomarker").alias("fov_channel"),
        F.col("x").alias("fov_x"),
        F.col("y").alias("fov_y"),
        F.col("w").alias("fov_w"),
        F.col("h").alias("fov_h"),
        F.col("created_at").alias("fov_created_at"),
    )
    sides = (F.col("fov_x"), F.col("fov_y"), F.col("fov_x") + F.col("fov_w"), F.col("fov_y") + F.col("fov_h"))
    inside = bx.in_rect(*[F.col(c) for c in ("x", "y", "fov_x", "fov_y", "fov_w", "fov_h")])
    if same_channel:
        inside = inside & (F.col("biomarker") == F.col("fov_channel"))
    return points_in_boxes(markers.withColumnRenamed("id", "marker_id"), "x", "y", f, sides, ["slide_name"], size).where(inside)


def regions_in_fovs(bboxes: DataFrame, fovs: DataFrame, size: float = FINEST) -> DataFrame:
    """Region bounding boxes touching a field of view of the same slide and channel.

    ``bboxes`` holds region_id, slide_name, biomarker, x1, y1, x2, y2.
    """
    left = bboxes.select(
        "slide_name", "biomarker", "region_id", *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    right = fovs.select(
        "slide_name",
        "biomarker",
        F.col("id").alias("fov_id"),
        F.col("x").alias("r_x1"),
        F.col("y").alias("r_y1"),
        (F.col("x") + F.col("w")).alias("r_x2"),
        (F.col("y") + F.col("h")).alias("r_y2"),
        F.col("w").alias("fov_w"),
        F.col("h").alias("fov_h"),
    )
    pairs = overlap_pairs(left, right, ["slide_name", "biomarker"], size)
    return pairs.select(
        "slide_name",
        "biomarker",
        "region_id",
        "fov_id",
        F.col("r_x1").alias("fov_x"),
        F.col("r_y1").alias("fov_y"),
        "fov_w",
        "fov_h",
    )


def iou_join(
    pred: DataFrame, gt: DataFrame, keys: Sequence[str], threshold: float = bx.IOU_THRESHOLD, size: float = FINEST
) -> DataFrame:
    """Prediction/truth pairs of equal ``keys`` with IoU of at least ``threshold``.

    Both inputs hold ``keys``, ``key`` (unique inside the group) and x1..y2; the result
    holds ``keys``, ``pred``, ``gt`` and ``iou``. The threshold must be positive: boxes
    without common area never pair.
    """
    if threshold <= 0:
        raise ValueError("the IoU threshold must be positive")
    sides = ("x1", "y1", "x2", "y2")
    # Both sides are read twice: for the grids in use and for the join.
    left = durable(pred.select(*keys, F.col("key").alias("pred"), *[F.col(c).alias(f"l_{c}") for c in sides]))
    right = durable(gt.select(*keys, F.col("key").alias("gt"), *[F.col(c).alias(f"r_{c}") for c in sides]))
    score = bx.iou(bx.box("l_"), bx.box("r_"))
    pairs = overlap_pairs(left, right, keys, size, score >= F.lit(float(threshold)))
    return pairs.select(*keys, "pred", "gt", score.alias("iou"))


def find_fov(entries: DataFrame, fovs: DataFrame) -> DataFrame:
    """The field of view at the rounded coordinates of each entry, the oldest if several.

    ``entries`` holds slide_name, x, y (whole numbers); the result adds fov_id.
    """
    first = (
        fovs.select(
            "slide_name",
            F.rint("x").cast("bigint").alias("x"),
            F.rint("y").cast("bigint").alias("y"),
            F.struct("created_at", "id").alias("_at"),
        )
        .groupBy("slide_name", "x", "y")
        .agg(F.min("_at").alias("_at"))
    )
    return entries.join(first, ["slide_name", "x", "y"]).select(
        *entries.columns, F.col("_at.id").alias("fov_id")
    )


def nearest_marker(points: DataFrame, markers: DataFrame, radius: float) -> DataFrame:
    """The closest marker of the same slide within ``radius`` of each point.

    ``points`` holds point_id, slide_name, px, py. Ties go to the lesser id. Cells have
    the edge of the radius, so a point's hits lie in its own or a neighbouring cell.
    """
    p = on_cells(
        points,
        F.col("px") - radius,
        F.col("py") - radius,
        F.col("px") + radius,
        F.col("py") + radius,
        radius,
    )
    m = markers.select(
        "slide_name",
        F.col("id").alias("marker_id"),
        "x",
        "y",
        cell(F.col("x"), radius).alias("_cx"),
        cell(F.col("y"), radius).alias("_cy"),
    )
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (
        F.col("y") - F.col("py")
    )
    return (
        p.join(m, ["slide_name", "_cx", "_cy"])
        .withColumn("d2", d2)
        .where(F.col("d2") <= F.lit(float(radius) ** 2))
        .groupBy("slide_name", "point_id")
        .agg(F.min(F.struct("d2", "marker_id")).alias("best"))
        .select("slide_name", "point_id", "best.marker_id", "best.d2")
    )


def fov_annotation_counts(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of ``pairs`` (fov_id, ...) per entry, zero kept."""
    counts = pairs.groupBy("fov_id").agg(F.count("*").alias("n"))
    return entries.join(counts, "fov_id", "left").select(
        *entries.columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
