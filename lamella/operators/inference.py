"""Detectors run over the pixels of fields of view, from tiles to scene boxes and metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.operators import detection as dt
from lamella.operators import evaluation as ev
from lamella.operators import pixel_kernels as pk
from lamella.operators import pixels as px
from lamella.session import durable

TILE_KEY = ["slide_name", "fov_id", "marker", "ty", "tx"]
DETECTIONS = (
    "slide_name string, fov_id string, marker string, ty int, tx int, rank int, "
    "x1 double, y1 double, x2 double, y2 double, score double"
)


def fov_stacks(
    tiles: DataFrame, fovs: DataFrame, wanted: DataFrame, nuclear: DataFrame, size: int = px.TILE, edge: int = px.TILE
) -> DataFrame:
    """Padded three-band model tiles of fields of view.

    ``tiles`` are level-0 pixel tiles of the given ``edge``, ``fovs`` holds slide_name,
    id, x, y, w, h, and ``wanted`` the (slide_name, fov_id, marker) to look at. Markers
    that are no channel of the slide have no tiles. ``nuclear`` holds slide_name and the
    channel of the nuclear stain. Rows hold the tile key, ox, oy and red, green, blue of
    ``size`` x ``size`` pixels.
    """
    grid = px.fov_tiles(fovs.join(wanted.select(F.col("fov_id").alias("id")).distinct(), "id", "left_semi"), size)
    spot = F.concat_ws("/", "fov_id", "ty", "tx")
    grid = grid.withColumn("request_id", spot)
    requests = grid.select(
        "request_id",
        "slide_name",
        F.lit(0).alias("level"),
        (F.greatest("ox", F.lit(0)) + F.col("tx")).alias("x"),
        (F.greatest("oy", F.lit(0)) + F.col("ty")).alias("y"),
        "w",
        "h",
    )
    stain = nuclear.select("slide_name", "channel")
    marked = wanted.select("slide_name", "fov_id", F.col("marker").alias("channel"))
    present = tiles.select("slide_name", "channel").distinct()
    stained = wanted.select("slide_name", "fov_id").distinct().join(stain, "slide_name").select(*marked.columns)
    # Only what is looked at is stitched: the markers of each field of view, and the stain.
    spots = grid.select("request_id", "slide_name", "fov_id")
    asked = marked.unionByName(stained).distinct().join(present, ["slide_name", "channel"], "left_semi")
    channels = spots.join(asked, ["slide_name", "fov_id"]).select("request_id", "slide_name", "channel")
    strips = px.read_region(tiles, requests, channels, edge)
    images = strips.groupBy("request_id", "channel").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("row", "px"))), lambda s: s["px"])).alias("px")
    )
    placed = images.join(grid, "request_id")
    padded = pk.pad_tiles(placed, size).withColumns({"h": F.lit(size), "w": F.lit(size)})
    place = ["slide_name", "fov_id", "ty", "tx", "ox", "oy"]
    stacks = px.stack_rgb16(padded, stain, place).withColumnRenamed("channel", "marker")
    return stacks.join(wanted.select("slide_name", "fov_id", "marker").distinct(), ["slide_name", "fov_id", "marker"], "left_semi")


def detect_in_fovs(
    stacks: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    score: float = 0.5,
    nms: float = 0.5,
) -> DataFrame:
    """Scene boxes of a detector on model tiles, above the score, suppressed per tile.

    The detector returns rows of ``DETECTIONS``, boxes relative to the tile and ``rank``
    their place in its output. The result holds slide_name, fov_id, marker, ``key``
    (tile, then rank), score and the box.
    """
    corner = stacks.select(*TILE_KEY, "ox", "oy")
    raw = dt.threshold(dt.score_tiles(stacks, load, DETECTIONS), score)
    kept = dt.nms_boxes(raw.withColumnRenamed("rank", "key"), nms, TILE_KEY)
    scene = dt.to_scene(kept.join(corner, TILE_KEY))
    return scene.withColumn("key", F.struct("ty", "tx", "key")).drop("ty", "tx", "ox", "oy")


def evaluate_model(
    gt: DataFrame,
    tiles: DataFrame,
    fovs: DataFrame,
    nuclear: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    iou: float = 0.3,
    score: float = 0.5,
    nms: float = 0.5,
    size: int = px.TILE,
    edge: int = px.TILE,
) -> DataFrame:
    """Metrics per marker of a detector against truth boxes.

    ``gt`` holds slide_name, fov_id, marker, key and a box, as ``ground_truth_boxes``
    gives them. Truth whose marker is no channel of the slide, or whose slide has no
    pixels, does not count.
    """
    keys = ["slide_name", "fov_id", "marker"]
    present = tiles.select("slide_name", F.col("channel").alias("marker")).distinct()
    usable = durable(gt.join(present, ["slide_name", "marker"], "left_semi"))
    stacks = fov_stacks(tiles, fovs, usable.select(*keys).distinct(), nuclear, size, edge)
    dets = detect_in_fovs(stacks, load, score, nms)
    return ev.detection_metrics(ev.match_boxes(usable, dets, keys, iou))
