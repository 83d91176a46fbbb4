"""Detection: scoring tiles, decoding, suppression, star polygons, label images."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.functions import boxes as bx
from lamella.functions.scores import argmax, sigmoid
from lamella.operators import evaluation as ev
from lamella.operators import regions as rn
from lamella.operators.spatial import cell, on_cells
from lamella.session import durable

STAR_GRID = 2
STAR_BORDER = 2

Hit = Callable[[Column, Column], Column]


def score_tiles(
    tiles: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str | T.StructType
) -> DataFrame:
    """Run a detector over tile rows.

    ``load`` makes the detector, once per task; the detector turns a batch of tile rows
    into detection rows of ``schema``.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load()
        for batch in batches:
            yield detect(batch)

    return tiles.mapInPandas(run, schema)


def to_scene(dets: DataFrame) -> DataFrame:
    """Tile-local boxes moved by the corner (ox, oy) and the tile offset (tx, ty)."""
    dx, dy = F.col("ox") + F.col("tx"), F.col("oy") + F.col("ty")
    return dets.withColumns(
        {"x1": F.col("x1") + dx, "y1": F.col("y1") + dy, "x2": F.col("x2") + dx, "y2": F.col("y2") + dy}
    )


def threshold(dets: DataFrame, p: float) -> DataFrame:
    return dets.where(F.col("score") > F.lit(float(p)))


def decode_queries(queries: DataFrame, p: float, size: float = 512.0) -> DataFrame:
    """Pixel boxes and scores of centre boxes (cx, cy, w, h) with class ``logits``."""
    scored = queries.withColumn("score", F.array_max(F.transform("logits", sigmoid)))
    sides = bx.from_normalised(*[F.col(c) for c in ("cx", "cy", "w", "h")], size)
    return threshold(scored, p).drop("logits").withColumns(sides)


# Greedy suppression

#: Edge of a grid cell: most detections of a cell touch no other one.
CELL = 256.0
#: A cell with more items is cut in four, down to the smallest cells; there the items beyond
#: the best so many wait for them.
CROWDED = 1024
SMALLEST = 16.0


def _settle_cells(state: DataFrame, by: Sequence[str], hit: Hit) -> DataFrame:
    """One ordered pass over each cell: (by, key, score, body, n, known, first).

    In descending order an item goes if a settled one suppresses it. Else, if an open one
    does, it stays open, as that one may still go. Else it is settled when it touches this
    cell only or was settled before, and open as the ``first`` of its place when it
    touches other cells too.
    """
    one = F.struct("score", "key", "body", "n", "known", F.lit(False).alias("first"))
    items = F.sort_array(F.collect_list(one), asc=False)
    kind = state.select(F.array(one)).schema[0].dataType
    none = F.array().cast(kind)

    def mark(it: Column, known: Column, first: Column) -> Column:
        return F.struct(it["score"], it["key"], it["body"], it["n"], known.alias("known"), first.alias("first"))

    def step(acc: Column, it: Column) -> Column:
        met = lambda side: F.exists(acc[side], lambda k: hit(k["body"], it["body"]))
        alone = it["known"] | (it["n"] == 1)

        def put(side: str, item: Column) -> Column:
            sides = {"settled": acc["settled"], "open": acc["open"]}
            sides[side] = F.array_append(sides[side], item)
            return F.struct(*[v.alias(k) for k, v in sides.items()])

        return (
            F.when(it["known"], put("settled", it))
            .when(met("settled"), acc)
            .when(met("open"), put("open", mark(it, F.lit(False), F.lit(False))))
            .when(alone, put("settled", mark(it, F.lit(False), F.lit(True))))
            .otherwise(put("open", mark(it, F.lit(False), F.lit(True))))
        )

    done = F.aggregate("items", F.struct(none.alias("settled"), none.alias("open")), step)
    cells = state.groupBy(*by).agg(items.alias("items")).select(*by, done.alias("_done"))
    rows = cells.select(*by, F.explode(F.concat(F.col("_done")["settled"], F.col("_done")["open"])).alias("_row"))
    return rows.select(*by, *[F.col("_row")[c].alias(c) for c in ("key", "score", "body", "n", "known", "first")])


def _best_of_equals(items: DataFrame, keys: Sequence[str], hit: Hit) -> DataFrame:
    """Of items with one body, the first; the others go to it, if a body suppresses itself."""
    best = items.groupBy(*keys, "body", *bx.SIDES).agg(F.max(F.struct("score", "key")).alias("_b"))
    one = best.select(*keys, "body", *bx.SIDES, "_b.score", "_b.key")
    apart = ~F.coalesce(hit(F.col("body"), F.col("body")), F.lit(False))
    return one.where(~apart).select(*items.columns).unionByName(items.where(apart))


def _dealt(items: DataFrame, keys: Sequence[str], hit: Hit, size: float, crowded: int) -> tuple[DataFrame, bool]:
    """Items on cells, with the number ``n`` of each one's cells; and whether some of them wait.

    Crowded cells are cut in four until none is crowded or the smallest size is reached.
    """
    by = [*keys, "_size", "_cx", "_cy"]

    def on(df: DataFrame, size: float) -> DataFrame:
        return on_cells(df, *bx.box(), size).withColumn("_size", F.lit(float(size)))

    def crowds(cells: DataFrame) -> DataFrame:
        return durable(cells.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > crowded).drop("_n"))

    known = F.lit(False).alias("known")
    own = [*by, "score", "key", "body", "n"]
    cells = on(items, size)
    full = crowds(cells)
    if full.isEmpty():
        spread = (cell(F.col("x2"), size) - cell(F.col("x1"), size) + 1) * (cell(F.col("y2"), size) - cell(F.col("y1"), size) + 1)
        return cells.withColumn("n", spread).select(*own, known), False
    cells, done = durable(on(_best_of_equals(items, keys, hit), size)), []
    full = crowds(cells)
    while size > SMALLEST and not full.isEmpty():
        done.append(cells.join(full, by, "left_anti").select(*cells.columns))
        size /= 2
        inside = cells.join(full, by, "left_semi").withColumnsRenamed({"_cx": "_px", "_cy": "_py"}).drop("_size")
        parts = on(inside, size).where((F.floor(F.col("_cx") / 2) == F.col("_px")) & (F.floor(F.col("_cy") / 2) == F.col("_py")))
        cells = durable(parts.select(*done[0].columns))
        full = crowds(cells)
    cells = reduce(DataFrame.unionByName, [*done, cells])
    n = cells.groupBy(*keys, "key").agg(F.count("*").alias("n"))
    return durable(cells.join(n, [*keys, "key"]).select(*own, known)), not full.isEmpty()


def _best_first(state: DataFrame, by: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The settled and the best ``most`` other items of each cell, and those that wait for them."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("key")))
    undecided = state.where("NOT known")
    best = durable(undecided.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank"))
    waiting = undecided.join(best.select(*by, "key"), [*by, "key"], "left_anti").select(*state.columns)
    return best.unionByName(state.where("known")), waiting


def greedy_keep(items: DataFrame, keys: Sequence[str], hit: Hit, size: float = CELL, crowded: int = CROWDED) -> DataFrame:
    """Keys that survive greedy suppression in descending (score, key) order per group.

    ``items`` holds ``keys``, score, key (unique in the group), the bounding box x1..y2
    and a struct ``body``; ``hit(kept, other)`` says from two bodies whether the kept one
    suppresses the other, and is false for boxes that do not touch. The sides of a box may
    come in either order. A box with a missing side touches nothing and stays.

    Items are spread over the grid cells they touch and settled cell by cell, whatever the
    size of their group. An item of several cells is kept once it is the first of its
    place in all of them, and goes once any of them drops it. Only chains of suppression
    that cross cells take further rounds, each with the cells that still hold open items.
    Where items crowd, equal ones become one, cells are cut, and in the smallest cells only
    the best items are gathered: what they suppress is taken away before the next ones are.
    """
    keys = list(keys)
    by = [*keys, "_size", "_cx", "_cy"]
    sides = bx.box()
    bare = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c.cast("double")) for c in sides])
    ordered = items.where(~bare).withColumns(
        {"x1": F.least("x1", "x2"), "x2": F.greatest("x1", "x2"), "y1": F.least("y1", "y2"), "y2": F.greatest("y1", "y2")}
    )
    state, waits = _dealt(ordered, keys, hit, size, crowded)
    found = [items.where(bare).select(*keys, "key")]
    while True:
        active, waiting = _best_first(state, by, crowded) if waits else (state, None)
        settled = _settle_cells(active, by, hit)
        if waiting is not None:
            settled = settled.unionByName(waiting.withColumn("first", F.lit(False)))
        settled = durable(settled)
        wide = settled.where((F.col("n") > 1) & ~F.col("known"))
        votes = wide.groupBy(*keys, "key", "n").agg(F.count("*").alias("_in"), F.sum(F.col("first").cast("int")).alias("_first"))
        verdict = votes.select(
            *keys, "key", (F.col("_in") < F.col("n")).alias("_gone"), (F.col("_first") == F.col("n")).alias("_kept")
        )
        joined = settled.join(verdict, [*keys, "key"], "left").where(~F.coalesce("_gone", F.lit(False)))
        new = (F.col("n") == 1) & F.col("first") | F.coalesce("_kept", F.lit(False))
        joined = durable(joined.select(*by, "score", "key", "body", "n", "known", (new & ~F.col("known")).alias("_new")))
        found.append(joined.where("_new").select(*keys, "key").distinct())
        if waits:
            # Whatever a newly kept item suppresses in its cell need not be gathered any more.
            fresh = joined.where("_new").select(*[F.col(c).alias(f"_{c}") for c in by], F.col("body").alias("_kept"))
            meets = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in by])
            gone = ~F.col("known") & ~F.col("_new") & hit(F.col("_kept"), F.col("body"))
            joined = durable(joined.join(fresh, meets & gone, "left_anti"))
        open_cells = joined.where(~F.col("known") & ~F.col("_new")).select(*by).distinct()
        if open_cells.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rest = joined.join(open_cells, by, "left_semi")
        state = rest.select(*by, "score", "key", "body", "n", (F.col("known") | F.col("_new")).alias("known"))


def nms_boxes(dets: DataFrame, threshold: float, keys: Sequence[str], crowded: int = CROWDED) -> DataFrame:
    """Detections kept by greedy box suppression per group.

    Boxes include their last pixel; a box goes when its IoU with a kept one exceeds the
    threshold. Equal scores: the greater ``key`` first. A threshold of at most 0 keeps all.
    A box with a missing side stays.
    """
    if threshold <= 0:
        return dets
    # Detections are read twice below and may come from a model run.
    dets = durable(dets)
    side = bx.box()
    items = dets.select(*keys, "score", "key", F.struct(*side).alias("body"), "x1", "y1", (F.col("x2") + 1).alias("x2"), (F.col("y2") + 1).alias("y2"))
    sides = lambda b: tuple(b[c] for c in ("x1", "y1", "x2", "y2"))
    kept = greedy_keep(items, keys, lambda a, b: bx.iou_plus1(sides(a), sides(b)) > F.lit(float(threshold)), crowded=crowded)
    return dets.join(kept, [*keys, "key"], "left_semi")


def evaluate_detector(
    gt: DataFrame,
    dets: DataFrame,
    slides: DataFrame,
    channels: DataFrame,
    iou: float = bx.IOU_THRESHOLD,
    score: float = 0.5,
    nms: float = 0.5,
) -> dict[str, DataFrame]:
    """Metrics of a detector on truth boxes, and the slides left out.

    ``gt`` and ``dets`` hold slide_name, fov_id, marker, key and a box; ``dets`` a score
    too. ``slides`` holds slide_name and ``readable``; truth on other slides is skipped
    and those slides are listed. Markers that are no channel of the slide are skipped.
    """
    keys = ["slide_name", "fov_id", "marker"]
    ok = slides.where("readable").select("slide_name")
    names = channels.select("slide_name", F.col("name").alias("marker"))
    usable = durable(gt.join(ok, "slide_name", "left_semi").join(names, ["slide_name", "marker"], "left_semi"))
    groups = usable.select(*keys).distinct()
    kept = nms_boxes(threshold_within(dets, groups, keys, score), nms, keys)
    matches = ev.match_boxes(usable, kept, keys, iou)
    skipped = slides.where(~F.col("readable")).join(gt, "slide_name", "left_semi").select("slide_name").distinct()
    return {"metrics": ev.detection_metrics(matches), "skipped": skipped}


def threshold_within(dets: DataFrame, groups: DataFrame, keys: Sequence[str], p: float) -> DataFrame:
    """Detections above the score in the groups that have truth boxes."""
    return threshold(dets, p).join(groups, list(keys), "left_semi")


# Star-convex polygons


def star_candidates(maps: DataFrame, p: float, grid: int = STAR_GRID, border: int = STAR_BORDER) -> DataFrame:
    """Candidate centres of a score map, away from its border.

    ``maps`` holds id, rows, cols, ``prob`` (row by row) and ``dist``, one ray array per
    pixel. Distances are at least 0.001; centres are in input pixels.
    """
    at = maps.select("id", "rows", "cols", F.posexplode(F.arrays_zip("prob", "dist")).alias("i", "p"))
    r, c = F.floor(F.col("i") / F.col("cols")).cast("int"), (F.col("i") % F.col("cols")).cast("int")
    inner = r.between(border, F.col("rows") - border - 1) & c.between(border, F.col("cols") - border - 1)
    hit = at.where((F.col("p.prob") > F.lit(float(p))) & inner)
    floor = F.transform("p.dist", lambda d: F.greatest(d, F.lit(1e-3)))
    return hit.select(
        "id", F.col("p.prob").alias("prob"), (r * grid).alias("cy"), (c * grid).alias("cx"), floor.alias("dist")
    )


def star_polygon(cy: Column, cx: Column, dist: Column) -> Column:
    """Vertices of ray distances at equal angles, as an array of struct(x, y)."""
    n = F.size(dist)

    def vertex(d: Column, k: Column) -> Column:
        phi = F.lit(2 * math.pi) * k / n
        return F.struct((cx + d * F.cos(phi)).alias("x"), (cy + d * F.sin(phi)).alias("y"))

    return F.transform(dist, vertex)


def star_runs(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel runs of star polygons; whole coordinates are the pixels."""
    rings = F.array(star_polygon(F.col("cy"), F.col("cx"), F.col("dist")))
    edges = rn.region_edge_rows(polygons.select(*keys, rings.alias("rings")), keys)
    return rn.rasterize(edges, keys, centre=0.0)


def _common(a: Column, b: Column) -> Column:
    """Pixels that two run arrays share."""
    per_run = F.transform(
        a,
        lambda r: F.aggregate(
            F.filter(b, lambda s: s["row"] == r["row"]),
            F.lit(0),
            lambda t, s: t + F.greatest(F.lit(0), F.least(r["x1"], s["x1"]) - F.greatest(r["x0"], s["x0"]) + 1),
        ),
    )
    return F.aggregate(per_run, F.lit(0), lambda t, v: t + v)


def nms_polygons(polygons: DataFrame, threshold: float, keys: Sequence[str]) -> DataFrame:
    """Polygons kept by greedy suppression per group, best score first.

    A polygon goes when the pixels it shares with a kept one exceed the threshold as a
    part of the smaller of the two. ``polygons`` holds ``keys``, id (unique in the group),
    prob, cy, cx, dist.
    """
    keys = list(keys)
    own = [*keys, "id"]
    runs = star_runs(polygons, own)
    masks = runs.groupBy(*own).agg(
        F.sort_array(F.collect_list(F.struct("row", "x0", "x1"))).alias("runs"),
        F.sum(F.col("x1") - F.col("x0") + 1).cast("int").alias("area"),
        F.min("row").alias("y1"),
        F.max("row").alias("y2"),
        F.min("x0").alias("x1"),
        F.max("x1").alias("x2"),
    )
    sides = ["x1", "y1", "x2", "y2"]
    # A polygon that covers no pixel overlaps nothing and stays.
    items = polygons.join(masks, own).select(
        *keys, F.col("prob").alias("score"), F.col("id").alias("key"), F.struct("runs", "area", *sides).alias("body"), *sides
    )

    def hit(a: Column, b: Column) -> Column:
        near = (a["x1"] <= b["x2"]) & (b["x1"] <= a["x2"]) & (a["y1"] <= b["y2"]) & (b["y1"] <= a["y2"])
        return near & (_common(a["runs"], b["runs"]) / F.least(a["area"], b["area"]) > F.lit(float(threshold)))

    kept = greedy_keep(items, keys, hit).withColumnRenamed("key", "id").select(*own)
    bare = polygons.select(*own).join(masks.select(*own), own, "left_anti")
    return polygons.join(kept.unionByName(bare), own, "left_semi")


def label_runs(polygons: DataFrame, key: str, rows: int, cols: int, min_prob: float | None = None) -> DataFrame:
    """Labelled runs (key, row, x0, x1, label) of an image; all else is background.

    ``polygons`` holds ``idx``, their place in the given order; the label is idx + 1.
    Where polygons overlap the greater score wins, then the later place. Each pixel row is
    painted by itself, from the least run to the greatest, and read off as runs.
    """
    above = polygons if min_prob is None else polygons.where(F.col("prob") > F.lit(float(min_prob)))
    runs = star_runs(above, [key, "idx", "prob"]).where(F.col("row").between(0, rows - 1))
    x0, x1 = F.greatest("x0", F.lit(0)), F.least("x1", F.lit(cols - 1))
    seen = runs.where(x0 <= x1).select(key, "row", "idx", "prob", x0.alias("x0"), x1.alias("x1"))
    lines = seen.repartition(key, "row").sortWithinPartitions(key, "row", "prob", "idx", "x0", "x1").drop("prob")
    shape = seen.select(key, "row", *[F.col(c).cast("int") for c in ("x0", "x1")], F.lit(0).cast("bigint").alias("label")).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = np.zeros(cols + 2, np.int64)
        now, name = None, None

        def read_off() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
            # The first and last place stay background, so every run has both ends.
            turns = np.flatnonzero(line[1:] != line[:-1])
            label = line[turns[:-1] + 1]
            some = label > 0
            return name, turns[:-1][some], turns[1:][some] - 1, label[some]

        def made(rows: list) -> pa.RecordBatch:
            names = pa.Table.from_batches([r[0] for r in rows]).take(pa.array(np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])))
            columns = [pa.array(np.concatenate([r[k] for r in rows]), t) for k, t in zip((1, 2, 3), arrow.types[2:], strict=True)]
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in names.columns), *columns], schema=arrow)

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            idx, x0, x1 = (batch.column(k).to_pylist() for k in (2, 3, 4))
            ready = []
            for j, at in enumerate(keys):
                if at != now:
                    if now is not None:
                        ready.append(read_off())
                    line[:] = 0
                    now, name = at, batch.slice(j, 1).select([0, 1])
                line[x0[j] + 1 : x1[j] + 2] = idx[j] + 1
            if ready:
                yield made(ready)
        if now is not None:
            yield made([read_off()])

    return lines.mapInArrow(run, shape)


def label_image(polygons: DataFrame, key: str, rows: int, cols: int, min_prob: float | None = None) -> DataFrame:
    """Labelled pixels (key, row, col, label) of an image: the pixels of its ``label_runs``."""
    runs = label_runs(polygons, key, rows, cols, min_prob)
    return runs.select(key, "row", F.explode(F.sequence("x0", "x1")).alias("col"), "label")


def detector_family(inputs: Column, outputs: Column) -> Column:
    """``queries`` for one input and outputs dets and labels, else ``corners``."""
    wanted = F.array(F.lit("dets"), F.lit("labels"))
    found = (F.size(inputs) == 1) & (F.size(F.array_except(wanted, outputs)) == 0)
    return F.when(found, "queries").otherwise("corners")


def attach_classes(instances: DataFrame, classes: DataFrame, key: str, grid: int = STAR_GRID) -> DataFrame:
    """Class probabilities at each instance's grid cell and the best class.

    ``classes`` holds ``key``, gy, gx and ``probs``.
    """
    at = instances.withColumns({"gy": F.floor(F.col("cy") / grid).cast("int"), "gx": F.floor(F.col("cx") / grid).cast("int")})
    return at.join(classes, [key, "gy", "gx"]).drop("gy", "gx").withColumn("class_id", argmax(F.col("probs")))
