"""Regions: assembly, touching pairs, components, pixel runs, merge and subtraction.

Unions and differences are taken on the pixel lattice. A pixel belongs to a region when
its centre does; a region's pixels are stored as runs (row, x0, x1) with both ends
included. Scan lines are half open, so an edge that ends on a line counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lamella.functions import rings as rg
from lamella.functions.names import fov_file_name
from lamella.operators import fills
from lamella.operators import meeting as mt
from lamella.operators import spatial as sp
from lamella.operators.contours import outlines, rings_of
from lamella.session import durable


#: Edge of the cells in which the few edges of cut loops look for those of regions, in pixels.
LOOP_CELL = 256.0


def assemble_regions(points: DataFrame) -> DataFrame:
    """Rings per annotation_id, outer first, points in sequence order.

    One shuffle on the annotation serves both groupings. A row holds one region, as its
    geometry column must.
    """
    p = points.repartition("annotation_id")
    ring = p.groupBy("annotation_id", F.coalesce("ring", F.lit(0)).alias("ring")).agg(
        F.sort_array(F.collect_list(F.struct("seq", F.col("px").alias("x"), F.col("py").alias("y")))).alias("pts")
    )
    plain = ring.withColumn("pts", F.transform("pts", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    both = plain.groupBy("annotation_id").agg(F.sort_array(F.collect_list(F.struct("ring", "pts"))).alias("r"))
    rings = F.transform("r", lambda q: q["pts"])
    no_outer = F.get("r", 0)["ring"] != 0
    blank = F.slice(F.slice(rings, 1, 1), 1, 0)
    blank_ring = F.transform(F.slice(rings, 1, 1), lambda q: F.slice(q, 1, 0))
    return both.select(
        F.col("annotation_id").alias("id"), F.concat(F.when(no_outer, blank_ring).otherwise(blank), rings).alias("rings")
    )


def explode_region_points(regions: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Points of each ring with a sequence number that runs on over the rings.

    ``also`` names columns of the region that its points keep.
    """
    sizes = F.transform("rings", F.size)
    first = F.transform(
        F.sequence(F.lit(1), F.size("rings")),
        lambda k: F.aggregate(F.slice(sizes, F.lit(1), k - 1), F.lit(0), lambda s, v: s + v),
    )
    ring = regions.withColumn("_first", first).select(
        F.col("id").alias("annotation_id"), *also, "_first", F.posexplode("rings").alias("ring", "_pts")
    )
    point = ring.select("annotation_id", *also, "ring", F.get("_first", F.col("ring")).alias("_at"), F.posexplode("_pts").alias("_k", "_p"))
    return point.select(
        "annotation_id", (F.col("_at") + F.col("_k")).alias("seq"), F.col("_p.x").alias("px"), F.col("_p.y").alias("py"), "ring", *also
    )


def region_bboxes(points: DataFrame) -> DataFrame:
    """Bounding box of the outer ring per region_id, straight from the points."""
    outer = points.where(F.coalesce("ring", F.lit(0)) == 0)
    return outer.groupBy(F.col("annotation_id").alias("region_id")).agg(
        F.min("px").alias("x1"), F.min("py").alias("y1"), F.max("px").alias("x2"), F.max("py").alias("y2")
    )


def touching_regions(regions: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of one slide and channel that touch, overlap or contain."""
    keys = ["slide_name", "biomarker"]
    pairs = mt.meeting_pairs(regions, regions, keys, F.col("l_id") < F.col("r_id"))
    return pairs.select(*keys, F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def select_regions_in_rect(regions: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Regions that share a point with the rectangle."""
    sides = [F.lit(float(v)) for v in (x, y, x + w, y + h)]
    rect = rg.edges(rg.rect_ring(*sides))
    box = rg.ring_bbox(F.flatten(F.col("rings")))
    near = (box["x1"] <= x + w) & (box["x2"] >= x) & (box["y1"] <= y + h) & (box["y2"] >= y)
    es = rg.region_edges(F.col("rings"))
    return regions.where(near & (F.size(es) > 0)).where(rg.regions_meet(es, rect))


def points_in_regions(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(point_id, region id) where the point of the slide lies in the region's fill."""
    at = points.select("slide_name", "point_id", "px", "py").distinct()
    inside = mt.points_inside(at, regions, ["slide_name"])
    return inside.select("slide_name", "point_id", F.col("rid").alias("id"))


def hit_test(points: DataFrame, markers: DataFrame, regions: DataFrame, fovs: DataFrame, radius: float) -> DataFrame:
    """What lies under each point: the nearest marker within reach, else the topmost shape.

    Regions lie above fields of view; among the same kind the greatest id is on top.
    """
    near = sp.nearest_marker(points, markers, radius).select("slide_name", "point_id", F.col("marker_id").alias("id"))
    rest = points.join(near, ["slide_name", "point_id"], "left_anti")
    in_region = points_in_regions(rest, regions).withColumn("z", F.lit(9))
    as_marker = rest.select("slide_name", F.col("point_id").alias("id"), F.lit("").alias("biomarker"), F.col("px").alias("x"), F.col("py").alias("y"))
    in_fov = sp.markers_in_fovs(as_marker, fovs).select(
        "slide_name", F.col("marker_id").alias("point_id"), F.col("fov_id").alias("id"), F.lit(8).alias("z")
    )
    top = in_region.unionByName(in_fov).groupBy("slide_name", "point_id").agg(F.max(F.struct("z", "id")).alias("t"))
    return near.unionByName(top.select("slide_name", "point_id", "t.id"))


# Connected components


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of an edge (a, b); the label is the least id reached.

    Alternating star rounds: each joins every node's greater neighbours, then its lesser
    ones, to the least node around it, which shortens paths geometrically. A round needs
    per-node minima (combined before the shuffle) and ends in stored rows, so neither
    the lineage nor any single group grows. It is one job: while its edges are written
    their number and checksum are observed, and a round that changes neither is the last.
    """
    now, seen = _observed(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    while seen[0]:
        before = seen
        now, seen = _observed(_small_star(_large_star(now)))
        if seen == before:
            break
    leaves = now.select(F.col("hi").alias("id"), F.col("lo").alias("label"))
    return leaves.unionByName(now.select(F.col("lo").alias("id"), F.col("lo").alias("label")).distinct())


def _observed(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The stored edges, with their number and a checksum that is observed as they are written."""
    seen = Observation()
    digest = F.xxhash64("lo", "hi")
    total = F.sum(digest.cast("decimal(38,0)"))
    kept = durable(e.observe(seen, F.count("*").alias("n"), F.bit_xor(digest).alias("x"), total.alias("s")))
    got = seen.get
    return kept, (got["n"], got["x"], got["s"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    up = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u")
    return up.select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    linked = e.join(least, "hi").select(F.least("lo", "m").alias("lo"), F.greatest("lo", "m").alias("hi"))
    own = least.select(F.col("m").alias("lo"), "hi")
    return linked.unionByName(own).where("lo <> hi").distinct()


# Pixel runs


def region_edge_rows(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (keys, x1, y1, x2, y2) per edge of each region's rings."""
    return mt.ring_edges(regions.select(*keys, F.explode("rings").alias("_points")), keys)


def rasterize(
    edges: DataFrame,
    keys: Sequence[str],
    frame: bool = False,
    centre: float = 0.5,
    together: Sequence[str] | None = None,
) -> DataFrame:
    """Runs (keys, row, x0, x1) of the even-odd fill of the edges of each key.

    ``centre`` is where a pixel's test point lies in it: 0.5 for its middle, 0 where
    whole coordinates are the pixels themselves. With ``together``, a part of the keys,
    the result is the union (together, row, x0, x1) of the runs of the other keys.

    With ``frame`` the rows hold fov_x, fov_y, fov_w and fov_h; runs are then relative
    to that corner and cut to whole pixels of its size. Edges are dealt to bands of pixel
    rows; sorted crossings of a row pair up to runs there (:mod:`fills`).
    """
    if frame:
        ox, oy = F.col("fov_x"), F.col("fov_y")
        w, h = F.col("fov_w").cast("int"), F.col("fov_h").cast("int")
    else:
        ox = oy = F.lit(0.0)
    half = F.lit(float(centre))
    top, bottom = F.least("y1", "y2") - oy, F.greatest("y1", "y2") - oy
    first, last = F.ceil(top - half), F.ceil(bottom - half) - 1
    if frame:
        first, last = F.greatest(first, F.lit(0)), F.least(last, h - 1)
    sides = [F.col("x1") - ox, F.col("y1") - oy, F.col("x2") - ox, F.col("y2") - oy]
    width = w if frame else F.lit(-1)
    by = list(keys) if together is None else list(together)
    banded = fills.dealt(edges, keys, by, sides, first, last, width, False)
    return fills.filled_runs(banded, by, float(centre), together is not None)


def _sweep(events: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Stretches of each row where ``keep`` holds, over running sums of ``a`` and ``b``.

    ``events`` holds keys, row, x and the steps da, db at x. Neighbouring stretches that
    both qualify are joined.
    """
    by = [*keys, "row"]
    # One shuffle by pixel row serves the grouping and the windows.
    steps = events.repartition(*by).groupBy(*by, "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = Window.partitionBy(*by).orderBy("x")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    state = steps.withColumns({"a": F.sum("da").over(upto), "b": F.sum("db").over(upto)})
    on = state.withColumn("on", keep).withColumn("was", F.lag("on", 1, False).over(order))
    turns = on.where(F.col("on") != F.col("was")).withColumn("_end", F.lead("x").over(order))
    return turns.where("on").select(*by, F.col("x").alias("x0"), (F.col("_end") - 1).cast("int").alias("x1"))


def _events(runs: DataFrame, keys: Sequence[str], da: int, db: int) -> DataFrame:
    start, stop = [
        runs.select(*keys, "row", x.alias("x"), F.lit(s * da).alias("da"), F.lit(s * db).alias("db"))
        for x, s in ((F.col("x0"), 1), (F.col("x1") + 1, -1))
    ]
    return start.unionByName(stop)


def union_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of the runs of each key, as disjoint runs that do not touch.

    A run that starts beyond the furthest end before it opens a new stretch.
    """
    by = [*keys, "row"]
    order = Window.partitionBy(*by).orderBy("x0", "x1")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("x0") > F.max("x1").over(before) + 1, F.lit(True))
    marked = runs.withColumn("_new", fresh.cast("int"))
    stretch = marked.withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return stretch.groupBy(*by, "_s").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_s")


def subtract_runs(runs: DataFrame, holes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of ``runs`` outside ``holes``, per key."""
    events = _events(runs, keys, 1, 0).unionByName(_events(holes, keys, 0, 1))
    return _sweep(events, keys, (F.col("a") > 0) & (F.col("b") <= 0))


def pixel_count(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return runs.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias("pixels"))


FOV = ["slide_name", "biomarker", "fov_id"]


def _framed_edges(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(region_edge_rows(regions.withColumnRenamed("id", "region_id"), ["region_id"]), "region_id")


def region_masks(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs of each region in each field of view of ``pairs``, relative to its corner."""
    return rasterize(_framed_edges(regions, pairs), [*FOV, "region_id"], frame=True)


def export_region_masks(regions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mask runs per slide, channel and field of view: the union of the overlapping regions."""
    return rasterize(_framed_edges(regions, pairs), [*FOV, "region_id"], frame=True, together=FOV)


def mask_files(masks: DataFrame, fovs: DataFrame) -> DataFrame:
    """One row per mask image: file_name, width, height and its runs (row, x0, x1).

    ``masks`` are the runs of ``export_region_masks``; a row holds one field of view's.
    """
    runs = masks.groupBy("slide_name", "biomarker", "fov_id").agg(
        F.sort_array(F.collect_list(F.struct("row", "x0", "x1"))).alias("runs")
    )
    size = fovs.select(
        F.col("id").alias("fov_id"),
        fov_file_name(*[F.col(c) for c in ("slide_name", "biomarker", "x", "y")]).alias("file_name"),
        F.col("w").cast("int").alias("width"),
        F.col("h").cast("int").alias("height"),
    )
    return runs.join(size, "fov_id").select("slide_name", "biomarker", "fov_id", "file_name", "width", "height", "runs")


def component_edges(regions: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the regions of a slide and channel as all touching pairs do.

    Boundaries are connected first, ring by ring and cell by cell, by spanning forests. A
    connected group of boundaries then lies inside another region, or outside of it, as a
    whole, so one point of each group decides on containment: that of a ring which no link
    joins to a lesser one, as every group has. Neither step forms the pairs of a crowd.
    """
    keys = ["slide_name", "biomarker"]
    edges = durable(mt.region_edges(regions, keys))
    links = mt.ring_links(edges, keys)
    later = links.select(F.greatest("a", "b").alias("r")).select("r.id", "r.ring").distinct()
    points = mt.ring_points(regions, keys).join(later, ["id", "ring"], "left_anti")
    inside = mt.points_inside(points, regions, keys).select(F.col("id").alias("a"), F.col("rid").alias("b"))
    return links.select("a.id", F.col("b.id").alias("b")).toDF("a", "b").unionByName(inside).where("a <> b").distinct()


def _union_bands(edges: DataFrame, keys: Sequence[str], together: Sequence[str]) -> DataFrame:
    """The union over ``together`` per band of rows: its pixels, runs and outline corners."""
    half = F.lit(0.5)
    first, last = F.ceil(F.least("y1", "y2") - half), F.ceil(F.greatest("y1", "y2") - half) - 1
    banded = fills.dealt(edges, keys, together, [F.col(c) for c in ("x1", "y1", "x2", "y2")], first, last, F.lit(-1), True)
    return fills.filled_bands(banded, together, 0.5)


def merge_regions(regions: DataFrame) -> dict[str, DataFrame]:
    """Replace touching regions of a channel by their union.

    ``members`` lists (slide_name, biomarker, label, id) of the regions that go;
    ``merged`` holds one row per new region with the attributes of its first member in
    load order (``created_at`` where the regions have it, then the id), the number of
    members, the pixels and the ``rings`` of its outline, whose fill is its mask; ``runs``
    holds the mask. The label is the least member id. Regions that touch none are in none
    of the three.
    """
    regions = durable(regions)
    labels = durable(connected_components(component_edges(regions)))
    joined = regions.join(labels, "id")
    members = joined.select("slide_name", "biomarker", "label", "id")
    bands = durable(_union_bands(region_edge_rows(joined, ["label", "id"]), ["label", "id"], ["label"]))
    runs = bands.select("label", F.explode("runs").alias("_r")).select("label", "_r.*")
    own = [c for c in regions.columns if c not in ("rings", "id")]
    order = F.struct(*[c for c in ("created_at", "id") if c in regions.columns])
    first = joined.groupBy("label").agg(
        F.min_by(F.struct(F.col("id").alias("first_id"), *own), order).alias("_first"), F.count("*").alias("n_members")
    )
    named = first.select("label", *[F.col("_first")[c].alias(c) for c in ("first_id", *own)], "n_members")
    corners = F.sort_array(F.collect_list(F.struct("_band", "corners")))
    drawn = bands.groupBy("label").agg(F.sum("pixels").alias("pixels"), F.flatten(F.transform(corners, lambda b: b["corners"])).alias("_edges"))
    shapes = rings_of(drawn.where("pixels > 0").select("label", "pixels", "_edges"))
    return {"members": members, "merged": named.join(shapes, "label", "left"), "runs": runs}


def merged_regions(regions: DataFrame, merge: dict[str, DataFrame]) -> DataFrame:
    """``regions`` after :func:`merge_regions`: the members replaced by the merged regions.

    A merged region is a region like any other: it can be saved, exported, cut and merged
    again. Its id is derived from the least id of its members; one without a single pixel
    centre has no outline, and its members stay.
    """
    drawn = merge["merged"].where(F.col("rings").isNotNull())
    gone = merge["members"].join(drawn.select("label"), "label", "left_semi").select("id")
    new = drawn.withColumn("id", F.sha2(F.concat(F.lit("merged:"), "label"), 256))
    return regions.join(gone, "id", "left_anti").select(*regions.columns).unionByName(new.select(*regions.columns))


def subtract_loops(regions: DataFrame, loops: DataFrame) -> dict[str, DataFrame]:
    """Cut loops out of the regions of their slide and channel that they meet.

    ``loops`` holds slide_name, biomarker, id and rings, any number per slide and channel.
    The loops of a region count in the order of their ids. A loop that would make what is
    left of its region vanish is passed over; a region all of whose loops are passed over
    stays as it is and has no row in the result: ``counts`` holds (id, before, after),
    ``runs`` the new masks and ``rings`` (id, rings) their outlines.
    """
    keys = ["slide_name", "biomarker"]
    regions = durable(regions)
    pairs = durable(mt.meeting_pairs(regions, loops, keys, size=LOOP_CELL))
    # Both shapes are filled inside the region's own bounding box only.
    x, y = F.floor("x1"), F.floor("y1")
    frame = {"fov_x": x, "fov_y": y, "fov_w": F.ceil("x2") - x, "fov_h": F.ceil("y2") - y}
    boxes = mt.region_boxes(regions, []).select("id", *[c.alias(k) for k, c in frame.items()])
    met = pairs.select(*keys, F.col("l_id").alias("id"), F.col("r_id").alias("loop")).join(boxes, "id")
    shape = regions.select("id", "rings").join(met.select("id", *frame).distinct(), "id")
    cuts = met.join(loops.select(*keys, F.col("id").alias("loop"), "rings"), [*keys, "loop"])
    bands = durable(_cut_bands(shape, cuts, list(frame)))
    sizes = durable(bands.groupBy("id").agg(F.sum("before").cast("bigint").alias("before"), F.sum("after").cast("bigint").alias("after")))
    counts = sizes.where("after > 0")
    # Regions that all their loops together would erase are cut loop by loop.
    erased = durable(sizes.where("before > 0 AND after = 0").select("id"))
    if not erased.isEmpty():
        sets = bands.join(erased, "id", "left_semi").select("id", "sets")
        taken = cuts.join(_loops_in_turn(sets), ["id", "loop"], "left_semi")
        again = durable(_cut_bands(shape.join(taken.select("id").distinct(), "id", "left_semi"), taken.select(*cuts.columns), list(frame)))
        left = again.groupBy("id").agg(F.sum("before").cast("bigint").alias("before"), F.sum("after").cast("bigint").alias("after"))
        counts, bands = counts.unionByName(left), bands.unionByName(again)
    runs = bands.select("id", F.explode("runs").alias("_r")).select("id", "_r.*")
    corners = F.sort_array(F.collect_list(F.struct("_band", "corners")))
    drawn = bands.where(F.size("corners") > 0).groupBy("id").agg(F.flatten(F.transform(corners, lambda b: b["corners"])).alias("_edges"))
    return {"counts": counts, "runs": runs, "rings": rings_of(drawn)}


def _cut_bands(shape: DataFrame, cuts: DataFrame, frame: Sequence[str]) -> DataFrame:
    """Per band of rows what the cuts of each region leave of it: its pixels before and after,
    runs and outline corners. No run goes through a shuffle."""
    at = [F.col(c).cast("int").alias(n) for c, n in (("fov_x", "_x"), ("fov_y", "_y"))]
    own = region_edge_rows(shape.withColumns({"_cut": F.lit(0), "loop": F.lit(None).cast(cuts.schema["loop"].dataType)}), ["id", "_cut", "loop", *frame])
    edges = own.unionByName(region_edge_rows(cuts.withColumn("_cut", F.lit(1)), ["id", "_cut", "loop", *frame])).select("*", *at)
    half, sides = F.lit(0.5), [F.col("x1") - F.col("fov_x"), F.col("y1") - F.col("fov_y"), F.col("x2") - F.col("fov_x"), F.col("y2") - F.col("fov_y")]
    first = F.greatest(F.ceil(F.least("y1", "y2") - F.col("fov_y") - half), F.lit(0))
    last = F.least(F.ceil(F.greatest("y1", "y2") - F.col("fov_y") - half) - 1, F.col("fov_h").cast("int") - 1)
    by = ["id", "_x", "_y"]
    return fills.cut_bands(fills.dealt(edges, [*by, "_cut", "loop"], by, sides, first, last, F.col("fov_w"), True), by, 0.5)


def _loops_in_turn(bands: DataFrame) -> DataFrame:
    """The loops (id, loop) that count when each that would leave nothing is passed over.

    ``bands`` holds the distinct ``sets`` of loops that hold pixels of a region's bands; every
    pixel lies in some loop. What happens to a pixel depends only on its set, so one fold
    per region over its loops, on the distinct sets, tells which ones count.
    """
    one = F.explode(F.transform("sets", lambda s: F.array_sort(s)))
    sets = bands.select("id", one.alias("_set")).distinct().groupBy("id").agg(F.collect_list("_set").alias("sets"))
    kinds = sets.schema["sets"].dataType

    def turn(acc: Column, loop: Column) -> Column:
        rest = F.filter(acc["left"], lambda s: ~F.array_contains(s, loop))
        counts = F.struct(rest.alias("left"), F.array_append(acc["loops"], loop).alias("loops"))
        return F.when(F.size(rest) > 0, counts).otherwise(acc)

    order = F.array_sort(F.array_distinct(F.flatten("sets")))
    start = F.struct(F.col("sets").alias("left"), F.array().cast(kinds.elementType).alias("loops"))
    return sets.select("id", F.explode(F.aggregate(order, start, turn, lambda a: a["loops"])).alias("loop"))


def cut_regions(regions: DataFrame, cut: dict[str, DataFrame]) -> DataFrame:
    """``regions`` after :func:`subtract_loops`: those that were cut have their new rings."""
    new = cut["rings"].withColumnRenamed("rings", "_rings")
    drawn = F.coalesce("_rings", "rings").alias("rings")
    return regions.join(new, "id", "left").select(*[drawn if c == "rings" else c for c in regions.columns])
