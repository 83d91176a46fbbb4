"""Which regions touch, overlap or contain one another, decided edge by edge.

Edges, not whole regions, are dealt to the grid cells they pass through. Two boundaries that
share a point have edges that share a cell. Boundaries that share none leave containment,
and then one point of a ring decides: the parity of the other region's edges on a ray from
it, counted over the edges of one band of rows. So a region of any number of points spreads
over as many tasks as it has cells, and its edges never travel as an array.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.functions import rings as rg
from lamella.operators import fills
from lamella.operators import spatial as sp
from lamella.session import durable

#: Edges of the cells and heights of the bands, in pixels.
CELL = 64.0
#: A cell with more edges is cut in four, unless it is a pixel.
CROWDED = 4096
SMALLEST = 1.0
SIDES = ("x1", "y1", "x2", "y2")


def region_edges(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, id, ring, x1, y1, x2, y2), one per edge of a ring of at least three points."""
    return ring_edges(regions.select(*keys, "id", F.posexplode("rings").alias("ring", "_points")), [*keys, "id", "ring"])


def ring_edges(rings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, x1, y1, x2, y2), one per edge of a ring ``_points`` of at least three points.

    A point finds the next one by its place, so no array of edges is made.
    """
    point = rings.where(F.size("_points") >= 3).select(*keys, "_points", F.posexplode("_points").alias("_k", "_p"))
    after = F.get("_points", F.when(F.col("_k") + 1 < F.size("_points"), F.col("_k") + 1).otherwise(0))
    return point.select(*keys, *[p[c].alias(f"{c}{k}") for k, p in ((1, F.col("_p")), (2, after)) for c in "xy"])


def ring_points(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, id, ring, px, py): the first point of each ring of at least three points."""
    firsts = F.transform("rings", lambda r: F.when(F.size(r) >= 3, F.get(r, 0)))
    rows = regions.select(*keys, "id", F.posexplode(firsts).alias("ring", "_p")).where(F.col("_p").isNotNull())
    return rows.select(*keys, "id", "ring", F.col("_p.x").alias("px"), F.col("_p.y").alias("py"))


def region_boxes(regions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, id, x1, y1, x2, y2): the bounding boxes of regions with points."""
    box = rg.ring_bbox(F.flatten(F.col("rings")))
    return regions.select(*keys, "id", *[c.alias(k) for k, c in box.items()]).where(F.col("x1").isNotNull())


def edge_cells(edges: DataFrame, size: float = CELL) -> DataFrame:
    """``edges`` with a row per cell ``_cx, _cy`` that the edge passes through.

    In each band of rows the edge's stretch of x is widened a little, for its rounding.
    """
    top, bottom = F.least("y1", "y2"), F.greatest("y1", "y2")
    left, right = F.least("x1", "x2"), F.greatest("x1", "x2")
    bands = edges.withColumn("_cy", F.explode(F.sequence(sp.cell(top, size), sp.cell(bottom, size))))
    slope = (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0))

    def at(y: Column) -> Column:
        return F.col("x1") + (y - F.col("y1")) * slope

    a = at(F.greatest(top, F.col("_cy") * F.lit(float(size))))
    b = at(F.least(bottom, (F.col("_cy") + 1) * F.lit(float(size))))
    slack = F.lit(1e-6) * (F.abs(F.col("x1")) + F.abs(F.col("x2")) + 1)
    low = F.coalesce(F.greatest(left, F.least(a, b) - slack), left)
    high = F.coalesce(F.least(right, F.greatest(a, b) + slack), right)
    return bands.withColumn("_cx", F.explode(F.sequence(sp.cell(F.least(low, right), size), sp.cell(F.greatest(high, left), size))))


def points_inside(points: DataFrame, regions: DataFrame, keys: Sequence[str], size: float = CELL) -> DataFrame:
    """The rows of ``points`` (keys, px, py, ...) with each region ``rid`` whose fill holds the point.

    The parity of the region's edges to the right of the point is counted in the point's
    band of rows, only for the regions whose box holds the point. Rows of ``points`` must
    differ from one another.
    """
    named = list(dict.fromkeys([*keys, *points.columns]))
    boxes = region_boxes(regions, keys).withColumnRenamed("id", "rid")
    sides = [F.col(c) for c in SIDES]
    held = F.col("px").between(F.col("x1"), F.col("x2")) & F.col("py").between(F.col("y1"), F.col("y2"))
    near = sp.points_in_boxes(points, "px", "py", boxes, sides, keys).where(held).select(*named, "rid")
    near = near.withColumn("_band", sp.cell(F.col("py"), size))
    edges = region_edges(regions, keys).where("y1 <> y2").select(*keys, F.col("id").alias("rid"), *SIDES)
    bands = F.sequence(sp.cell(F.least("y1", "y2"), size), sp.cell(F.greatest("y1", "y2"), size))
    met = near.join(edges.withColumn("_band", F.explode(bands)), [*keys, "rid", "_band"])
    at = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = ((F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))) & (F.col("px") < at)
    odd = met.where(crossed).groupBy(*named, "rid").agg(F.count("*").alias("_n")).where("_n % 2 = 1")
    return odd.drop("_n")


def crossing_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], residual: Column | None, size: float = CELL) -> DataFrame:
    """Distinct (keys, l_id, r_id) of edges that share a point."""

    def side(edges: DataFrame, p: str) -> DataFrame:
        cells = edge_cells(edges.drop("ring"), size)
        return cells.select(*keys, "_cx", "_cy", *[F.col(c).alias(f"{p}{c}") for c in ("id", *SIDES)])

    def edge(p: str) -> Column:
        return F.struct(*[F.col(f"{p}{c}").alias(c) for c in SIDES])

    meet = rg.edges_meet(edge("l_"), edge("r_"))
    if residual is not None:
        meet = residual & meet
    joined = side(left, "l_").join(side(right, "r_"), [*keys, "_cx", "_cy"])
    return joined.where(meet).select(*keys, "l_id", "r_id").distinct()


def meeting_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], residual: Column | None = None, size: float = CELL
) -> DataFrame:
    """Distinct (keys, l_id, r_id) of regions that touch, overlap or contain one another.

    Both sides hold keys, id and rings; ``residual`` is a condition on l_id and r_id. Larger
    cells spare rows where one side has few edges.
    """
    crossing = crossing_pairs(region_edges(left, keys), region_edges(right, keys), keys, residual, size)
    inner = points_inside(ring_points(left, keys).drop("ring").distinct(), right, keys, size)
    outer = points_inside(ring_points(right, keys).drop("ring").distinct(), left, keys, size)
    held = inner.select(*keys, F.col("id").alias("l_id"), F.col("rid").alias("r_id")).unionByName(
        outer.select(*keys, F.col("rid").alias("l_id"), F.col("id").alias("r_id"))
    )
    if residual is not None:
        held = held.where(residual)
    return crossing.unionByName(held).distinct()


def _crowded_cells(cells: DataFrame, by: Sequence[str], most: int) -> DataFrame:
    return durable(cells.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > most).drop("_n"))


def _in_cells(cells: DataFrame, some: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.join(some, by, "left_semi").withColumnsRenamed({"_cx": "_px", "_cy": "_py"})


def _quarters(inside: DataFrame, size: float) -> DataFrame:
    """The edges of cells of twice the ``size``, each dealt to the cell's own four parts only."""
    own = (F.floor(F.col("_cx") / 2) == F.col("_px")) & (F.floor(F.col("_cy") / 2) == F.col("_py"))
    return edge_cells(inside, size).where(own).drop("_px", "_py")


def sized_cells(edges: DataFrame, keys: Sequence[str], size: float = CELL, most: int = CROWDED) -> list[tuple[DataFrame, float]]:
    """``edges`` on cells of at most ``most`` edges, as (rows, size of their cells).

    Crowded cells are cut in four, and those of their parts that are still crowded again,
    down to single pixels. The driver sees only whether any are left.
    """
    by = [*keys, "_cx", "_cy"]
    cells, done = edge_cells(edges, size), []
    while size > SMALLEST:
        crowded = _crowded_cells(cells, by, most)
        if crowded.isEmpty():
            break
        done.append((cells.join(crowded, by, "left_anti"), size))
        inside = _in_cells(cells, crowded, by)
        size /= 2
        cells = durable(_quarters(inside, size))
    return [*done, (cells, size)]


def spanning_links(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, owner: np.ndarray, at_once: int = 256):
    """Links (a, b) between owners that connect them as all meeting edges do, fewer than owners.

    Blocks of edges are tested against the edges behind them, only between owners that are
    not connected yet.
    """
    n = int(owner.max()) + 1
    label = np.arange(n)
    out: list[np.ndarray] = []
    left, right, top, bottom = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)

    def side(i, px, py):
        return (x2[i] - x1[i]) * (py - y1[i]) - (y2[i] - y1[i]) * (px - x1[i])

    for first in range(0, len(owner), at_once):
        if len(out) == n - 1:
            break
        i = np.arange(first, min(first + at_once, len(owner)))[:, None]
        j = np.arange(first, len(owner))[None, :]
        near = label[owner[i]] != label[owner[j]]
        near &= (right[i] >= left[j]) & (right[j] >= left[i]) & (bottom[i] >= top[j]) & (bottom[j] >= top[i])
        a, b = np.nonzero(near)
        a, b = a + first, b + first
        meet = (side(a, x1[b], y1[b]) * side(a, x2[b], y2[b]) <= 0) & (side(b, x1[a], y1[a]) * side(b, x2[a], y2[a]) <= 0)
        pairs = np.unique(np.sort(label[np.stack([owner[a[meet]], owner[b[meet]]], axis=1)], axis=1), axis=0)
        for p, q in pairs.tolist():
            while label[p] != p:
                p = label[p]
            while label[q] != q:
                q = label[q]
            if p != q:
                label[max(p, q)] = min(p, q)
                out.append(np.array([p, q]))
        while (label[label] != label).any():
            label = label[label]
    return np.array(out, np.int64).reshape(-1, 2)


def ring_links(edges: DataFrame, keys: Sequence[str], size: float = CELL, most: int = CROWDED) -> DataFrame:
    """Links (a, b) of rings, as structs (id, ring), that connect rings as all meeting edges do.

    Every cell hands on a spanning forest of the rings in it, so a crowd of n rings in one
    place gives fewer than n links and not n * n. The edges are shuffled once: the same pass
    names the crowded cells, and only their edges are dealt again.
    """
    by = [*keys, "_cx", "_cy"]
    cells, links = edge_cells(edges, size), None
    while True:
        found = durable(_cell_links(cells, keys, most if size > SMALLEST else None))
        own = found.where(F.col("a").isNotNull()).select("a", "b")
        links = own if links is None else links.unionByName(own)
        crowded = found.where(F.col("a").isNull()).select(*by)
        if size <= SMALLEST or crowded.isEmpty():
            return links
        size /= 2
        cells = durable(_quarters(_in_cells(cells, crowded, by), size))


def _cell_links(cells: DataFrame, keys: Sequence[str], most: int | None) -> DataFrame:
    """Rows (a, b, keys, _cx, _cy): the links of each cell, or its name without links where
    it has more than ``most`` edges."""
    by = [*keys, "_cx", "_cy"]
    # Whole cells follow each other in a task; their hash spares most comparisons of names.
    ordered = cells.select(F.xxhash64(*by).alias("_cell"), *by, "id", "ring", *SIDES).repartition("_cell").sortWithinPartitions("_cell", *by)
    end = F.struct("id", "ring")
    shape = cells.select(end.alias("a"), end.alias("b"), *by).schema
    wanted = to_arrow_schema(T.StructType([T.StructField(f.name, f.dataType) for f in shape]))
    n = len(by) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in fills.whole_groups(batches, n, most):
            stops = np.append(starts[1:], table.num_rows)
            ring, _ = fills.numbers(table, n, 2)
            several = np.minimum.reduceat(ring, starts) < np.maximum.reduceat(ring, starts)
            crowded = stops - starts > (most or table.num_rows)
            sides = [table.column(n + 2 + k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(4)]
            left, right = [], []
            # Most cells hold edges of one ring only, which link nothing.
            for g in np.flatnonzero(several & ~crowded):
                part = slice(starts[g], stops[g])
                _, first, owner = np.unique(ring[part], return_index=True, return_inverse=True)
                a, b = first[spanning_links(*[v[part] for v in sides], owner)].T + starts[g]
                left.append(a)
                right.append(b)
            at = [np.concatenate([*v, np.zeros(0, np.int64)]) for v in (left, right)]
            rings = pa.StructArray.from_arrays([table.column(n + k).combine_chunks() for k in (0, 1)], fields=list(wanted.types[0]))
            ends = [rings.take(pa.array(v)) for v in at]
            full = table.select(range(1, n)).take(pa.array(starts[crowded])).combine_chunks()
            for links, names in ((ends, [pa.nulls(len(at[0]))] * (n - 1)), ([pa.nulls(len(full))] * 2, [c.combine_chunks() for c in full.columns])):
                if len(links[0]):
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip([*links, *names], wanted.types)], schema=wanted)

    return ordered.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in shape]))
