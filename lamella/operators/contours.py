"""Outlines of pixel regions: rings on the pixel lattice whose fill is the runs.

The outline of a set of pixels has a horizontal edge wherever a pixel row and the one above
it differ. The ends of the runs of two neighbouring rows, in order, pair up to those edges;
window passes over single pixel rows find them, so no task needs a whole region for it. An
end that both rows share lies on a straight side and is no corner. What is left are the
corners of the outline, and these are gathered per region, as its rings are.

In a column, corners pair up to the vertical edges in the same way. Each corner then has one
horizontal and one vertical edge, and following them closes the rings. Pieces that meet only
at a corner point stay apart: there an outline turns back to its own piece.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

RINGS = "array<array<struct<x:double,y:double>>>"
#: Regions whose outlines are followed in one numpy pass.
REGIONS_AT_ONCE = 1024


def horizontal_edges(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, y, x_from, row_from, x_to, row_to): the horizontal edges of the outlines.

    ``runs`` holds keys, row, x0, x1: disjoint runs that do not touch within a row. An edge
    leads with its pixels on the right hand (y points down). ``row_from`` and ``row_to`` say
    whether the vertical edge at that end lies in the pixel row below ``y`` (1) or above (0).
    """
    by = [*keys, "y"]

    def ends(start: int, below: int):
        x = F.col("x0") if start else F.col("x1") + 1
        return F.struct((F.col("row") + (1 - below)).alias("y"), x.alias("x"), F.lit(start).alias("start"), F.lit(below).alias("below"))

    four = runs.select(*keys, F.explode(F.array(*[ends(s, b) for s in (0, 1) for b in (0, 1)])).alias("e"))
    # Ends of one kind that both rows have in the same place cancel out.
    corner = four.select(*keys, "e.*").repartition(*by).groupBy(*by, "x", "start").agg(
        F.count("*").alias("_n"), F.first("below").alias("below")
    ).where("_n = 1")
    order = Window.partitionBy(*by).orderBy("x", "start")
    paired = corner.withColumns(
        {"_k": F.row_number().over(order), "x2": F.lead("x").over(order), "below2": F.lead("below").over(order)}
    ).where("_k % 2 = 1")
    # The pixels lie below the edge if the lower row starts or the upper row ends on its left.
    under = F.col("start") == F.col("below")
    pick = lambda a, b: F.when(under, F.col(a)).otherwise(F.col(b))
    return paired.select(
        *by,
        pick("x", "x2").alias("x_from"),
        pick("below", "below2").alias("row_from"),
        pick("x2", "x").alias("x_to"),
        pick("below2", "below").alias("row_to"),
    )


def follow(region: np.ndarray, y: np.ndarray, x_from: np.ndarray, row_from: np.ndarray, x_to: np.ndarray, row_to: np.ndarray):
    """The rings of horizontal edges: (order of the edges, ring of each, region of each ring).

    Rings follow each other by region; within one, the ring of the largest area first, then
    by their first edge.
    """
    n = len(region)
    twice = lambda v: np.concatenate([v, v])
    # In each column, the corners in order are the ends of its vertical edges by twos.
    column = np.lexsort((np.concatenate([row_from, row_to]), twice(y), np.concatenate([x_from, x_to]), twice(region)))
    other = np.empty(2 * n, np.int64)
    other[column[0::2]], other[column[1::2]] = column[1::2], column[0::2]
    after = other[n:]
    # Pointer doubling: the least edge of each ring, then each edge's way to that one.
    least, jump = np.arange(n), after.copy()
    while True:
        lower = np.minimum(least, least[jump])
        jump = jump[jump]
        if (lower == least).all():
            break
        least = lower
    way = (least != np.arange(n)).astype(np.int64)
    jump = np.where(way == 0, np.arange(n), after)
    while True:
        farther = way + way[jump]
        if (farther == way).all():
            break
        way, jump = farther, jump[jump]
    heads, ring = np.unique(least, return_inverse=True)
    # Trapezoids over the horizontal edges; the vertical ones add nothing.
    area = np.zeros(len(heads))
    np.add.at(area, ring, (x_to - x_from) * y.astype(float))
    owner = region[heads]
    by_first = np.lexsort((x_from[heads], y[heads], owner))
    position = np.empty(len(heads), np.int64)
    position[by_first] = np.arange(len(heads))
    largest = np.lexsort((position, -np.abs(area), owner))
    first = largest[np.concatenate([[True], owner[largest][1:] != owner[largest][:-1]])] if len(heads) else largest
    position[first] = -1
    rings = np.lexsort((position, owner))
    rank = np.empty(len(heads), np.int64)
    rank[rings] = np.arange(len(heads))
    # The first edge of a ring has nothing left to go; the one behind it has the longest way.
    turn = np.where(way == 0, np.iinfo(np.int64).max, way)
    return np.lexsort((-turn, rank[ring])), rank[ring], owner[rings]


def _outlines(edges: pa.ListArray) -> pa.ListArray:
    """The rings of each list of horizontal edges."""
    start = edges.offsets.to_numpy()
    flat = edges.values.slice(int(start[0]), int(start[-1] - start[0]))
    region = np.repeat(np.arange(len(edges)), np.diff(start))
    y, x_from, row_from, x_to, row_to = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
    order, ring, owner = follow(region, y, x_from, row_from, x_to, row_to)
    points = np.empty((len(order), 2, 2))
    points[:, 0, 0], points[:, 1, 0] = x_from[order], x_to[order]
    points[:, :, 1] = y[order][:, None]
    xy = pa.StructArray.from_arrays([pa.array(points[:, :, k].ravel()) for k in (0, 1)], names=["x", "y"])
    sizes = np.concatenate([[0], np.cumsum(2 * np.bincount(ring, minlength=len(owner)))])
    rings = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), xy)
    counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(edges)))])
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rings)


def outlines(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row (keys, rings) per key of ``runs`` (keys, row, x0, x1).

    The rings have whole coordinates; their even-odd fill on pixel centres is exactly the
    runs. The first ring is the one of the largest area, so that it is the outer ring of a
    region in one piece; the others, by their first corner, are holes and further pieces.
    Runs of a row must be disjoint and must not touch, as ``union_runs`` gives them. A row
    holds one region's corners, as its rings do.
    """
    edge = F.struct("y", "x_from", "row_from", "x_to", "row_to")
    gathered = horizontal_edges(runs, keys).groupBy(*keys).agg(F.collect_list(edge).alias("_edges"))
    return rings_of(gathered.select(*keys, "_edges"))


def rings_of(gathered: DataFrame) -> DataFrame:
    """``gathered`` with the rings of its last column, a list of horizontal edges, in its place."""
    shape = gathered.select(*gathered.columns[:-1]).schema.add("rings", gathered.sparkSession.createDataFrame([], f"r {RINGS}").schema["r"].dataType)
    wanted = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REGIONS_AT_ONCE):
                part = batch.slice(at, REGIONS_AT_ONCE)
                rings = _outlines(part.column(part.num_columns - 1)).cast(wanted.types[-1])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], rings], schema=wanted)

    return gathered.mapInArrow(run, shape)
