"""Column expressions on polygon rings, arrays of struct(x, y).

A region is an array of rings. A point is inside by the even-odd rule over all rings of
at least three points, so rings inside a ring are holes whatever their direction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """Closed ring as an array of struct(x1, y1, x2, y2)."""
    ends = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        ends,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def region_edges(rings: Column) -> Column:
    """Edges of all rings that bound an area."""
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) >= 3), edges))


def ring_area(ring: Column) -> Column:
    """Signed shoelace area."""
    terms = F.transform(edges(ring), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2.0


def clean_rings(rings: Column) -> Column:
    """Drop a repeated closing point, then rings of fewer than three points."""
    closed = lambda r: (F.size(r) >= 2) & (F.element_at(r, 1) == F.element_at(r, -1))
    opened = F.transform(
        rings, lambda r: F.when(F.size(r) < 2, r).when(closed(r), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    )
    return F.filter(opened, lambda r: F.size(r) >= 3)


def split_outer_holes(rings: Column) -> Column:
    """Struct (outer, holes): the ring of the largest area, the first one on ties."""
    areas = F.transform(rings, lambda r: F.abs(ring_area(r)))
    at = F.array_position(areas, F.array_max(areas))
    return F.struct(
        F.get(rings, (at - 1).cast("int")).alias("outer"), F.filter(rings, lambda r, i: i != at - 1).alias("holes")
    )


def _crossings(es: Column, x: Column, y: Column) -> Column:
    def right_of(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return spans & (x < at)

    return F.size(F.filter(es, right_of))


def point_in_edges(es: Column, x: Column, y: Column) -> Column:
    return _crossings(es, x, y) % 2 == 1


def point_in_region(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd containment over all rings."""
    return point_in_edges(region_edges(rings), x, y)


def _near(es: Column, other: Column) -> Column:
    """The edges of ``es`` that meet the bounding box of the edges ``other``."""
    lo = lambda k: F.array_min(F.transform(other, lambda e: F.least(e[f"{k}1"], e[f"{k}2"])))
    hi = lambda k: F.array_max(F.transform(other, lambda e: F.greatest(e[f"{k}1"], e[f"{k}2"])))
    return F.filter(
        es,
        lambda e: (F.greatest(e["x1"], e["x2"]) >= lo("x"))
        & (F.least(e["x1"], e["x2"]) <= hi("x"))
        & (F.greatest(e["y1"], e["y2"]) >= lo("y"))
        & (F.least(e["y1"], e["y2"]) <= hi("y")),
    )


def edges_meet(a: Column, b: Column) -> Column:
    """Whether two edges share a point, ends and collinear overlap included."""

    def side(e: Column, x: Column, y: Column) -> Column:
        return (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])

    def ranges(k: str) -> Column:
        return (F.greatest(a[f"{k}1"], a[f"{k}2"]) >= F.least(b[f"{k}1"], b[f"{k}2"])) & (
            F.greatest(b[f"{k}1"], b[f"{k}2"]) >= F.least(a[f"{k}1"], a[f"{k}2"])
        )

    across = lambda p, q: side(p, q["x1"], q["y1"]) * side(p, q["x2"], q["y2"]) <= 0
    return ranges("x") & ranges("y") & across(a, b) & across(b, a)


def edge_sets_meet(a: Column, b: Column) -> Column:
    """Whether any edge of ``a`` meets any edge of ``b``."""
    return F.exists(_near(a, b), lambda p: F.exists(b, lambda q: edges_meet(p, q)))


def regions_meet(a: Column, b: Column) -> Column:
    """Whether two regions, given as edge arrays, touch, overlap or contain one another.

    Without a common edge point, one must hold a corner of the other inside its fill.
    """
    corner = lambda es: (F.get(es, 0)["x1"], F.get(es, 0)["y1"])
    return edge_sets_meet(a, b) | point_in_edges(b, *corner(a)) | point_in_edges(a, *corner(b))


def ring_bbox(ring: Column) -> dict[str, Column]:
    pick = lambda k: F.transform(ring, lambda p: p[k])
    return {
        "x1": F.array_min(pick("x")),
        "y1": F.array_min(pick("y")),
        "x2": F.array_max(pick("x")),
        "y2": F.array_max(pick("y")),
    }


def rect_ring(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(corner(x1, y1), corner(x2, y1), corner(x2, y2), corner(x1, y2))
