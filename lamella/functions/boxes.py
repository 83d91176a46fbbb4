"""Column expressions on axis-aligned boxes, given as (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half edge of an exported marker box, default sizes, IoU threshold.
EXPORT_HALF = 10
MARKER_SIZE = 10.0
FOV_SIZE = 512.0
COLOR_DEFAULT = 255
IOU_THRESHOLD = 0.3

SIDES = ("x1", "y1", "x2", "y2")
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    """The four box columns ``{prefix}x1{suffix}`` .. ``{prefix}y2{suffix}``."""
    return tuple(F.col(f"{prefix}{n}{suffix}") for n in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def _extent(lo: Column, hi: Column, pad: float) -> Column:
    return F.greatest(F.lit(0.0), hi - lo + F.lit(pad))


def _overlap(a: Box, b: Box, pad: float) -> Column:
    return _extent(F.greatest(a[0], b[0]), F.least(a[2], b[2]), pad) * _extent(
        F.greatest(a[1], b[1]), F.least(a[3], b[3]), pad
    )


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes that share no area."""
    inter = _overlap(a, b, 0.0)
    area = lambda q: _extent(q[0], q[2], 0.0) * _extent(q[1], q[3], 0.0)
    union = area(a) + area(b) - inter
    return F.when(inter <= 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(inter, union), F.lit(0.0)))


def iou_plus1(a: Box, b: Box) -> Column:
    """Intersection over union of boxes that include their last pixel."""
    area = lambda q: (q[2] - q[0] + F.lit(1.0)) * (q[3] - q[1] + F.lit(1.0))
    inter = _overlap(a, b, 1.0)
    return inter / (area(a) + area(b) - inter)


def centre_box(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Box of a centre and its size."""
    return {"x1": x - w / 2, "y1": y - h / 2, "x2": x + w / 2, "y2": y + h / 2}


def export_box(x: Column, y: Column, fov_x: Column, fov_y: Column) -> dict[str, Column]:
    """Integer box of fixed size around a marker, relative to its field of view.

    Halves round to even, as ``rint`` does.
    """
    half = F.lit(EXPORT_HALF)
    return {
        "x1": F.rint(x - half - fov_x).cast("int"),
        "y1": F.rint(y - half - fov_y).cast("int"),
        "x2": F.rint(x + half - fov_x).cast("int"),
        "y2": F.rint(y + half - fov_y).cast("int"),
    }


def from_normalised(cx: Column, cy: Column, w: Column, h: Column, size: float) -> dict[str, Column]:
    """Pixel box of a centre box given as fractions of the tile edge."""
    s = F.lit(float(size))
    return {
        "x1": (cx - w / 2) * s,
        "y1": (cy - h / 2) * s,
        "x2": (cx + w / 2) * s,
        "y2": (cy + h / 2) * s,
    }


def fov_corner(cx: Column, cy: Column, w: Column, h: Column) -> dict[str, Column]:
    """Top-left corner of a field of view drawn around a centre."""
    return {"x": cx - w / 2, "y": cy - h / 2}


def in_rect(x: Column, y: Column, rx: Column, ry: Column, rw: Column, rh: Column) -> Column:
    """Containment that includes all four sides."""
    return x.between(rx, rx + rw) & y.between(ry, ry + rh)
