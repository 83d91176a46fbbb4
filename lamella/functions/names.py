"""Column expressions on names, paths, units and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings, groups, reader families, micron scale, color patterns.
SLIDE_ENDINGS = (".ome.tif", ".ome.tiff", ".ims", ".czi")
GROUPS = ("train", "test")
DEFAULT_GROUP = "train"
READERS = {
    ".tif": "tiff",
    ".tiff": "tiff",
    ".svs": "tiff",
    ".ndpi": "tiff",
    ".scn": "tiff",
    ".qptiff": "tiff",
    ".ims": "ims",
    ".czi": "czi",
}
MICRONS = {"m": 1e6, "cm": 1e4, "mm": 1e3, "µm": 1.0, "um": 1.0, "nm": 1e-3}
PATTERN_COLORS = [
    ("dapi", (0, 102, 255)),
    ("hoechst", (0, 102, 255)),
    ("fitc", (0, 255, 0)),
    ("gfp", (0, 255, 0)),
    ("cy3", (255, 165, 0)),
    ("tritc", (255, 69, 0)),
    ("cy5", (255, 0, 0)),
    ("alexa647", (255, 0, 0)),
    ("cy7", (255, 0, 255)),
    ("alexa488", (0, 220, 80)),
    ("pe", (255, 100, 0)),
    ("af488", (0, 220, 80)),
    ("af555", (255, 165, 0)),
    ("af647", (255, 0, 0)),
    ("af750", (180, 0, 255)),
]
OTHER_COLORS = [
    (0, 255, 100),
    (255, 255, 0),
    (0, 200, 255),
    (255, 128, 0),
    (200, 0, 255),
    (255, 0, 128),
    (0, 255, 200),
    (128, 255, 0),
    (255, 200, 0),
    (100, 100, 255),
    (0, 128, 128),
    (255, 255, 255),
]
NUCLEAR_STAINS = ("dapi", "hoechst")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last suffix: ``a.ome.tif`` gives ``a.ome``."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def is_slide_file(name: Column) -> Column:
    low = F.lower(name)
    ending = F.lit(False)
    for e in SLIDE_ENDINGS:
        ending = ending | F.endswith(low, F.lit(e))
    return ending & ~F.contains(low, F.lit("mask"))


def classify_group(path: Column, root: str) -> Column:
    """train or test by the shallowest directory of that name below ``root``.

    Unknown paths and paths outside the root are train.
    """
    base = root.rstrip("/") + "/"
    dirs = F.split(F.lower(F.substr(path, F.lit(len(base) + 1))), "/")
    dirs = F.slice(dirs, 1, F.size(dirs) - 1)
    hits = F.filter(dirs, lambda d: d.isin(*GROUPS))
    inside = F.startswith(path, F.lit(base))
    return F.coalesce(F.when(inside, F.get(hits, 0)), F.lit(DEFAULT_GROUP))


def slide_format(path: Column, strict: bool = False) -> Column:
    """Reader family by suffix; an unknown suffix is NULL, or an error when strict."""
    suffix = F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))
    out = F.lit(None).cast("string")
    if strict:
        out = F.raise_error(F.concat(F.lit("unsupported file type: "), suffix)).cast("string")
    by_family: dict[str, list[str]] = {}
    for s, family in READERS.items():
        by_family.setdefault(family, []).append(s)
    for family, suffixes in by_family.items():
        out = F.when(suffix.isin(suffixes), F.lit(family)).otherwise(out)
    return out


def to_microns(value: Column, unit: Column) -> Column:
    scale = F.lit(1.0)
    for name, factor in MICRONS.items():
        scale = F.when(unit == name, F.lit(factor)).otherwise(scale)
    return value * scale


def channel_label(name: Column, idx: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Ch"), idx.cast("string")))


def _rgb(c: tuple[int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", c)])


def channel_color(name: Column, idx: Column) -> Column:
    """Color struct: the first pattern the plain name contains, else the palette."""
    plain = F.translate(F.lower(name), " -_", "")
    picked = F.element_at(F.array(*[_rgb(c) for c in OTHER_COLORS]), (idx % len(OTHER_COLORS) + 1).cast("int"))
    for pattern, color in reversed(PATTERN_COLORS):
        picked = F.when(F.contains(plain, F.lit(pattern)), _rgb(color)).otherwise(picked)
    return picked


def is_nuclear(name: Column) -> Column:
    low = F.lower(name)
    return F.contains(low, F.lit(NUCLEAR_STAINS[0])) | F.contains(low, F.lit(NUCLEAR_STAINS[1]))


def whole(v: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.rint(v).cast("bigint")


def fov_file_name(slide: Column, channel: Column, x: Column, y: Column) -> Column:
    return F.concat_ws("_", slide, channel, whole(x), F.concat(whole(y).cast("string"), F.lit(".png")))


def parse_fov_name(name: Column) -> Column:
    """Struct (slide_name, channel, x, y) of a file name, NULL when it does not match."""
    s = stem(name)
    rx = r"^(.+)_(-?\d+)_(-?\d+)$"
    head = F.regexp_extract(s, rx, 1)
    parts = F.split(head, "_")
    return F.when(
        s.rlike(rx),
        F.struct(
            F.array_join(F.slice(parts, 1, F.size(parts) - 1), "_").alias("slide_name"),
            F.element_at(parts, -1).alias("channel"),
            F.regexp_extract(s, rx, 2).cast("bigint").alias("x"),
            F.regexp_extract(s, rx, 3).cast("bigint").alias("y"),
        ),
    )


def cut_name(name: Column, k: Column) -> Column:
    """The struct (prefix, rest) of a name cut behind the ``k``-th of its parts between underscores."""
    parts = F.split(name, "_")
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), k), "_").alias("prefix"),
        F.array_join(F.slice(parts, k + 1, F.greatest(F.size(parts) - k, F.lit(0))), "_").alias("rest"),
    )


def parse_time(text: Column) -> Column:
    """ISO-8601 text as a UTC timestamp; naive text counts as UTC, other text is NULL."""
    return F.try_to_timestamp(text)


def iso_date_local(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in the session time zone; text that is no date stays."""
    return F.coalesce(F.date_format(parse_time(text), "yyyy-MM-dd HH:mm"), text)


def csv_join(values: Column) -> Column:
    return F.array_join(values, ",")


def csv_split(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))
