"""Pixel work on whole batches of tiles, as numpy calls on the pixel buffers of Arrow lists.

The column forms in ``pixels`` say what each function computes, one pixel at a time; these
give the same values. Spark bounds a batch by its bytes, so a task holds some tens of
megabytes of pixels whatever the size of a tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.operators import pixels as px

#: Pixels of all layers that are composited in one numpy pass.
PIXELS_AT_ONCE = 1 << 21

#: From the flat values of each list column and the sizes of its rows to flat results.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows in a row, and the size of each; a null row has none."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], np.diff(at)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType, nulls: np.ndarray | None = None) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    mask = pa.array(nulls) if nulls is not None and nulls.any() else None
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind.value_type), mask=mask).cast(kind)


def on_tiles(tiles: DataFrame, arrays: Sequence[str], scalars: Sequence[str], outputs: dict[str, T.DataType], kernel: Kernel) -> DataFrame:
    """``tiles`` with the list columns ``outputs`` (name, element type) that ``kernel`` makes.

    The kernel gets the flat values of the columns ``arrays``, which have the same sizes in
    a row, the columns ``scalars`` with a value per pixel, and the sizes. Rows whose first
    array is null have null results. An output may replace a column of ``tiles``.
    """
    first, names = arrays[0], tiles.columns
    kinds = {name: T.ArrayType(kind) for name, kind in outputs.items()}
    fields = [T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in tiles.schema]
    shape = T.StructType(fields + [T.StructField(n, k) for n, k in kinds.items() if n not in names])
    wanted = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dict(zip(names, batch.columns, strict=True))
            flat = {c: _flat(given[c]) for c in arrays}
            sizes = flat[first][1]
            values = {c: v for c, (v, _) in flat.items()}
            values |= {c: np.repeat(given[c].to_numpy(zero_copy_only=False), sizes) for c in scalars}
            nulls = given[first].is_null().to_numpy(zero_copy_only=False)
            made = {n: _lists(v, sizes, wanted.field(n).type, nulls) for n, v in kernel(values, sizes).items()}
            yield pa.RecordBatch.from_arrays([made.get(n, given.get(n)) for n in wanted.names], schema=wanted)

    return tiles.mapInArrow(run, shape)


def normalize_minmax(tiles: DataFrame, low: str, high: str, name: str = "norm") -> DataFrame:
    """Pixels between the columns ``low`` and ``high`` as 0..255, truncated."""

    def kernel(v, sizes):
        span = v[high].astype(float) - v[low] + 1e-6
        return {name: np.clip((v["px"] - v[low].astype(float)) / span * 255.0, 0.0, 255.0).astype(np.int16)}

    return on_tiles(tiles, ["px"], [low, high], {name: T.ShortType()}, kernel)


def _quantile(ordered: np.ndarray, q: float) -> np.ndarray:
    """Quantiles of rows of ordered values with linear interpolation from the nearer end."""
    at = (ordered.shape[1] - 1) * q
    below = int(np.floor(at))
    a, b = ordered[:, below], ordered[:, int(np.ceil(at))]
    part = at - below
    return a + (b - a) * part if part < 0.5 else b - (b - a) * (1.0 - part)


def normalize_percentile(tiles: DataFrame, low: float = 1.0, high: float = 99.8) -> DataFrame:
    """Pixels between two percentiles of their tile as 0..1, as column ``norm``."""

    def kernel(v, sizes):
        pixels = v["px"].astype(float)
        out = np.empty(len(pixels))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for n in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == n)
            place = at[rows][:, None] + np.arange(n)
            some = pixels[place]
            ordered = np.sort(some, axis=1)
            lo, hi = (_quantile(ordered, q / 100)[:, None] for q in (low, high))
            out[place] = np.clip((some - lo) / (hi - lo + 1e-8), 0.0, 1.0)
        return {"norm": out}

    return on_tiles(tiles, ["px"], [], {"norm": T.DoubleType()}, kernel)


def normalize_meanstd(stacks: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """(v - mean) / std for the three band arrays."""
    factors = {b: (float(m), 1.0 / float(s)) for b, m, s in zip(px.BANDS, mean, std, strict=True)}

    def kernel(v, sizes):
        return {b: (v[b] - m) * f for b, (m, f) in factors.items()}

    return on_tiles(stacks, px.BANDS, [], {b: T.DoubleType() for b in px.BANDS}, kernel)


def normalize_scale(stacks: DataFrame, scheme: str = "imagenet", scale: float = float(px.TOP)) -> DataFrame:
    """Bands as 0..1, then the scheme's mean and deviation unless it is ``none``."""
    mean, std = ([0.0] * 3, [1.0] * 3) if scheme == "none" else px.IMAGENET

    def kernel(v, sizes):
        return {b: (v[b] / scale - m) * (1.0 / s) for b, m, s in zip(px.BANDS, mean, std, strict=True)}

    return on_tiles(stacks, px.BANDS, [], {b: T.DoubleType() for b in px.BANDS}, kernel)


def pad_tiles(tiles: DataFrame, size: int = px.TILE) -> DataFrame:
    """``px`` with zeros at the bottom and right up to a square of the given edge.

    ``h`` and ``w``, which the rows hold, stay those of the pixels that were there.
    """
    shape, names = tiles.schema, tiles.columns
    wanted = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dict(zip(names, batch.columns, strict=True))
            values, sizes = _flat(given["px"])
            nulls = given["px"].is_null().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            out = np.zeros((batch.num_rows, size, size), values.dtype)
            for k, (h, w) in enumerate(zip(given["h"].to_pylist(), given["w"].to_pylist(), strict=True)):
                if not nulls[k]:
                    out[k, :h, :w] = values[at[k] : at[k + 1]].reshape(h, w)
            made = _lists(out[~nulls].ravel(), np.where(nulls, 0, size * size), wanted.field("px").type, nulls)
            yield pa.RecordBatch.from_arrays([made if n == "px" else given[n] for n in names], schema=wanted)

    return tiles.mapInArrow(run, shape)


def _blend(layers: pa.ListArray, pixels: np.ndarray) -> list[np.ndarray]:
    """Flat r, g, b of positions of ``pixels`` pixels each, from their lists of layers in order."""
    start, flat = layers.offsets.to_numpy(), layers.values
    field = {flat.type.field(k).name: flat.field(k) for k in range(flat.type.num_fields)}
    values, at = field["px"].values.to_numpy(zero_copy_only=False), field["px"].offsets.to_numpy()
    number = {n: field[n].to_numpy(zero_copy_only=False).astype(float) for n in ("r", "g", "b", "min_val", "max_val")}
    span = np.maximum(number["max_val"] - number["min_val"], 1.0)
    out = [np.zeros(int(pixels.sum())) for _ in range(3)]
    place = np.concatenate([[0], np.cumsum(pixels)])
    depth = np.diff(start)
    for n in np.unique(pixels[depth > 0]).tolist():
        rows = np.flatnonzero((pixels == n) & (depth > 0))
        few = max(1, PIXELS_AT_ONCE // max(1, n))
        for some in (rows[k : k + few] for k in range(0, len(rows), few)):
            spots = place[some][:, None] + np.arange(n)
            # Layer by layer, so that every pixel adds its channels in their order.
            for k in range(int(depth[some].max())):
                has = depth[some] > k
                layer = start[some[has]] + k
                v = values[at[layer][:, None] + np.arange(n)]
                v = np.clip((v - number["min_val"][layer][:, None]) / span[layer][:, None], 0.0, 1.0)
                for total, c in zip(out, "rgb", strict=True):
                    total[spots[has]] += v * (number[c][layer] / 255.0)[:, None]
    return [np.floor(np.clip(v, 0.0, 1.0) * 255.0).astype(np.int16) for v in out]


def composite(tiles: DataFrame, settings: DataFrame) -> DataFrame:
    """RGBA tiles of the visible channels, as ``pixels.composite`` defines them.

    Only the integer pixels of visible channels meet in a position's row; they are scaled
    and added there.
    """
    s = settings.where("visible").select("slide_name", F.col("name").alias("channel"), "idx", "r", "g", "b", "min_val", "max_val")
    place = ["slide_name", "level", "tile_y", "tile_x", "h", "w"]
    layer = F.when(F.col("idx").isNotNull(), F.struct("idx", "r", "g", "b", "min_val", "max_val", "px"))
    stacked = tiles.join(s, ["slide_name", "channel"], "left").groupBy(*place).agg(F.sort_array(F.collect_list(layer)).alias("layers"))
    kind = T.ArrayType(T.ShortType())
    shape = T.StructType([*stacked.schema.fields[: len(place)], *[T.StructField(c, kind) for c in "rgba"]])
    wanted = to_arrow_schema(shape)
    bands = wanted.field("r").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dict(zip([*place, "layers"], batch.columns, strict=True))
            pixels = given["h"].to_numpy().astype(np.int64) * given["w"].to_numpy()
            made = [*_blend(given["layers"], pixels), np.full(int(pixels.sum()), 255, np.int16)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(place)], *[_lists(v, pixels, bands) for v in made]], schema=wanted)

    return stacked.mapInArrow(run, shape)


def thumbnail(tiles: DataFrame, levels: DataFrame, settings: DataFrame) -> DataFrame:
    """Composite of the coarsest level of slides with several levels and a small last one."""
    wanted = px.thumbnail_levels(levels)
    out = composite(tiles.join(wanted.drop("factor"), ["slide_name", "level"]).select(*tiles.columns), settings)
    return out.join(wanted, ["slide_name", "level"])
