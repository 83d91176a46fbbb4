"""Kernels over batches of tiles give the values of the column forms, and labelled runs those of pixels."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import detection as dt
from lamella.operators import pixel_kernels as pk
from lamella.operators import pixels as px

TILE = "slide_name string, channel string, level int, tile_y int, tile_x int, h int, w int, px array<int>"
SETTINGS = "slide_name string, name string, idx int, visible boolean, r int, g int, b int, min_val double, max_val double"


def random_tiles(seed):
    """Tiles of several sizes and channels, flat ones among them."""
    rng = random.Random(seed)
    rows = []
    for slide in ("a", "b"):
        for ty in range(4):
            h, w = rng.choice([(3, 5), (4, 4), (1, 7)])
            for channel in ("c0", "c1", "c2", "none")[: rng.randint(1, 4)]:
                pixels = [rng.randrange(65536) if rng.random() < 0.9 else 0 for _ in range(h * w)]
                rows.append((slide, channel, 0, ty, 0, h, w, [7] * (h * w) if rng.random() < 0.2 else pixels))
    return rows


def rows_of(df, *arrays):
    keys = [c for c in ("slide_name", "channel", "tile_y") if c in df.columns]
    return sorted((tuple(r[k] for k in keys), *[r[a] for a in arrays]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_composite(spark, seed):
    tiles = spark.createDataFrame(random_tiles(seed), TILE)
    settings = [("a", "c0", 1, True, 255, 10, 0, 0.0, 60000.0), ("a", "c1", 0, True, 3, 200, 90, 500.0, 500.2), ("a", "c2", 2, False, 9, 9, 9, 0.0, 1.0)]
    settings += [("b", "c2", 0, True, 255, 255, 255, 10.0, 30000.0), ("b", "c1", 3, True, 0, 77, 31, 100.0, 65535.0)]
    made = spark.createDataFrame(settings, SETTINGS)
    assert rows_of(pk.composite(tiles, made), *"rgba") == rows_of(px.composite(tiles, made), *"rgba")
    hidden = made.withColumn("visible", F.lit(False))
    assert all(set(r[1]) == {0} for r in rows_of(pk.composite(tiles, hidden), *"rgba"))


def test_normalisations(spark):
    tiles = spark.createDataFrame(random_tiles(3), TILE)
    ranged = tiles.withColumns({"lo": F.lit(100.0) + F.col("tile_y"), "hi": F.lit(40000.0)})
    columns = ranged.withColumn("norm", px.normalize_minmax(F.col("px"), F.col("lo"), F.col("hi")))
    assert rows_of(pk.normalize_minmax(ranged, "lo", "hi"), "norm") == rows_of(columns, "norm")
    assert rows_of(pk.normalize_percentile(tiles), "norm") == rows_of(px.normalize_percentile(tiles), "norm")
    stacks = tiles.select("slide_name", "channel", "tile_y", *[F.transform("px", lambda v, k=k: v + k).alias(b) for k, b in enumerate(px.BANDS)])
    for new, old in (
        (pk.normalize_meanstd(stacks, *px.normalization_values("v1")), px.normalize_meanstd(stacks, *px.normalization_values("v1"))),
        (pk.normalize_scale(stacks), px.normalize_scale(stacks)),
        (pk.normalize_scale(stacks, "none"), px.normalize_scale(stacks, "none")),
    ):
        for a, b in zip(rows_of(new, *px.BANDS), rows_of(old, *px.BANDS), strict=True):
            assert a[0] == b[0] and np.allclose(a[1:][0], b[1:][0], rtol=0, atol=1e-12)


def test_padding_and_null_tiles(spark):
    rows = [*random_tiles(4), ("z", "c0", 0, 9, 0, 2, 2, None)]
    tiles = spark.createDataFrame(rows, TILE)
    some = tiles.where("px IS NOT NULL")
    wanted = some.withColumn("px", px.pad_tile(F.col("px"), F.col("h"), F.col("w"), 9))
    assert rows_of(pk.pad_tiles(some, 9), "px") == rows_of(wanted, "px")
    assert [r.px for r in pk.pad_tiles(tiles, 9).where("slide_name = 'z'").collect()] == [None]
    assert [r.norm for r in pk.normalize_percentile(tiles).where("slide_name = 'z'").collect()] == [None]
    assert pk.normalize_percentile(tiles.where("false")).collect() == []


def test_large_tiles(spark):
    """Positions of 512 x 512 pixels and three channels: at most a tenth of a core-second each."""
    n = 24
    cell = F.transform(F.sequence(F.lit(0), F.lit(512 * 512 - 1)), lambda i: ((i * 7919 + F.col("id") * 31) % 65536).cast("int"))
    tiles = spark.range(3 * n).select(
        F.lit("a").alias("slide_name"), F.concat(F.lit("c"), F.col("id") % 3).alias("channel"), F.lit(0).alias("level"),
        F.floor(F.col("id") / 3).cast("int").alias("tile_y"), F.lit(0).alias("tile_x"), F.lit(512).alias("h"), F.lit(512).alias("w"), cell.alias("px"),
    )
    settings = spark.createDataFrame([("a", f"c{k}", k, True, 80 * k, 255 - 80 * k, 40, 100.0, 60000.0) for k in range(3)], SETTINGS)
    out = pk.composite(tiles, settings).select("tile_y", F.xxhash64("r", "g", "b").alias("x"), F.size("r").alias("n"))
    start = time.time()
    rows = out.collect()
    assert len(rows) == n and {r.n for r in rows} == {512 * 512}
    # Wall time on up to eight cores, the making of the pixels included.
    assert (time.time() - start) < 10


def test_downsampling_steps(spark):
    """Sources picked tile by tile are those of the whole image, for many sizes and factors."""
    rng = random.Random(5)
    for factor in (1.0, 1.3, 2.0, 3.7, 9.5, 60.0):
        w, h, size = rng.randrange(1, 60), rng.randrange(1, 60), 8
        image = [[y * 100 + x for x in range(w)] for y in range(h)]
        tiles = []
        for ty in range(0, h, size):
            for tx in range(0, w, size):
                part = [r[tx : tx + size] for r in image[ty : ty + size]]
                tiles.append(("a", "c", 0, ty // size, tx // size, len(part), len(part[0]), sum(part, [])))
        dims = spark.createDataFrame([("a", w, h)], "slide_name string, width int, height int")
        got = {r.row: r.px for r in px.downsample_nearest(spark.createDataFrame(tiles, TILE), dims, factor, size).collect()}

        def picks(n):
            count = n if factor <= 1 else int(n / factor)
            return [int(v) for v in np.rint(np.linspace(0, n - 1, count))] if count else []

        rows, cols = picks(h), picks(w)
        if cols:
            assert got == {k: [image[y][x] for x in cols] for k, y in enumerate(rows)}
        else:
            assert got == {}


def test_labelled_runs(spark):
    """Overlapping stars painted by score, ties by place, cut at the image's edges."""
    rng = random.Random(7)
    stars = [
        (f"f{k % 2}", k, rng.randrange(5) / 5, rng.uniform(-3, 33), rng.uniform(-3, 33), [rng.uniform(1, 9) for _ in range(16)]) for k in range(40)
    ]
    df = spark.createDataFrame(stars, "g string, idx int, prob double, cy double, cx double, dist array<double>")
    image = {}
    runs = dt.star_runs(df, ["g", "idx", "prob"]).collect()
    for r in sorted(runs, key=lambda r: (r.prob, r.idx)):
        for x in range(max(r.x0, 0), min(r.x1, 29) + 1):
            if 0 <= r.row < 25:
                image[r.g, r.row, x] = r.idx + 1
    got = dt.label_runs(df, "g", 25, 30).collect()
    painted = {(r.g, r.row, x): r.label for r in got for x in range(r.x0, r.x1 + 1)}
    assert painted == image and sum(r.x1 - r.x0 + 1 for r in got) == len(image)
    # Neighbouring runs of one label are one run.
    ends = {(r.g, r.row, r.x1 + 1, r.label) for r in got}
    assert not ends & {(r.g, r.row, r.x0, r.label) for r in got}
    assert {(r.g, r.row, r.col): r.label for r in dt.label_image(df, "g", 25, 30).collect()} == image


def test_labelled_runs_of_crowded_rows(spark):
    """A pixel row of an image is painted from a stream: no value holds all its runs."""
    stars = [("f", k, (k * 37 % 101) / 100, 8.0, float(k * 7 % 90), [4.0 + k % 3] * 16) for k in range(300)]
    df = spark.createDataFrame(stars, "g string, idx int, prob double, cy double, cx double, dist array<double>")
    image = {}
    for r in sorted(dt.star_runs(df, ["g", "idx", "prob"]).collect(), key=lambda r: (r.prob, r.idx)):
        for x in range(max(r.x0, 0), min(r.x1, 89) + 1):
            if 0 <= r.row < 20:
                image[r.row, x] = r.idx + 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        runs = dt.label_runs(df, "g", 20, 90)
        got = runs.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.row, x): r.label for r in got for x in range(r.x0, r.x1 + 1)} == image
    plan = runs._jdf.queryExecution().optimizedPlan().toString()
    gathered = plan.split("MapInArrow")[1]
    assert "collect_list" not in gathered
