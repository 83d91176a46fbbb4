"""A detector run over pixels finds the marked cells and is scored on them."""

from pyspark.sql import functions as F

from lamella.operators import evaluation as ev
from lamella.operators import inference as nf
from lamella.operators import spatial as sp
from lamella.plans.inference_queries import load_peaks

BASE = "id string, slide_name string, biomarker string, x double, y double, w double, h double, created_at timestamp"


def tile(channel, bright, ty=0, tx=0, edge=16):
    px = [0] * (edge * edge)
    for x, y, v in bright:
        px[y * edge + x] = v
    return ("s", channel, 0, ty, tx, edge, edge, px)


def fixture(spark):
    tiles = spark.createDataFrame(
        [tile("CD8", [(5, 5, 60000), (12, 3, 50000)]), tile("DAPI", [(1, 1, 7)]), tile("CD8", [(2, 2, 40000)], 0, 1)],
        "slide_name string, channel string, level int, tile_y int, tile_x int, h int, w int, px array<int>",
    )
    fovs = spark.createDataFrame([("f", "s", "CD8", 0.0, 0.0, 20.0, 8.0, None), ("g", "s", "", -3.0, 0.0, 8.0, 8.0, None)], BASE)
    nuclear = spark.createDataFrame([("s", "DAPI")], "slide_name string, channel string")
    return tiles, fovs, nuclear


def test_stacks_are_padded_and_shifted(spark):
    tiles, fovs, nuclear = fixture(spark)
    wanted = spark.createDataFrame([("s", "f", "CD8"), ("s", "g", "CD8"), ("s", "f", "none")], "slide_name string, fov_id string, marker string")
    rows = {(r.fov_id, r.ty, r.tx): r for r in nf.fov_stacks(tiles, fovs, wanted, nuclear, 8, 16).collect()}
    assert set(rows) == {("f", 0, 0), ("f", 0, 8), ("f", 0, 16), ("g", 0, 0)}
    assert all(len(r[b]) == 64 for r in rows.values() for b in ("red", "green", "blue"))
    assert rows["f", 0, 8].red[3 * 8 + 4] == 50000
    # The last tile is four pixels wide and zero beyond them.
    assert rows["f", 0, 16].red[2 * 8 + 2] == 40000 and sum(rows["f", 0, 16].red) == 40000
    assert rows["f", 0, 0].blue[9] == 7 and sum(rows["f", 0, 8].blue) == 0
    # A corner outside the slide reads from its edge; offsets keep the corner.
    assert rows["g", 0, 0].red[5 * 8 + 5] == 60000 and rows["g", 0, 0].ox == -3


def test_evaluate_model(spark):
    tiles, fovs, nuclear = fixture(spark)
    markers = [("a", "s", "CD8", 5.0, 5.0, 4.0, 4.0, None), ("b", "s", "CD8", 12.0, 3.0, 4.0, 4.0, None), ("c", "s", "CD8", 19.0, 7.0, 4.0, 4.0, None), ("d", "s", "CD3", 5.0, 5.0, 4.0, 4.0, None)]
    first = fovs.where("id = 'f'")
    pairs = sp.markers_in_fovs(spark.createDataFrame(markers, BASE), first)
    gt = ev.ground_truth_boxes(pairs, spark.createDataFrame([("s", "/s.czi")], "slide_name string, slide_path string"))
    out = {r.marker: r for r in nf.evaluate_model(gt, tiles, first, nuclear, load_peaks, size=8, edge=16).collect()}
    assert set(out) == {"CD8", "__overall__"}
    # Peaks at (5,5) and (12,3) match; the one at (18,2) does not, nor is (19,7) found.
    assert (out["CD8"].tp, out["CD8"].fp, out["CD8"].fn) == (2, 1, 1)


def test_mixed_scores(spark):
    tiles, fovs, nuclear = fixture(spark)
    wanted = spark.createDataFrame([("s", "f", "CD8")], "slide_name string, fov_id string, marker string")
    stacks = nf.fov_stacks(tiles, fovs, wanted, nuclear, 8, 16)
    assert nf.detect_in_fovs(stacks, load_peaks, score=0.7).select(F.round("x1")).collect() == nf.detect_in_fovs(
        stacks, load_peaks, score=0.7, nms=0
    ).select(F.round("x1")).collect()
