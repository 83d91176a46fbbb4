"""Hand values for matching, scores, geometry, suppression and names."""

import pytest
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.functions import names as nm
from lamella.functions import rings as rg
from lamella.functions import scores as sc
from lamella.operators import annotations as an
from lamella.operators import catalog as ct
from lamella.operators import detection as dt
from lamella.operators import evaluation as ev
from lamella.operators import history as hs
from lamella.operators import pixels as px
from lamella.operators import regions as rn

BOX = "g string, key int, x1 double, y1 double, x2 double, y2 double"


def value(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def lit_box(*v):
    return tuple(F.lit(float(x)) for x in v)


@pytest.mark.parametrize(
    "a, b, want",
    [((3, 4, 19, 12), (3, 4, 19, 12), 1.0), ((-6, 2, 7, 9), (7.5, 2, 30, 9), 0.0), ((2, 1, 14, 9), (8, 5, 20, 21), 24 / 264)],
)
def test_iou(spark, a, b, want):
    assert value(spark, bx.iou(lit_box(*a), lit_box(*b))) == pytest.approx(want)


CASES = [
    ([(1, 2, 17, 12), (40, 8, 52, 30)], [(2, 2, 17, 13), (40, 7, 53, 30)], (2, 0, 0)),
    ([(1, 2, 17, 12), (140, 9, 155, 20)], [(1, 2, 16, 12), (71, 9, 90, 20)], (1, 1, 1)),
    ([(5, 5, 25, 15)], [(21, 5, 41, 15)], (0, 1, 1)),
    ([(6, 6, 18, 20), (6, 6, 18, 20), (6, 7, 18, 20)], [(6, 6, 18, 20)], (1, 0, 2)),
    ([], [(3, 3, 9, 14), (30, 3, 44, 14)], (0, 2, 0)),
    ([(3, 3, 9, 14), (30, 3, 44, 14)], [], (0, 0, 2)),
    # Equal IoU: the later prediction takes the later truth box.
    ([(10, 0, 22, 8), (16, 0, 28, 8)], [(13, 0, 25, 8), (13, 0, 25, 8)], (2, 0, 0)),
]


def test_match_boxes(spark):
    rows = lambda k: [(f"case{i}", j, *map(float, b)) for i, c in enumerate(CASES) for j, b in enumerate(c[k])]
    out = ev.match_boxes(spark.createDataFrame(rows(0), BOX), spark.createDataFrame(rows(1), BOX), ["g"], 0.3)
    assert {r.g: (r.tp, r.fp, r.fn) for r in out.collect()} == {f"case{i}": c[2] for i, c in enumerate(CASES)}


def test_precision_recall_f1(spark):
    prf = lambda *v: tuple(value(spark, *sc.precision_recall_f1(*[F.lit(x) for x in v]).values()))
    assert prf(8, 2, 2) == pytest.approx((0.8, 0.8, 0.8))
    assert prf(0, 0, 5) == (0.0, 0.0, 0.0)


def test_mask_scores(spark):
    a = [[r in (0, 1)] * 4 for r in range(4)]
    b = [[r in (1, 2)] * 4 for r in range(4)]
    rows = [("dice", x, y) for ra, rb in zip(a, b) for x, y in zip(ra, rb)]
    rows += [("empty", False, False)] * 16
    rows += [("acc", x, y) for x, y in zip([True, False, True, False], [True, False, False, False])]
    df = spark.createDataFrame(rows, "k string, gt boolean, pred boolean")
    out = {r.k: r for r in ev.mask_scores(df, ["k"]).collect()}
    assert out["dice"].dice == 0.5 and out["empty"].dice == 1.0 and out["acc"].accuracy == 0.75
    arrays = df.groupBy("k").agg(F.collect_list("gt").alias("gt"), F.collect_list("pred").alias("pred"))
    cols = ev.mask_scores_arrays(F.col("gt"), F.col("pred"))
    for r in arrays.select("k", cols["dice"].alias("dice")).collect():
        assert r.dice == out[r.k].dice
    none = F.array().cast("array<boolean>")
    assert value(spark, *ev.mask_scores_arrays(none, none).values()) == (1.0, 1.0)


def test_metrics(spark):
    rows = [("CD8", 5, 1, 1), ("CD8", 3, 0, 2), ("CD68", 4, 4, 0)]
    out = {r.marker: r for r in ev.detection_metrics(spark.createDataFrame(rows, "marker string, tp int, fp int, fn int")).collect()}
    assert (out["CD8"].tp, out["CD8"].fp, out["CD8"].fn, out["CD8"].n_fovs) == (8, 1, 3, 2)
    o = out["__overall__"]
    assert (o.tp, o.fp, o.fn, o.n_fovs, o.is_overall) == (12, 5, 3, 3, True)


def test_segmentation_overall_weighs_fovs(spark):
    rows = [("A", 1.0, 1.0), ("B", 0.0, 0.0), ("B", 0.0, 0.0), ("B", 0.0, 0.0)]
    out = {r.marker: r for r in ev.segmentation_metrics(spark.createDataFrame(rows, "marker string, dice double, accuracy double")).collect()}
    assert out["__overall__"].mean_dice == 0.25 and out["__overall__"].n_fovs == 4


def _history(spark):
    runs = spark.createDataFrame(
        [(1, "m1", "detection", "2024-01-01", 0.3, 2, ["slideA", "slideB"]), (2, "m2", "segmentation", "2024-01-02", 0.3, 1, ["slideA"])],
        "run_id int, model_name string, task string, created_at string, iou_threshold double, n_slides int, images array<string>",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    counts = spark.createDataFrame([(1, "CD8", 8, 2, 0), (1, "CD68", 4, 0, 1)], "run_id int, marker string, tp int, fp int, fn int")
    scores = spark.createDataFrame([(2, "CD8", 0.8, 0.9), (2, "CD8", 0.6, 0.7)], "run_id int, marker string, dice double, accuracy double")
    metrics = ev.detection_metrics(counts, by=["run_id"]).unionByName(ev.segmentation_metrics(scores, by=["run_id"]), allowMissingColumns=True)
    models = spark.createDataFrame([], "id bigint, name string, model_type string")
    evals = spark.createDataFrame([], "id bigint, model_id bigint")
    return hs.save_evaluations(runs, metrics, models, evals)


def test_history(spark):
    saved = _history(spark)
    recs = hs.evaluation_records(saved["models"], saved["evaluations"], saved["evaluation_metrics"])
    newest, oldest = hs.newest_first(recs).collect()
    assert oldest.markers == ["CD68", "CD8"] and oldest.n_fovs == 2 and oldest.iou_threshold == 0.3
    last = oldest.metrics[-1]
    assert last.is_overall and (last.tp, last.fp, last.fn) == (12, 2, 1)
    assert [m.marker for m in oldest.metrics] == ["CD68", "CD8", "__overall__"]
    assert newest.iou_threshold is None and newest.metrics[0].mean_dice == pytest.approx(0.7) and newest.metrics[0].n_fovs == 2


def test_delete_evaluations(spark):
    saved = _history(spark)
    ids = saved["evaluations"].where("created_at < '2024-01-02'").select("id")
    kept = hs.delete_evaluations(ids, saved["models"], saved["evaluations"], saved["evaluation_metrics"])
    assert [r.name for r in kept["models"].collect()] == ["m2"]
    assert kept["evaluations"].count() == 1 and kept["evaluation_metrics"].count() == 2


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h)), (float(x), float(y + h))]


REGION = "id string, slide_name string, biomarker string, rings array<array<struct<x:double,y:double>>>"


def test_components(spark):
    rows = [("a", "s", "c", [square(0, 0, 10)]), ("b", "s", "c", [square(5, 5, 10)]), ("z", "s", "c", [square(100, 100, 10)])]
    rows += [(f"copy{i}", "s", "c", [square(100, 100, 10)]) for i in range(3)]
    df = spark.createDataFrame(rows, REGION)
    out = rn.merge_regions(df)
    assert {(r.label, r.n_members, r.pixels) for r in out["merged"].collect()} == {("a", 2, 175), ("copy0", 4, 100)}


def test_region_in_hole_does_not_touch(spark):
    ring = [square(0, 0, 100), square(20, 20, 60)]
    rows = [("o", "s", "c", [*ring]), ("in", "s", "c", [square(40, 40, 10)]), ("over", "s", "c", [square(70, 70, 20)])]
    pairs = {(r.a, r.b) for r in rn.touching_regions(spark.createDataFrame(rows, REGION)).collect()}
    assert pairs == {("o", "over")}


def test_hole(spark):
    rows = [("r", "s", "c", [square(0, 0, 100)])]
    loop = [("l", "s", "c", [square(40, 40, 20)])]
    out = rn.subtract_loops(spark.createDataFrame(rows, REGION), spark.createDataFrame(loop, REGION))
    assert out["counts"].first()[1:] == (10000, 9600)
    rings = F.array(*[F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in r]) for r in (square(0, 0, 100), square(40, 40, 20))])
    inside = lambda x, y: value(spark, rg.point_in_region(rings, F.lit(x), F.lit(y)))
    assert not inside(50.0, 50.0) and inside(5.0, 5.0)
    assert value(spark, rg.split_outer_holes(F.reverse(rings))["outer"]) == value(spark, F.get(rings, 0))


def test_vanishing_region_stays(spark):
    rows = [("r", "s", "c", [square(10, 10, 5)])]
    loop = [("l", "s", "c", [square(0, 0, 100)])]
    out = rn.subtract_loops(spark.createDataFrame(rows, REGION), spark.createDataFrame(loop, REGION))
    assert out["counts"].count() == 0


def test_several_loops(spark):
    rows = [("r", "s", "c", [square(0, 0, 100)]), ("gone", "s", "c", [square(200, 0, 10)])]
    cuts = [("a", "s", "c", [square(10, 10, 20)]), ("b", "s", "c", [square(20, 20, 20)])]
    # These two erase the other region together: the first one counts, the second is passed over.
    cuts += [("c", "s", "c", [square(195, 0, 10, 10)]), ("d", "s", "c", [square(203, 0, 10, 10)])]
    out = rn.subtract_loops(spark.createDataFrame(rows, REGION), spark.createDataFrame(cuts, REGION))
    assert {tuple(r) for r in out["counts"].collect()} == {("r", 10000, 9300), ("gone", 100, 50)}


def test_merged_region_has_the_attributes_of_the_first_loaded(spark):
    rows = [("a", "s", "c", [square(0, 0, 10)], 2, "red"), ("b", "s", "c", [square(5, 5, 10)], 1, "blue")]
    df = spark.createDataFrame(rows, REGION + ", created_at int, color string")
    r = rn.merge_regions(df)["merged"].first()
    assert (r.label, r.first_id, r.color, r.n_members, r.pixels) == ("a", "b", "blue", 2, 175)


def test_threshold_and_nms(spark):
    scores = [(0.9,), (0.1,), (0.6,), (0.05,), (0.7,), (0.02,)]
    assert dt.threshold(spark.createDataFrame(scores, "score double"), 0.5).count() == 3
    rows = [("t", 0, 0.9, 0.0, 0.0, 10.0, 10.0), ("t", 1, 0.8, 1.0, 1.0, 11.0, 11.0), ("t", 2, 0.7, 50.0, 50.0, 60.0, 60.0)]
    df = spark.createDataFrame(rows, "t string, key int, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.key for r in dt.nms_boxes(df, 0.5, ["t"]).collect()) == [0, 2]
    assert dt.nms_boxes(df, 0.0, ["t"]).count() == 3


def test_scale(spark):
    assert value(spark, F.lit(65535) / F.lit(float(px.TOP))) == 1.0
    assert px.normalization_values("v1") == px.MEAN_STD["v1"]
    assert px.normalization_values("v1", depth16=False) == px.MEAN_STD["v0"]
    assert px.normalization_values("other") == px.MEAN_STD["v2"]
    assert px.normalization_values("v0", mean=[1, 2, 3], std=[4, 5, 6]) == ([1, 2, 3], [4, 5, 6])


def test_rounding_is_half_even(spark):
    cols = bx.export_box(F.lit(10.5), F.lit(11.5), F.lit(0.0), F.lit(0.0))
    assert value(spark, *cols.values()) == (0, 2, 20, 22)
    assert value(spark, F.bround(F.lit(0.125), 2), F.bround(F.lit(0.375), 2)) == (0.12, 0.38)


def test_inclusive_edges_and_two_fovs(spark):
    from lamella.operators.spatial import markers_in_fovs

    base = "id string, slide_name string, biomarker string, x double, y double, w double, h double, created_at timestamp"
    m = spark.createDataFrame([("m", "s", "c", 512.0, 0.0, 10.0, 10.0, None), ("n", "s", "c", 512.1, 600.0, 10.0, 10.0, None)], base)
    f = spark.createDataFrame([("f", "s", "c", 0.0, 0.0, 512.0, 512.0, None), ("g", "s", "d", 512.0, -512.0, 512.0, 512.0, None)], base)
    assert sorted((r.marker_id, r.fov_id) for r in markers_in_fovs(m, f).collect()) == [("m", "f"), ("m", "g")]
    assert [r.fov_id for r in markers_in_fovs(m, f, same_channel=True).collect()] == ["f"]


def test_names(spark):
    g = lambda p: value(spark, nm.classify_group(F.lit(p), "/d"))
    assert [g(p) for p in ("/d/test/Train/a.czi", "/d/Train/test/a.czi", "/d/x/a.czi", "/e/test/a.czi", "/d/test", None)] == [
        "test", "train", "train", "train", "train", "train"
    ]
    s = lambda n: value(spark, nm.stem(F.lit(n)))
    assert [s("a.ome.tif"), s("a"), s(".hidden"), s("a.")] == ["a.ome", "a", ".hidden", "a."]
    p = lambda n: value(spark, nm.parse_fov_name(F.lit(n)))
    assert tuple(p("my_slide_CD8_-5_20.png")) == ("my_slide", "CD8", -5, 20)
    assert tuple(p("CD8_5_20.png")) == ("", "CD8", 5, 20)
    assert p("nothing.png") is None
    ok = lambda n: value(spark, nm.is_slide_file(F.lit(n)))
    assert ok("A.OME.TIFF") and ok("b.czi") and not ok("a_Mask.ims") and not ok("a.tif")
    color = lambda n, i=0: tuple(value(spark, nm.channel_color(F.lit(n), F.lit(i))))
    assert color("Alexa 488") == (0, 220, 80) and color("x", 13) == (255, 255, 0)
    assert value(spark, nm.slide_format(F.lit("/a/b.QPTIFF"))) == "tiff"
    with pytest.raises(Exception, match="unsupported file type"):
        value(spark, nm.slide_format(F.lit("/a/b.jpg"), strict=True))
    assert value(spark, nm.iso_date_local(F.lit("2024-05-01T10:20:30+02:00"))) == "2024-05-01 08:20"
    assert value(spark, nm.iso_date_local(F.lit("soon"))) == "soon"
    assert value(spark, nm.csv_split(F.lit(""))) == [] and value(spark, nm.csv_split(F.lit("a,b"))) == ["a", "b"]


def test_load_defaults(spark):
    rows = [("m", "cell_marker", 0.0, None, 0, 7), ("f", "fov", None, 0.0, None, 0), ("r", "region", None, None, 5, 5), ("u", "other", 1.0, 1.0, 1, 1)]
    df = spark.createDataFrame(rows, "id string, type string, w double, h double, color_r int, color_g int")
    out = {r.id: tuple(r)[2:] for r in an.with_load_defaults(df).collect()}
    assert out == {"m": (10.0, 10.0, 255, 7), "f": (512.0, 512.0, 255, 255), "r": (None, None, 5, 5)}


def test_ome_metadata(spark):
    xml = (
        '<OME xmlns="http://www.openmicroscopy.org/Schemas/OME/2016-06"><Instrument><Objective NominalMagnification="20"/></Instrument>'
        '<Image><Pixels SizeC="2" PhysicalSizeX="250" PhysicalSizeXUnit="nm" PhysicalSizeY="0.5"><Channel Name="DAPI"/><Channel/></Pixels></Image></OME>'
    )
    r = ct.ome_metadata(spark.createDataFrame([(xml,), ("<broken",)], "xml string"), "xml").drop("xml").collect()
    assert tuple(r[0]) == (2, 0.25, 0.5, ["DAPI", ""], 20.0)
    assert tuple(r[1]) == (0, 0.0, 0.0, [], 0.0)


def test_flat_tiles(spark):
    rows = [("zero", [0, 0, 0, 0]), ("flat", [65500, 65500, 65500, 65500])]
    df = spark.createDataFrame(rows, "k string, px array<int>")
    assert {tuple(r) for r in px.auto_range(df, ["k"]).collect()} == {("zero", 0, 65535), ("flat", 65500, 65535)}
    assert {tuple(r) for r in px.slider_bounds(df, ["k"]).collect()} == {("zero", 65535), ("flat", 65535)}


def test_labels_sequential(spark):
    ok = lambda v: value(spark, sc.labels_sequential(F.array(*[F.lit(x) for x in v])))
    assert ok([0, 1, 2]) and ok([1, 2]) and ok([0, 0]) and not ok([0, 2]) and not ok([1, 3, 0])


def test_best_pow2(spark):
    best = lambda f, n: tuple(value(spark, ct.best_pow2_level(F.lit(f), F.lit(n))))
    assert best(5, 10) == (2, 4) and best(100, 3) == (2, 4) and best(1, 4) == (0, 1)
