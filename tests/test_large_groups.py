"""The paths for large groups give the same rows as the small ones and as brute force."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.operators import detection as dt
from lamella.operators import evaluation as ev
from lamella.operators import export as ex
from lamella.operators import regions as rn
from lamella.operators import spatial as sp
from lamella.session import numbered, tune
from lamella.sources.derived import Tables

BOX = "g string, key int, score double, x1 double, y1 double, x2 double, y2 double"
FOLDER = "/root/testdata/sf0.001"


def random_boxes(n, seed, groups=3, spread=60):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y, w, h = r.randrange(spread), r.randrange(spread), r.randrange(4, 16), r.randrange(4, 16)
        out.append((f"g{i % groups}", i, r.randrange(10) / 10, float(x), float(y), float(x + w), float(y + h)))
    return out


def iou(a, b, pad):
    w = max(0, min(a[2], b[2]) - max(a[0], b[0]) + pad)
    h = max(0, min(a[3], b[3]) - max(a[1], b[1]) + pad)
    area = lambda q: (q[2] - q[0] + pad) * (q[3] - q[1] + pad)
    return w * h / (area(a) + area(b) - w * h)


def greedy_counts(gt, pred, thr):
    pairs = sorted(
        ((iou(p[3:], g[3:], 0), p[1], g[1]) for p in pred for g in gt if iou(p[3:], g[3:], 0) >= thr), reverse=True
    )
    ps, gs = set(), set()
    for _, p, g in pairs:
        if p not in ps and g not in gs:
            ps.add(p)
            gs.add(g)
    return len(gs), len(pred) - len(ps), len(gt) - len(gs)


@pytest.mark.parametrize("rounds", [2, 0, 5])
def test_matching(spark, monkeypatch, rounds):
    """How much the rounds take and how much the components is the same in the end."""
    monkeypatch.setattr(ev, "ROUNDS", rounds)
    gt, pred = random_boxes(90, 1), random_boxes(100, 2)
    # Copies of one box on both sides, and copies whose IoU ties with other boxes.
    gt += [("g0", 1000 + i, 0.0, 5.0, 5.0, 15.0, 15.0) for i in range(7)]
    pred += [("g0", 1000 + i, 0.0, 5.0, 5.0, 15.0, 15.0) for i in range(9)]
    for k in range(12):
        at = [200.0 + 4 * ((k * 5) % 3), 200.0 + 2 * ((k * 7) % 2)]
        gt.append(("g1", 2000 + (k * 5) % 12, 0.0, at[0], at[1], at[0] + 10, at[1] + 10))
        at = [202.0 + 4 * ((k * 7) % 2), 201.0 + 2 * (k % 2)]
        pred.append(("g1", 2000 + (k * 7) % 12, 0.0, at[0], at[1], at[0] + 10, at[1] + 10))
    out = ev.match_boxes(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX), ["g"], 0.2)
    want = {k: greedy_counts([g for g in gt if g[0] == k], [p for p in pred if p[0] == k], 0.2) for k in ("g0", "g1", "g2")}
    assert {r.g: (r.tp, r.fp, r.fn) for r in out.collect()} == want


@pytest.mark.parametrize("most", [0, 3000, 10**9])
def test_matching_of_small_and_large_groups(spark, monkeypatch, most):
    """Groups matched by themselves, those that are never gathered, and both at once give the same."""
    gt, pred = random_boxes(150, 5), random_boxes(150, 6)
    gt += [("g0", 1000 + i, 0.0, 5.0, 5.0, 15.0, 15.0) for i in range(40)] + [("g9", 1, 0.0, 0.0, 0.0, 1.0, 1.0)]
    pred += [("g0", 1000 + i, 0.0, 5.0, 5.0, 15.0, 15.0) for i in range(30)] + [("g0", 2000, 0.0, None, 5.0, 15.0, 15.0)]
    gathered, real = [], ev.class_matches
    monkeypatch.setattr(ev, "class_matches", lambda *a: gathered.append(sorted(r.g for r in a[0].select("g").distinct().collect())) or real(*a))
    monkeypatch.setattr(ev, "GROUP_PAIRS", most, raising=False)
    got = {r.g: (r.tp, r.fp, r.fn) for r in ev.match_boxes(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX), ["g"], 0.2).collect()}
    assert gathered == {0: [["g0", "g1", "g2"]], 3000: [["g0"]], 10**9: []}[most]
    whole = [p for p in pred if p[3] is not None]
    want = {k: greedy_counts([g for g in gt if g[0] == k], [p for p in whole if p[0] == k], 0.2) for k in ("g0", "g1", "g2", "g9")}
    want["g0"] = (want["g0"][0], want["g0"][1] + 1, want["g0"][2])
    assert got == want


def test_matching_of_copies_and_ties(spark):
    r = random.Random(11)
    gt, pred = [], []
    for case in range(40):
        for rows in (gt, pred):
            for i in r.sample(range(100), 9):
                x, y = float(2 * r.randrange(4)), float(2 * r.randrange(3))
                rows.append((f"g{case}", i, 0.0, x, y, x + 8, y + 8))
    a, b = spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX)
    for thr in (0.05, 0.3, 0.6):
        got = {q.g: (q.tp, q.fp, q.fn) for q in ev.match_boxes(a, b, ["g"], thr).collect()}
        assert got == {k: greedy_counts([g for g in gt if g[0] == k], [p for p in pred if p[0] == k], thr) for k in got}
        assert len(got) == 40


def test_matching_along_a_chain(spark):
    """Rounds do not grow with the length of a chain of contending boxes."""
    n = 300
    gt = [("g", i, 0.0, 14.0 * i, 0.0, 14.0 * i + 10, 10.0) for i in range(n)]
    # Every box leans a little more to the next truth box than the one before it.
    pred = [("g", i, 0.0, 14.0 * i + 5 + i / n, 0.0, 14.0 * i + 19 + i / n, 10.0) for i in range(n)]
    out = ev.match_boxes(spark.createDataFrame(gt, BOX), spark.createDataFrame(pred, BOX), ["g"], 0.05)
    assert tuple(out.first())[1:] == greedy_counts(gt, pred, 0.05)


def test_many_copies_make_few_pairs(spark):
    rows = [("hot", i, 0.0, 5.0, 5.0, 15.0, 15.0) for i in range(5000)]
    a, b = spark.createDataFrame(rows, BOX), spark.createDataFrame(rows[:4000], BOX)
    assert tuple(ev.match_boxes(a, b, ["g"]).first()) == ("hot", 4000, 0, 1000)


@pytest.mark.parametrize("spread", [60, 900])
def test_nms(spark, spread):
    rows = random_boxes(200 if spread == 60 else 2000, 3, spread=spread) + [("g1", 5000 + i, 0.55, 5.0, 5.0, 15.0, 15.0) for i in range(30)]
    kept = dt.nms_boxes(spark.createDataFrame(rows, BOX), 0.15, ["g"])
    want = []
    for k in ("g0", "g1", "g2"):
        mine = []
        for b in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1]), reverse=True):
            if all(iou(m[3:], b[3:], 1) <= 0.15 for m in mine):
                mine.append(b)
        want += [m[1] for m in mine]
    assert sorted(r.key for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("threshold", [0.15, 0.6])
def test_nms_of_a_crowd(spark, threshold):
    """A third of all rows on one spot, copies and near copies, in cells that are cut and then wait."""
    r = random.Random(17)
    rows = random_boxes(600, 5, groups=2, spread=400)
    for k in range(300):
        x, y = 100 + r.randrange(16) / 4, 100 + r.randrange(16) / 4
        rows.append(("g0", 10_000 + k, r.randrange(20) / 20, x, y, x + 9 + r.randrange(3), y + 9))
    want = []
    for g in ("g0", "g1"):
        mine = []
        for b in sorted((q for q in rows if q[0] == g), key=lambda q: (q[2], q[1]), reverse=True):
            if all(iou(m[3:], b[3:], 1) <= threshold for m in mine):
                mine.append(b)
        want += [m[1] for m in mine]
    df = spark.createDataFrame(rows, BOX)
    for crowded in (10_000, 12):
        assert sorted(q.key for q in dt.nms_boxes(df, threshold, ["g"], crowded).collect()) == sorted(want)


def test_cells_are_gathered_up_to_a_bound(spark, monkeypatch):
    """No cell hands more undecided items to one row than the bound, however many lie on one spot."""
    sizes = []
    inner = dt._settle_cells

    def watched(state, by, hit):
        most = state.where("NOT known").groupBy(*by).count().agg(F.max("count")).first()[0]
        sizes.append(most or 0)
        return inner(state, by, hit)

    monkeypatch.setattr(dt, "_settle_cells", watched)
    r = random.Random(18)
    rows = [("g", k, r.random(), 50 + r.random(), 50 + r.random(), 60 + r.random(), 60 + r.random()) for k in range(3000)]
    assert dt.nms_boxes(spark.createDataFrame(rows, BOX), 0.3, ["g"], 100).count() == 1
    # The best item takes all others away before they are gathered.
    assert sizes == [100]


def test_nms_of_odd_boxes(spark):
    """Inverted boxes and boxes with a missing side have a defined result in finite time."""
    rows = [
        ("g", 0, 0.9, 0.0, 0.0, 10.0, 10.0),
        ("g", 1, 0.8, 1.0, 1.0, 10.0, 10.0),
        ("g", 2, 0.7, 300.0, 300.0, 20.0, 20.0),
        ("g", 3, 0.6, None, 0.0, 10.0, 10.0),
        ("g", 4, 0.5, 0.0, float("nan"), 10.0, 10.0),
    ]
    kept = dt.nms_boxes(spark.createDataFrame(rows, BOX), 0.3, ["g"])
    assert sorted(r.key for r in kept.collect()) == [0, 2, 3, 4]


def test_nms_rounds_do_not_grow_with_density(spark, monkeypatch):
    """1,000 disjoint boxes of one cell are settled in one round."""
    rounds = []
    inner = dt._settle_cells
    monkeypatch.setattr(dt, "_settle_cells", lambda *a: rounds.append(1) or inner(*a))
    rows = [("g", i, (i * 7 % 100) / 100, 6.0 * (i % 40), 6.0 * (i // 40), 6.0 * (i % 40) + 3, 6.0 * (i // 40) + 3) for i in range(1000)]
    assert dt.nms_boxes(spark.createDataFrame(rows, BOX), 0.3, ["g"]).count() == 1000
    assert len(rounds) == 1


def test_polygon_nms(spark):
    t = Tables(spark, FOLDER)
    few = dt.nms_polygons(t.star_polygons, 0.1, ["fov_id"]).count()
    assert 0 < few < t.star_polygons.count()


def test_polygon_ids_may_repeat_in_other_groups(spark):
    star = lambda g, i, p, x: (g, i, p, 20.0, x, [6.0] * 8)
    rows = [star("f0", 0, 0.9, 20.0), star("f0", 1, 0.8, 21.0), star("f1", 0, 0.7, 20.0), star("f1", 1, 0.6, 60.0)]
    df = spark.createDataFrame(rows, "g string, id int, prob double, cy double, cx double, dist array<double>")
    kept = dt.nms_polygons(df, 0.3, ["g"])
    assert sorted((r.g, r.id) for r in kept.collect()) == [("f0", 0), ("f1", 0), ("f1", 1)]


def test_numbered(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", (i * 7919) % 101, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(11)
    got = numbered(df, [F.desc("v"), F.col("i").asc()], ["k"], "rn")
    w = Window.partitionBy("k").orderBy(F.desc("v"), "i")
    want = df.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    every = numbered(df, [F.col("i").asc()], (), "rn")
    assert all(r.rn == r.i + 1 for r in every.collect())


def test_cells_do_not_change_joins(spark):
    t = Tables(spark, FOLDER)
    naive = t.markers.alias("m").join(t.fovs.alias("f"), "slide_name").where(
        bx.in_rect(*[F.col(c) for c in ("m.x", "m.y", "f.x", "f.y", "f.w", "f.h")])
    )
    want = sorted((r[0], r[1]) for r in naive.select("m.id", "f.id").collect())
    for size, parts in ((512.0, 1), (37.0, 17), (5000.0, 4)):
        got = sp.markers_in_fovs(t.markers.repartition(parts), t.fovs, size=size)
        assert sorted((r.marker_id, r.fov_id) for r in got.collect()) == want
    a = spark.createDataFrame(random_boxes(80, 5), BOX)
    b = spark.createDataFrame(random_boxes(80, 6), BOX)
    pairs = {s: sorted(map(tuple, sp.iou_join(a, b, ["g"], 0.1, s).collect())) for s in (7.0, 64.0, 1000.0)}
    assert pairs[7.0] == pairs[64.0] == pairs[1000.0] and pairs[7.0]


def test_crowded_line_is_written_box_by_box(spark, tmp_path):
    """A field of view with very many markers is one line of its file, in load order."""
    n = 9000
    markers = spark.range(n).select(
        F.format_string("m%05d", "id").alias("id"), F.lit("s").alias("slide_name"), F.lit("CD8").alias("biomarker"),
        (F.col("id") % 500).cast("double").alias("x"), (F.col("id") % 300).cast("double").alias("y"), (-F.col("id")).alias("created_at"),
    )
    fovs = spark.createDataFrame([("f", "s", "", 0.0, 0.0, 512.0, 512.0, 1)], "id string, slide_name string, biomarker string, x double, y double, w double, h double, created_at int")
    ex.export_box_text(sp.markers_in_fovs(markers, fovs), str(tmp_path))
    lines = (tmp_path / "s_CD8.txt").read_text().split("\n")
    assert len(lines) == 2 and lines[1] == "" and lines[0].startswith("s_0_0: ")
    corner = lambda k: f"{k % 500 - 10},{k % 300 - 10},{k % 500 + 10},{k % 300 + 10}"
    assert lines[0].split(" ")[1:] == [corner(k) for k in reversed(range(n))]


def test_components_of_chains_and_stars(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("s000", f"s{i:03d}") for i in range(1, 60)] + [("s059", "s001")]
    df = spark.createDataFrame(chain + star + [("x", "x")], "a string, b string")
    labels = dict(map(tuple, rn.connected_components(df).collect()))
    assert len(labels) == 61 + 60 and {v for k, v in labels.items() if k[0] == "c"} == {"c000"}
    assert {v for k, v in labels.items() if k[0] == "s"} == {"s000"}


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def test_runs_are_the_pixels_inside(spark):
    r = random.Random(4)
    shapes = {f"r{i}": [[(r.uniform(-5, 45), r.uniform(-5, 45)) for _ in range(n)] for n in (7, 4)] for i in range(6)}
    df = spark.createDataFrame(list(shapes.items()), "id string, rings array<array<struct<x:double,y:double>>>")
    edges = rn.region_edge_rows(df, ["id"])
    runs = rn.rasterize(edges, ["id"]).collect()
    got = {(k.id, k.row, c) for k in runs for c in range(k.x0, k.x1 + 1)}
    want = {(k, y, x) for k, s in shapes.items() for y in range(-8, 50) for x in range(-8, 50) if inside(s, x + 0.5, y + 0.5)}
    assert got == want
    both = rn.rasterize(edges, ["id"]).withColumn("all", F.lit(1)).drop("id")
    union = rn.union_runs(both, ["all"]).collect()
    assert {(u.row, c) for u in union for c in range(u.x0, u.x1 + 1)} == {(y, x) for _, y, x in want}
    left = rn.subtract_runs(rn.rasterize(edges.where("id = 'r0'"), ["id"]), rn.rasterize(edges.where("id = 'r1'"), ["id"]).withColumn("id", F.lit("r0")), ["id"])
    a, b = [{(y, x) for k, y, x in want if k == n} for n in ("r0", "r1")]
    assert {(u.row, c) for u in left.collect() for c in range(u.x0, u.x1 + 1)} == a - b


def test_guessed_sizes_are_not_broadcast(spark, tmp_path):
    """A derived table that looks small in its compressed files is joined by a shuffle until its rows are counted."""
    tune(spark)
    spark.range(300_000).select("id", F.lit(7).alias("k")).write.parquet(str(tmp_path / "t"))
    derived = spark.read.parquet(str(tmp_path / "t")).select("id", F.repeat(F.col("id").cast("string"), 20).alias("name"))
    joined = derived.join(spark.range(10_000_000), "id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert joined.count() == 300_000
    few = spark.range(10).withColumn("name", F.lit("x"))
    assert "BroadcastHashJoin" in few.join(spark.range(10_000_000), "id")._jdf.queryExecution().executedPlan().toString()


def test_shuffled_partitions_stay_small(spark):
    """Partitions follow the amount of rows, not the cluster's default number (8 here)."""
    n = 12_000_000
    rows = tune(spark).range(n).select(F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    counted = rows.repartition("a").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.bit_xor("b"))
    sizes = [r.n for r in counted.collect()]
    assert max(sizes) * 16 < 20 << 20 and sum(sizes) == n
