"""Outlines of pixel sets: their fill is the set, and simple shapes have the rings one would draw."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.operators import contours as ct
from lamella.operators import regions as rn


def runs_of(pixels):
    out = []
    for x, y in sorted(pixels, key=lambda p: (p[1], p[0])):
        if out and out[-1][0] == y and out[-1][2] == x - 1:
            out[-1][2] = x
        else:
            out.append([y, x, x])
    return out


def outlines(spark, shapes):
    rows = [(k, *r) for k, pixels in shapes.items() for r in runs_of(pixels)]
    runs = spark.createDataFrame(rows, "id string, row int, x0 int, x1 int")
    return runs, ct.outlines(runs, ["id"])


def as_pairs(rings):
    return [[(p.x, p.y) for p in ring] for ring in rings]


def test_simple_shapes(spark):
    square = {(x, y) for x in range(2, 5) for y in range(10, 14)}
    frame = {(x, y) for x in range(9) for y in range(9) if not (3 <= x < 6 and 2 <= y < 5)}
    shapes = {
        "square": square,
        "frame": frame,
        "pieces": {(0, 0), (5, 5), (6, 5)},
        "corner": {(0, 0), (1, 1)},
        "negative": {(-3, -2), (-2, -2)},
    }
    _, got = outlines(spark, shapes)
    rings = {r.id: as_pairs(r.rings) for r in got.collect()}
    assert rings["square"] == [[(2, 10), (5, 10), (5, 14), (2, 14)]]
    assert rings["negative"] == [[(-3, -2), (-1, -2), (-1, -1), (-3, -1)]]
    outer, hole = rings["frame"]
    assert outer == [(0, 0), (9, 0), (9, 9), (0, 9)] and sorted(hole) == [(3, 2), (3, 5), (6, 2), (6, 5)]
    # The larger piece first; pieces that meet at a point are rings of their own.
    assert rings["pieces"][0] == [(5, 5), (7, 5), (7, 6), (5, 6)] and len(rings["pieces"]) == 2
    assert rings["corner"] == [[(0, 0), (1, 0), (1, 1), (0, 1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]


def test_rings_are_closed_walks(spark):
    """Steps alternate between horizontal and vertical, and no ring visits an edge twice."""
    rng = random.Random(3)
    shapes = {str(k): {(rng.randrange(14), rng.randrange(14)) for _ in range(rng.randrange(1, 150))} for k in range(80)}
    _, got = outlines(spark, shapes)
    for r in got.collect():
        area = 0
        for ring in as_pairs(r.rings):
            steps = list(zip(ring, [*ring[1:], ring[0]]))
            assert all((a[1] == b[1]) if k % 2 == 0 else (a[0] == b[0]) for k, (a, b) in enumerate(steps))
            assert all(a != b for a, b in steps) and len(set(steps)) == len(steps)
            area += sum(a[0] * b[1] - a[1] * b[0] for a, b in steps) / 2
        # Outer rings count positive, holes negative.
        assert area == len(shapes[r.id])


@pytest.mark.parametrize("seed", [1, 2])
def test_fill_is_the_runs(spark, seed):
    rng = random.Random(seed)
    shapes = {}
    for k in range(60):
        size, share = rng.randrange(1, 40), rng.random()
        shapes[str(k)] = {(x, y) for x in range(size) for y in range(size) if rng.random() < share} or {(0, 0)}
    runs, got = outlines(spark, shapes)
    filled = rn.union_runs(rn.rasterize(rn.region_edge_rows(got, ["id"]), ["id"]), ["id"])
    order = lambda df: sorted(map(tuple, df.select("id", "row", "x0", "x1").collect()))
    assert order(filled) == order(runs)


def test_long_outline(spark):
    """A comb and a spiral: thousands of corners in one ring."""
    comb = {(x, y) for x in range(2001) for y in range(3) if y == 0 or x % 2 == 0}
    spiral, x, y, dx, dy, reach = set(), 0, 0, 1, 0, 2
    for _ in range(80):
        for _ in range(reach):
            spiral.add((x, y))
            x, y = x + dx, y + dy
        dx, dy, reach = -dy, dx, reach + 1
    runs, got = outlines(spark, {"comb": comb, "spiral": spiral})
    rings = {r.id: as_pairs(r.rings) for r in got.collect()}
    assert len(rings["comb"]) == 1 and len(rings["comb"][0]) == 4 * 1001
    filled = rn.pixel_count(rn.rasterize(rn.region_edge_rows(got, ["id"]), ["id"]), ["id"])
    assert {r.id: r.pixels for r in filled.collect()} == {"comb": len(comb), "spiral": len(spiral)}


def test_no_region_goes_through_a_window(spark):
    """The windows run over single pixel rows, and only corners are gathered."""
    runs, got = outlines(spark, {"a": {(0, 0)}})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "[id" in plan and ", y#" in plan.split("Window")[1].split("\n")[0]
    assert got.where("false").collect() == [] and ct.outlines(runs.where("false"), ["id"]).collect() == []


def test_bands_of_a_union(spark, monkeypatch):
    """Shapes over many bands: runs and outlines as from one pass over single rows, in one shuffle of edges."""
    r = random.Random(7)
    shapes = [(f"r{i}", "ab"[i % 2], [[(r.uniform(-90, 400), r.uniform(-700, 900)) for _ in range(n)] for n in (9, 5)]) for i in range(6)]
    shapes.append(("r6", "c", [[(0.0, 0.0), (40.0, 0.0), (40.0, 256.0), (0.0, 256.0)]]))
    df = spark.createDataFrame(shapes, "id string, label string, rings array<array<struct<x:double,y:double>>>")
    edges = rn.region_edge_rows(df, ["label", "id"])
    own = rn.rasterize(edges, ["label", "id"])
    assert "Window" not in own._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, rn.union_runs(own.drop("id"), ["label"]).collect()))
    got = rn.rasterize(edges, ["label", "id"], together=["label"])
    assert sorted(map(tuple, got.collect())) == want
    bands = rn._union_bands(edges, ["label", "id"], ["label"])
    assert sorted(map(tuple, bands.select("label", F.explode("runs").alias("r")).select("label", "r.*").collect())) == want
    drawn = bands.groupBy("label").agg(F.flatten(F.collect_list("corners")).alias("e"))
    filled = rn.rasterize(rn.region_edge_rows(ct.rings_of(drawn), ["label"]), ["label"])
    assert sorted(map(tuple, filled.collect())) == want
    dealt = rn.fills.dealt(edges, ["label", "id"], ["label"], [F.col(c) for c in ("x1", "y1", "x2", "y2")], F.ceil(F.least("y1", "y2") - 0.5), F.ceil(F.greatest("y1", "y2") - 0.5) - 1, F.lit(-1), False)
    table = dealt.coalesce(1).sortWithinPartitions("label", "_band").toArrow()
    starts = rn.fills._groups(table, 2)
    parts = []
    for most in (10**9, 300):
        monkeypatch.setattr(rn.fills, "CROSSINGS", most)
        parts.append(sorted(zip(*np.concatenate([np.stack(f) for *_, f in rn.fills._fill(table, starts, 2, 0.5, False, True)], axis=1).tolist())))
    assert parts[0] == parts[1] and len(parts[0]) == len(want)
