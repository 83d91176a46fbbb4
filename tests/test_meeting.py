"""Touching regions, components and containment against plain geometry over all pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lamella.operators import meeting as mt
from lamella.operators import regions as rn
from lamella.operators import spatial as sp

SCHEMA = "id string, slide_name string, biomarker string, rings array<array<struct<x:double,y:double>>>"
KEYS = ["slide_name", "biomarker"]


def table(spark, shapes, slide="s", channel="c"):
    return spark.createDataFrame([(k, slide, channel, rings) for k, rings in shapes.items()], SCHEMA)


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def edges(rings):
    return [(a, b) for r in rings if len(r) >= 3 for a, b in zip(r, [*r[1:], r[0]])]


def cross(e, f):
    def side(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    for k in (0, 1):
        if max(e[0][k], e[1][k]) < min(f[0][k], f[1][k]) or max(f[0][k], f[1][k]) < min(e[0][k], e[1][k]):
            return False
    return side(*e, f[0]) * side(*e, f[1]) <= 0 and side(*f, e[0]) * side(*f, e[1]) <= 0


def holds(rings, p):
    inside = False
    for (x1, y1), (x2, y2) in edges(rings):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def meet(a, b):
    if any(cross(e, f) for e in edges(a) for f in edges(b)):
        return True
    return any(holds(b, r[0]) for r in a if len(r) >= 3) or any(holds(a, r[0]) for r in b if len(r) >= 3)


def plain_pairs(shapes):
    return {(a, b) for a, b in itertools.combinations(sorted(shapes), 2) if meet(shapes[a], shapes[b])}


def plain_labels(ids, pairs):
    label = {k: k for k in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def random_shapes(rng, n):
    """Boxes, triangles, frames, frames inside frames, copies, degenerate rings, far ones."""
    shapes = {}
    for k in range(n):
        x, y, w, h = (rng.randrange(-40, 300) for _ in range(2)), None, rng.randrange(4, 90), rng.randrange(4, 90)
        x, y = x
        kind = rng.randrange(7)
        rings = [box(x, y, w, h)]
        if kind == 1:
            rings = [[(x, y), (x + w, y + h / 2), (x - 3.5, y + h)]]
        elif kind == 2:
            rings.append(box(x + w * 0.25, y + h * 0.25, w / 2, h / 2))
        elif kind == 3 and shapes:
            rings = rng.choice(list(shapes.values()))
        elif kind == 4:
            rings += [[(x, y), (x + 1, y)], box(x + 2 * w, y, w, h)]
        elif kind == 5:
            rings = [box(x, y, w / 8, h / 8)]
        shapes[f"r{k:03}"] = [[(float(a), float(b)) for a, b in r] for r in rings]
    return shapes


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    shapes = random_shapes(random.Random(seed), 70)
    regions = table(spark, shapes)
    wanted = plain_pairs(shapes)
    assert {(r.a, r.b) for r in rn.touching_regions(regions).collect()} == wanted
    labels = {r.id: r.label for r in rn.connected_components(rn.component_edges(regions)).collect()}
    assert {k: labels.get(k, k) for k in shapes} == plain_labels(shapes, wanted)


def test_nested_frames(spark):
    """Rings within rings that never touch: contained in the fill, or lying in a hole."""
    shapes = {}
    for k in range(12):
        s = 200.0 - 16 * k
        shapes[f"f{k:02}"] = [box(100 - s / 2, 100 - s / 2, s, s), box(100 - s / 2 + 4, 100 - s / 2 + 4, s - 8, s - 8)]
    shapes["solid"] = [box(0.0, 0.0, 400.0, 400.0)]
    shapes["dot"] = [box(100.0, 100.0, 1.0, 1.0)]
    wanted = plain_pairs(shapes)
    regions = table(spark, shapes)
    assert {(r.a, r.b) for r in rn.touching_regions(regions).collect()} == wanted
    labels = {r.id: r.label for r in rn.connected_components(rn.component_edges(regions)).collect()}
    assert {k: labels.get(k, k) for k in shapes} == plain_labels(shapes, wanted)


def test_crowd_gives_few_links(spark):
    """Thousands of near copies in one place: fewer links than regions in every cell, no pairs."""
    n = 5000
    at = F.col("id") % 97 / 16
    corners = [(0, 0), (30, 0), (30, 30), (0, 30)]
    ring = F.array(*[F.struct((at + x).cast("double").alias("x"), (F.col("id") / 1024 + y).cast("double").alias("y")) for x, y in corners])
    regions = spark.range(n).select(
        F.format_string("r%05d", "id").alias("id"), F.lit("s").alias("slide_name"), F.lit("c").alias("biomarker"), F.array(ring).alias("rings")
    )
    edge_rows = mt.region_edges(regions, KEYS)
    # One cell with all of them, and the cells that the crowd is cut into.
    whole = edge_rows.orderBy("id").toPandas()
    owner = whole["id"].str[1:].astype(int).to_numpy()
    assert len(mt.spanning_links(*[whole[c].to_numpy() for c in mt.SIDES], owner)) == n - 1
    cells = sum(rows.select("_cx", "_cy").distinct().count() for rows, _ in mt.sized_cells(edge_rows, KEYS))
    links = rn.component_edges(regions).count()
    assert links < n * cells and links < 30 * n
    labels = rn.connected_components(rn.component_edges(regions))
    assert labels.select("label").distinct().count() == 1 and labels.count() == n


def test_crowded_cells_are_cut(spark):
    shapes = random_shapes(random.Random(9), 60)
    edge_rows = mt.region_edges(table(spark, shapes), KEYS)
    whole = mt.ring_links(edge_rows, KEYS)
    cut = mt.ring_links(edge_rows, KEYS, most=5)
    sizes = [s for _, s in mt.sized_cells(edge_rows, KEYS, most=5)]
    assert len(sizes) > 3 and sizes[-1] < 16

    def groups(links):
        rows = [((r.a.id, r.a.ring), (r.b.id, r.b.ring)) for r in links.collect()]
        return plain_labels({e for p in rows for e in p}, rows)

    assert groups(whole) == groups(cut)


def test_large_region(spark):
    """A region of 100,000 points over a thousand cells and more, with small ones in and around it."""
    n = 100_000
    angle = F.col("id") * F.lit(2 * 3.141592653589793 / n)
    far = F.lit(6000.0) + 300 * F.sin(angle * 500)
    point = F.struct("id", (far * F.cos(angle)).alias("x"), (far * F.sin(angle)).alias("y"))
    big = spark.range(n).agg(F.sort_array(F.collect_list(point)).alias("p")).select(
        F.lit("big").alias("id"), F.lit("s").alias("slide_name"), F.lit("c").alias("biomarker"),
        F.array(F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("rings"),
    )
    small = table(spark, {"in": [box(0.0, 0.0, 5.0, 5.0)], "on": [box(5900.0, -20.0, 400.0, 40.0)], "out": [box(7000.0, 0.0, 5.0, 5.0)]})
    assert mt.edge_cells(mt.region_edges(big, KEYS)).select("_cx", "_cy").distinct().count() > 1000
    got = {(r.a, r.b) for r in rn.touching_regions(big.unionByName(small)).collect()}
    assert got == {("big", "in"), ("big", "on")}


def test_edge_arrays_stay_in_their_row(spark):
    """No shuffle carries an array, and a generator's array is not copied along with its rows."""
    regions = table(spark, random_shapes(random.Random(1), 5))
    plan = rn.touching_regions(regions)._jdf.queryExecution().optimizedPlan()
    joins = [n for n in _nodes(plan) if n.getClass().getSimpleName() == "Join"]
    assert len(joins) > 3
    for j in joins:
        assert "array" not in j.schema().simpleString()


def _nodes(plan):
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += [node.children().apply(k) for k in range(node.children().size())]


def test_cells_of_an_edge(spark):
    """Every point of an edge lies in a cell of it, and long slanted edges take few cells."""
    rng = random.Random(2)
    rows = [(k, *[rng.randrange(-8000, 8000) / 8 for _ in range(4)]) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, x2 double, y2 double")
    cells = {}
    for r in mt.edge_cells(df).collect():
        cells.setdefault(r.id, set()).add((r._cx, r._cy))
    for k, x1, y1, x2, y2 in rows:
        for t in range(201):
            p = (x1 + (x2 - x1) * t / 200, y1 + (y2 - y1) * t / 200)
            assert any(abs(cx + 0.5 - p[0] / 64) <= 0.5 + 1e-9 and abs(cy + 0.5 - p[1] / 64) <= 0.5 + 1e-9 for cx, cy in cells[k])
        assert len(cells[k]) <= (abs(x2 - x1) + abs(y2 - y1)) / 64 + 3


def test_grids(spark):
    """A rectangle has at most four keys whatever its size, and mixed sizes still meet once."""
    rng = random.Random(4)
    rows = [(k, "s", rng.uniform(-500, 500), rng.uniform(-500, 500), 2.0 ** rng.uniform(-3, 14), 2.0 ** rng.uniform(-3, 14)) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, x1 double, y1 double, w double, h double")
    df = df.withColumns({"x2": F.col("x1") + F.col("w"), "y2": F.col("y1") + F.col("h")})
    sides = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    keys = sp.grid_cells(df.withColumn("_grid", sp.grid_of(*sides)), *sides).groupBy("id").count()
    assert keys.agg(F.max("count")).first()[0] <= 4
    left = df.select("g", F.col("id").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in ("x1", "y1", "x2", "y2")])
    right = df.select("g", F.col("id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    got = sorted((r.l_id, r.r_id) for r in sp.overlap_pairs(left, right, ["g"]).collect())
    ends = {k: (x, y, x + w, y + h) for k, _, x, y, w, h in rows}
    over = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    assert got == sorted((a, b) for a in ends for b in ends if over(ends[a], ends[b]))
    points = df.select(F.col("id").alias("pid"), "g", F.col("x1").alias("x"), F.col("y2").alias("y"))
    held = sp.points_in_boxes(points, "x", "y", df.select("g", "id", "x1", "y1", "x2", "y2"), sides, ["g"])
    held = held.where("x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
    at = {k: (x, y + h) for k, _, x, y, _, h in rows}
    wanted = sorted((p, b) for p in at for b in ends if ends[b][0] <= at[p][0] <= ends[b][2] and ends[b][1] <= at[p][1] <= ends[b][3])
    assert sorted((r.pid, r.id) for r in held.collect()) == wanted


def test_loops_in_turn(spark):
    """Loops count in their order; one that would leave nothing is passed over, however many there are."""
    rng = random.Random(6)
    shapes, loops, wanted = {}, [], {}
    for k in range(25):
        x = 1000.0 * k
        shapes[f"r{k:02}"] = [box(x, 0.0, 20.0, 20.0)]
        left = {(a, b) for a in range(20) for b in range(20)}
        for n in range(rng.randrange(1, 12)):
            a, b, w, h = rng.randrange(-5, 12), rng.randrange(-5, 12), rng.randrange(6, 30), rng.randrange(6, 30)
            if n == 3:
                a, b, w, h = -1, -1, 30, 30
            loops.append((f"l{k:02}_{n:02}", "s", "c", [box(x + a, float(b), float(w), float(h))]))
            rest = {p for p in left if not (a <= p[0] < a + w and b <= p[1] < b + h)}
            left = rest or left
        if len(left) < 400:
            wanted[f"r{k:02}"] = len(left)
    cut = rn.subtract_loops(table(spark, shapes), spark.createDataFrame(loops, SCHEMA))
    assert {r.id: r.after for r in cut["counts"].collect()} == wanted
    filled = rn.pixel_count(rn.rasterize(rn.region_edge_rows(cut["rings"], ["id"]), ["id"]), ["id"])
    assert {r.id: r.pixels for r in filled.collect()} == wanted
