"""Regions less their loops, in bands of pixel rows, against sets of pixels."""

import random

import numpy as np
import pyarrow as pa

from lamella.operators import fills
from lamella.operators import regions as rn

SCHEMA = "slide_name string, biomarker string, id string, rings array<array<struct<x:double,y:double>>>"


def ring(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def pixels(x, y, w, h):
    return {(r, c) for r in range(y, y + h) for c in range(x, x + w)}


def test_random_cuts(spark):
    rng = random.Random(7)
    regions, loops, want = [], [], {}
    for k in range(24):
        # Some shapes span several bands; in a half of the slides the last loop covers all.
        box = (rng.randrange(-40, 40), rng.randrange(-300, 300), rng.randrange(2, 40), rng.choice([3, 30, 600]))
        regions.append((f"s{k}", "CD8", f"r{k}", [ring(*map(float, box))]))
        cuts = [(box[0] + rng.randrange(-9, 9), box[1] + rng.randrange(-9, 9), rng.randrange(1, 60), rng.choice([5, 40, 700])) for _ in range(3)]
        if k % 2:
            cuts.append((box[0] - 1, box[1] - 1, box[2] + 2, box[3] + 2))
            rng.shuffle(cuts)
        left = before = pixels(*box)
        together = before - set().union(*[pixels(*c) for c in cuts])
        for n, cut in enumerate(cuts):
            loops.append((f"s{k}", "CD8", f"l{n}", [ring(*map(float, cut))]))
            left = left - pixels(*cut) or left
        left = together or left
        if left != before:
            want[f"r{k}"] = left
    table = spark.createDataFrame(regions, SCHEMA)
    cut = rn.subtract_loops(table, spark.createDataFrame(loops, SCHEMA))
    got = {}
    for r in cut["runs"].collect():
        got.setdefault(r.id, set()).update((r.row, c) for c in range(r.x0, r.x1 + 1))
    whole = {r[2]: set(pixels(*(int(v) for v in (*r[3][0][0], r[3][0][2][0] - r[3][0][0][0], r[3][0][2][1] - r[3][0][0][1])))) for r in regions}
    assert {k: v for k, v in got.items() if v != whole[k]} == want
    assert {r.id: r.after for r in cut["counts"].collect() if r.after != r.before} == {k: len(v) for k, v in want.items()}
    drawn = rn.rasterize(rn.region_edge_rows(cut["rings"], ["id"]), ["id"])
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, cut["runs"].collect()))


def test_bands_in_parts(monkeypatch):
    """A band whose crossings do not fit at once gives the same sets and runs."""
    edges = []
    for cut, loop, (x, y, w, h) in [(0, None, (0, 0, 9, 200)), (1, "a", (0, 0, 9, 120)), (1, "b", (0, 100, 5, 100)), (1, "c", (5, 100, 4, 100))]:
        edges += [("r", 0, cut, loop, float(v), float(y), float(v), float(y + h), y, y + h - 1, -1) for v in (x, x + w)]
    table = pa.table({str(k): list(v) for k, v in enumerate(zip(*edges))})

    def filled():
        (low, high, found), = fills._fill(table, np.array([0]), 2, 0.5, True, True, True)
        sets = {}
        for s, member in zip(found[9].tolist(), found[10].tolist()):
            sets.setdefault(s, []).append(member)
        return [v.tolist() for v in found[:8]], sorted({tuple(v) for v in sets.values()})

    whole = filled()
    assert len(whole[1]) == 5
    monkeypatch.setattr(fills, "CROSSINGS", 100)
    assert filled() == whole
