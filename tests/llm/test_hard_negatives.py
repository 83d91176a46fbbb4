"""Hard negatives against plain loops over all rows."""

import random

import numpy as np
import pytest

from lamella.llm import hard_negatives as hn

SCHEMA = "id bigint, label bigint, vector array<bigint>, anchor boolean, rank int, score string, turn int, part int"


def plain(rows, positives=5, negatives=10, shares=(30, 90)):
    width = max((len(v) for _, _, v, _ in rows), default=1)
    full = [(i, c, [*v, *[0] * (width - len(v))], a) for i, c, v, a in rows]
    out = []
    for i, c, v, a in full:
        if not a:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), j, d) for j, d, w, _ in full if j != i)
        for s, p, d in [r for r in scored if r[2] == c][:positives]:
            found = [r for r in scored if r[2] != c and shares[0] * -s <= 100 * -r[0] <= shares[1] * -s]
            out += [(i, p, k, r[1], -s, -r[0]) for k, r in enumerate(found[:negatives], 1)]
    return sorted(out)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)


def clustered(rng, n, width, spread=300, labels=4):
    """Vectors around few centres, with copies, ties, zeros and short ones."""
    centres = [[rng.randint(-200, 200) for _ in range(width)] for _ in range(6)]
    rows = []
    for k in range(n):
        v = [x + rng.randint(-spread, spread) // 10 for x in rng.choice(centres)]
        if k % 11 == 0 and rows:
            v = list(rng.choice(rows)[2])
        if k % 17 == 0:
            v = v[: rng.randint(0, width)]
        rows.append((k, rng.randrange(labels), v, rng.random() < 0.2))
    return rows


@pytest.mark.parametrize("block, tile, round_bytes", [(512, 4096, 16_000_000), (5, 30, 2_000)])
def test_against_all_scores(spark, block, tile, round_bytes):
    rows = clustered(random.Random(21), 260, 7)
    got = hn.hard_negatives(table_of(spark, rows).repartition(3), block=block, tile=tile, round_bytes=round_bytes)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_lists_and_shares(spark):
    rows = clustered(random.Random(22), 120, 4, labels=3)
    got = hn.hard_negatives(table_of(spark, rows), positives=2, negatives=30, shares=(0, 100))
    assert sorted(map(tuple, got.collect())) == plain(rows, 2, 30, (0, 100))


def test_rows_that_take_no_part(spark):
    good = clustered(random.Random(23), 60, 3)
    bad = [(None, 1, [1, 2, 3], True), (900, None, [1, 2, 3], True), (901, 1, None, True), (902, 1, [1, None, 3], True)]
    repeated = [*good, *[(i, c, v, False) for i, c, v, _ in good[:20]], (good[5][0], 99, [9, 9, 9], None)]
    # Of several rows of an id the least counts, as an anchor if one of them is.
    got = hn.hard_negatives(table_of(spark, [*repeated, *bad]))
    assert sorted(map(tuple, got.collect())) == plain(good)
    assert hn.hard_negatives(table_of(spark, good).where("false")).collect() == []
    alone = hn.hard_negatives(table_of(spark, [(100, 1, [1], True), (101, 2, [1], False)]))
    assert alone.collect() == []


def test_large_components(spark):
    """Sums beyond the exact range of floating point are still exact."""
    for scale in (10**4, 10**7):
        rows = [(k, k % 3, [(k * 37 % 11 - 2) * scale // 50 + k, scale // (k + 1), k], k % 4 == 0) for k in range(40)]
        assert sorted(map(tuple, hn.hard_negatives(table_of(spark, rows)).collect())) == plain(rows)
    huge = np.array([[10**12, 3], [-(10**12), 5], [10**8, 7]])
    tile = hn.Tile(np.arange(3), np.zeros(3, np.int64), huge)
    exact = [int(a) * 10**12 + int(b) for a, b in huge]
    wanted = [max(-hn.FAR, min(hn.FAR, v)) for v in exact]
    assert tile.scores(np.array([10**12, 1]), 1e12).tolist() == wanted and abs(wanted[0]) == hn.FAR
    assert hn.Tile(*[c[2:] for c in (tile.ids, tile.labels, huge)]).scores(np.array([10**8 + 1, 1]), 1e8).tolist() == [10**16 + 10**8 + 7]


def test_bounds_spare_scores():
    """Along a tree over close anchors most rows are never scored, with the same lists."""
    rng = np.random.default_rng(24)
    centre = rng.normal(size=(8, 16)) * 100
    rows = np.floor(centre[rng.integers(0, 8, 4000)] + rng.normal(size=(4000, 16))).astype(np.int64)
    anchors = np.floor(centre[0] + rng.normal(size=(40, 16))).astype(np.int64)
    order, parents, edges = hn.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and parents[0] == -1 and all(p < k for k, p in enumerate(parents))
    v = anchors[order]
    for k in range(1, 40):
        assert np.isclose(edges[k], np.linalg.norm(v[k] - v[parents[k]]))
    row = {"ids": list(range(40)), "label": 0, "parents": parents, "edges": edges.tolist(), "vectors": v.tobytes()}
    block = hn.unpacked(row)
    tile = hn.Tile(np.arange(4000), np.ones(4000, np.int64), rows)
    lists = [hn.Best(5) for _ in range(40)]
    scored = hn.walk(tile, block, lambda k: (lists[k].least(), hn.LONGEST), lambda k, at, s: lists[k].add(tile.ids[at], s), None)
    # The first tile fills the lists; a second one is judged by them.
    scored = hn.walk(tile, block, lambda k: (lists[k].least(), hn.LONGEST), lambda k, at, s: None, None)
    assert scored < 0.3 * 40 * 4000
    for k in range(40):
        exact = rows @ v[k]
        best = sorted(range(4000), key=lambda r: (-exact[r], r))[:5]
        assert lists[k].ids.tolist() == best


def test_finite(spark):
    """Rows with a null or non-finite component take no part in the query."""
    rows = [([1.0, 2.0],), ([1.0, None],), ([float("nan"), 0.0],), ([float("-inf"), 0.0],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(hn.finite(F.col("v"))).collect()] == [True, False, False, False, False, True]
