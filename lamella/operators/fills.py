"""Even-odd fills of edges as pixel runs, by numpy on bands of pixel rows.

Edges, not their crossings with pixel rows, go through the shuffle: an edge is dealt to the
bands of ``BAND`` pixel rows that it passes, and the edges of one band of one key meet in one
task, however large the shape is. There the crossings are made, sorted and paired for many
bands at once, and no more than about ``CROSSINGS`` of them exist at a time.

A band also fills the pixel row above it. So it knows both sides of every pixel border at
its top, and the corners of an outline come out of the same pass as the runs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BAND = 256
CROSSINGS = 2_000_000
#: Edges that are collected before their whole groups are filled.
EDGES = 16_384
RUNS = "array<struct<row:int,x0:int,x1:int>>"
CORNERS = "array<struct<y:int,x_from:int,row_from:int,x_to:int,row_to:int>>"
_SIDES = ("ax", "ay", "bx", "by")


def dealt(
    edges: DataFrame, keys: Sequence[str], together: Sequence[str], sides: Sequence[Column], first: Column, last: Column,
    width: Column, border: bool,
) -> DataFrame:
    """Rows (together, _band, other keys, ax, ay, bx, by, _first, _last, _w), the bands of a
    task in order. ``border``: the row above the band counts as well."""
    rest = [k for k in keys if k not in together]
    named = edges.select(
        *together, *rest, *[c.alias(n) for c, n in zip(sides, _SIDES)], first.alias("_first"), last.alias("_last"), width.cast("int").alias("_w")
    ).where("_last >= _first")
    ends = [F.floor(v / F.lit(BAND)) for v in (F.col("_first"), F.col("_last") + (1 if border else 0))]
    low = F.col("_band") * BAND - (1 if border else 0)
    banded = named.withColumn("_band", F.explode(F.sequence(*ends))).select(
        *together, "_band", *rest, *_SIDES,
        F.greatest("_first", low).alias("_first"), F.least("_last", F.col("_band") * BAND + (BAND - 1)).alias("_last"), "_w",
    )
    return banded.repartition(*together, "_band").sortWithinPartitions(*together, "_band")


def _codes(table: pa.Table, columns: Sequence[int]) -> list[np.ndarray]:
    return [table.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in columns]


def _groups(table: pa.Table, n: int) -> np.ndarray:
    """Where the rows that agree in the first ``n`` columns begin."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[0] = True
    for code in _codes(table, range(n)):
        fresh[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(fresh)


def whole_groups(batches: Iterator[pa.RecordBatch], n: int, most: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, the rows that agree in the first ``n`` columns, and where these begin.

    A group of more rows than ``most`` has at least one more, but need not have all of them.
    """
    held, rows, wanted = [], 0, EDGES
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _groups(table, n)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        rows -= int(starts[-1])
        rows = rows if most is None else min(rows, most + 1)
        held = table.slice(starts[-1], rows).to_batches()
        # A group that fills all that is held is not looked at again before it has doubled.
        wanted = max(EDGES, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _groups(table, n)


def _along_rows(at: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The order of crossings by ``code`` and ``at``. Most rows have two, which one look puts in order."""
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]])[: len(code)])
    size = np.diff(np.append(start, len(code)))
    two = start[size == 2]
    two = two[at[order[two]] > at[order[two + 1]]]
    order[two], order[two + 1] = order[two + 1], order[two]
    more = np.flatnonzero(np.repeat(size > 2, size))
    order[more] = order[more][np.lexsort((at[order[more]], sorted_code[more]))]
    return order


def _runs(group, inner, n_inner, first, last, sides, half, width):
    """Runs (group, row, x0, x1) of each (group, inner, row), by group and row; rows count
    from the band's upper border."""
    n = last - first + 1
    e = np.repeat(np.arange(len(n)), n)
    row = np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n) + first[e]
    ax, ay, bx, by, top = sides
    at = ax[e] + (row + top[e] + half - ay[e]) * (bx - ax)[e] / (by - ay)[e]
    code = (group[e] * (BAND + 1) + row) * n_inner + inner[e]
    order = _along_rows(at, code)
    at, code, w = at[order], code[order], width[e[order]]
    place = np.arange(len(code))
    same = code[1:] == code[:-1]
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), place, 0))
    k = np.flatnonzero(((place - begin)[:-1] % 2 == 0) & same)
    x0, x1 = np.ceil(at[k] - half).astype(np.int64), np.ceil(at[k + 1] - half).astype(np.int64) - 1
    cut = w[k] >= 0
    x0, x1 = np.where(cut, np.maximum(x0, 0), x0), np.where(cut, np.minimum(x1, w[k] - 1), x1)
    full = x0 <= x1
    where = code[k][full] // n_inner
    return where // (BAND + 1), where % (BAND + 1), x0[full], x1[full], code[k][full] % n_inner


def _union(group, row, x0, x1, inner=None):
    """Runs that overlap or touch become one."""
    if not len(x0):
        return group, row, x0, x1
    line = group * (BAND + 1) + row
    order = np.lexsort((x0, line))
    line, x0, x1 = line[order], x0[order], x1[order]
    low, span = x0.min(), x1.max() - x0.min() + 2
    end = np.maximum.accumulate(line * span + (x1 - low))
    start = np.flatnonzero(np.concatenate([[True], (line * span + (x0 - low))[1:] > end[:-1] + 1]))
    line, x0, x1 = line[start], x0[start], np.maximum.reduceat(x1, start)
    return line // (BAND + 1), line % (BAND + 1), x0, x1


def _less(group, row, x0, x1, cuts):
    """Runs without the pixels of ``cuts``; neighbouring stretches that stay are joined."""
    of = [group * (BAND + 1) + row, cuts[0] * (BAND + 1) + cuts[1]]
    line = np.concatenate([of[0], of[0], of[1], of[1]])
    x = np.concatenate([x0, x1 + 1, cuts[2], cuts[3] + 1])
    # What begins (1) or ends (-1) there: a run in the first half, a cut in the second.
    ones, more = np.ones(len(x0), np.int64), np.ones(len(cuts[2]), np.int64)
    run = np.concatenate([ones, -ones, 0 * more, 0 * more])
    cut = np.concatenate([0 * ones, 0 * ones, more, -more])
    order = np.lexsort((x, line))
    line, x = line[order], x[order]
    last = np.append((line[1:] != line[:-1]) | (x[1:] != x[:-1]), True)[: len(x)]
    on = ((np.cumsum(run[order]) > 0) & (np.cumsum(cut[order]) <= 0))[last]
    line, x = line[last], x[last]
    was = np.concatenate([[False], on[:-1]])[: len(on)]
    start, stop = np.flatnonzero(on & ~was), np.flatnonzero(was & ~on)
    return line[start] // (BAND + 1), line[start] % (BAND + 1), x[start], x[stop] - 1


def _sets(runs, cuts):
    """The distinct sets of cuts that hold pixels of the runs: (group, of each set; set, inner, of each member).

    ``cuts`` are runs (group, row, x0, x1, inner), those of one inner key disjoint.
    """
    of = [runs[0] * (BAND + 1) + runs[1], cuts[0] * (BAND + 1) + cuts[1]]
    low = min(runs[2].min(), cuts[2].min())
    span = max(runs[3].max(), cuts[3].max()) - low + 3
    at = [line * span + (x - low) for line, x in ((of[0], runs[2]), (of[0], runs[3] + 1), (of[1], cuts[2]), (of[1], cuts[3] + 1))]
    ends = np.unique(np.concatenate(at))
    # Pieces lie between neighbouring ends; those of the runs are covered by one.
    cover = np.zeros(len(ends) + 1, np.int64)
    np.add.at(cover, np.searchsorted(ends, at[0]), 1)
    np.add.at(cover, np.searchsorted(ends, at[1]), -1)
    inside = np.cumsum(cover)[:-1] > 0
    first, last = np.searchsorted(ends, at[2]), np.searchsorted(ends, at[3])
    n = last - first
    piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    held = inside[piece]
    piece, inner = piece[held], np.repeat(cuts[4], n)[held]
    order = np.lexsort((inner, piece))
    piece, inner = piece[order], inner[order]
    own, start, size = np.unique(piece, return_index=True, return_counts=True)
    # Sets are told apart member by member, so that equal ones have one name.
    group = ends[own] // span // (BAND + 1)
    name = np.unique(group, return_inverse=True)[1]
    members = int(inner.max(initial=0)) + 2
    for k in range(int(size.max(initial=0))):
        member = np.where(size > k, inner[np.minimum(start + k, len(inner) - 1)] + 1, 0)
        name = np.unique(name * members + member, return_inverse=True)[1]
    one = np.unique(name, return_index=True)[1]
    one = one[np.argsort(group[one], kind="stable")]
    n = size[one]
    members = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[one], n)
    return group[one], np.repeat(np.arange(len(one)), n), inner[members]


def numbers(table: pa.Table, n_by: int, n_rest: int) -> tuple[np.ndarray, int]:
    """A number for the values of the keys beyond the first ones, and how many there are."""
    inner, n_inner = np.zeros(table.num_rows, np.int64), 1
    for code in _codes(table, range(n_by, n_by + n_rest)):
        inner = inner * (int(code.max()) + 1) + code
        inner = np.unique(inner, return_inverse=True)[1]
        n_inner = int(inner.max()) + 1
    return inner, n_inner


def _fill(table: pa.Table, starts: np.ndarray, n_by: int, half: float, border: bool, union: bool, less: bool = False):
    """Runs (group, row, x0, x1) of a table of whole groups, in parts of bounded size; each
    part with its range of groups. With ``less``, the first of the other keys tells shapes (0)
    from cuts (1): the runs of the shapes, behind them what the cuts leave of these, and behind
    them the sets of cuts that hold the pixels of groups of which nothing is left."""
    n_rest = table.num_columns - n_by - 7
    sizes = np.diff(np.append(starts, table.num_rows))
    group = np.repeat(np.arange(len(starts)), sizes)
    inner, n_inner = numbers(table, n_by, n_rest)
    cuts = table.column(n_by).combine_chunks().to_numpy() == 1 if less else None
    value = lambda k: table.column(n_by + n_rest + k).combine_chunks().to_numpy(zero_copy_only=False)
    top = table.column(n_by - 1).combine_chunks().to_numpy() * BAND - (1 if border else 0)
    sides = [*(value(k) for k in range(4)), top]
    first, last, width = value(4) - top, value(5) - top, value(6).astype(np.int64)
    count = np.add.reduceat(last - first + 1, starts)
    total = np.cumsum(count)

    def part(at: slice, low: int, high: int):
        f, t = np.maximum(first[at], low), np.minimum(last[at], high)
        on = np.flatnonzero(t >= f)
        if high > low and int((t - f + 1)[on].sum()) > CROSSINGS:
            middle = (low + high) // 2
            halves = part(at, low, middle), part(at, middle + 1, high)
            if less:
                # The sets of the lower half are counted behind those of the upper one.
                halves[1][9] += len(halves[0][8])
            return [np.concatenate(p) for p in zip(*halves)]

        def runs(on: np.ndarray):
            return _runs(group[at][on], inner[at][on], n_inner, f[on], t[on], [s[at][on] for s in sides], half, width[at][on])

        if less:
            shapes, holes = _union(*runs(on[~cuts[at][on]])), runs(on[cuts[at][on]])
            left = _less(*shapes, _union(*holes))
            gone = [np.isin(v[0], left[0], invert=True) & (v[1] >= 1 if border else True) for v in (shapes, holes)]
            none = [np.zeros(0, np.int64)] * 3
            return [*shapes[:4], *left, *(_sets([v[gone[0]] for v in shapes[:4]], [v[gone[1]] for v in holes]) if gone[0].any() and gone[1].any() else none)]
        return _union(*runs(on)) if union else runs(on)[:4]

    g = 0
    while g < len(starts):
        done = total[g - 1] if g else 0
        until = max(g + 1, int(np.searchsorted(total, done + CROSSINGS, "right")))
        at = slice(starts[g], starts[until] if until < len(starts) else table.num_rows)
        found = part(at, 0, BAND)
        # A group that was cut into ranges of rows is in order: it is alone in its part.
        yield g, until, found
        g = until


def filled_runs(edges: DataFrame, by: Sequence[str], half: float, union: bool) -> DataFrame:
    """Runs (by, row, x0, x1) of dealt edges: each key's own, or their union over ``by``."""
    n = len(by) + 1
    places = ("row", "x0", "x1")
    shape = edges.select(*by).schema
    for name in places:
        shape = shape.add(f"_{name}", T.ArrayType(T.IntegerType()))
    wanted = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, n):
            names = table.select(range(n)).take(pa.array(starts)).combine_chunks()
            bands = names.column(n - 1).combine_chunks().to_numpy()
            for _, _, (group, row, x0, x1) in _fill(table, starts, n, half, False, union):
                row = row + bands[group] * BAND
                # The keys of a band go out once, not with each of its runs.
                for k in range(0, len(group), 100_000):
                    s = slice(k, k + 100_000)
                    low, high = int(group[s][0]), int(group[s][-1]) + 1
                    at = _offsets(group[s], low, high)
                    lists = [pa.ListArray.from_arrays(at, pa.array(v[s], pa.int32())) for v in (row, x0, x1)]
                    own = names.slice(low, high - low)
                    columns = [*(own.column(i).combine_chunks() for i in range(n - 1)), *lists]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, wanted.types)], schema=wanted)

    lists = edges.mapInArrow(run, shape).select("*", F.posexplode("_row").alias("_k", "row"))
    return lists.select(*by, "row", *[F.get(f"_{c}", F.col("_k")).alias(c) for c in places[1:]])


def _corners(group, row, x0, x1):
    """Horizontal edges (group, y, x_from, row_from, x_to, row_to) of runs that do not touch,
    between the band's rows and the row above it."""
    four = [(row + 1 - below, x1 + 1 - start * (x1 + 1 - x0), start, below) for start in (0, 1) for below in (0, 1)]
    join = lambda k: np.concatenate([np.broadcast_to(e[k], len(row)) for e in four])
    y, x, start, below, owner = join(0), join(1), join(2), join(3), np.tile(group, 4)
    inside = np.flatnonzero((y >= 1) & (y <= BAND))
    y, x, start, below, owner = y[inside], x[inside], start[inside], below[inside], owner[inside]
    line = owner * (BAND + 1) + y
    order = np.lexsort((start, x, line))
    line, x, start, below = line[order], x[order], start[order], below[order]
    # Ends of one kind that both rows have in the same place cancel out.
    twin = (line[1:] == line[:-1]) & (x[1:] == x[:-1]) & (start[1:] == start[:-1])
    alone = np.flatnonzero(~(np.append(twin, False) | np.concatenate([[False], twin])[: len(x)]))
    line, x, start, below = line[alone], x[alone], start[alone], below[alone]
    a, b = slice(0, None, 2), slice(1, None, 2)
    # The pixels lie below the edge if the lower row starts or the upper row ends on its left.
    under = start[a] == below[a]
    pick = lambda v, p, q: np.where(under, v[p], v[q])
    return line[a] // (BAND + 1), line[a] % (BAND + 1), pick(x, a, b), pick(below, a, b), pick(x, b, a), pick(below, b, a)


def _offsets(group: np.ndarray, low: int, high: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(group - low, minlength=high - low))]), pa.int32())


def _lists(group: np.ndarray, low: int, high: int, fields: dict[str, np.ndarray]) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(_offsets(group, low, high), values)


def filled_bands(edges: DataFrame, by: Sequence[str], half: float) -> DataFrame:
    """One row (by, _band, pixels, runs, corners) per band of the union over ``by`` of edges
    that were dealt with their border; ``corners`` are the outline's horizontal edges."""
    n = len(by) + 1
    lists = edges.sparkSession.createDataFrame([], f"runs {RUNS}, corners {CORNERS}").schema
    shape = edges.select(*by, "_band").schema.add("pixels", "long").add(lists["runs"]).add(lists["corners"])
    wanted = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, n):
            names = table.select(range(n)).take(pa.array(starts)).combine_chunks()
            top = names.column(n - 1).combine_chunks().to_numpy() * BAND - 1
            for low, high, (group, row, x0, x1) in _fill(table, starts, n, half, True, True):
                owner, y, x_from, row_from, x_to, row_to = _corners(group, row, x0, x1)
                own = row >= 1
                g, r, p, q = group[own], row[own], x0[own], x1[own]
                pixels = np.bincount(g - low, weights=q - p + 1, minlength=high - low).astype(np.int64)
                runs = _lists(g, low, high, {"row": r + top[g], "x0": p, "x1": q})
                turns = {"y": y + top[owner], "x_from": x_from, "row_from": row_from, "x_to": x_to, "row_to": row_to}
                mine = names.slice(low, high - low)
                columns = [*(mine.column(i).combine_chunks() for i in range(n)), pa.array(pixels), runs, _lists(owner, low, high, turns)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, wanted.types)], schema=wanted)

    return edges.mapInArrow(run, shape)


def cut_bands(edges: DataFrame, by: Sequence[str], half: float) -> DataFrame:
    """One row (by, _band, before, after, runs, corners, sets) per band of shapes less their cuts.

    ``edges`` were dealt with their border; their first key beyond ``by`` is 0 for the edges
    of the shape and 1 for those of its cuts, of which the next one tells one from another.
    The last two columns of ``by`` are the corner (x, y) to which the edges are relative;
    ``runs`` and ``corners``, as in :func:`filled_bands`, are not. Where nothing is left in a
    band, ``sets`` are the distinct sets of cuts that hold its pixels.
    """
    n = len(by) + 1
    lists = edges.sparkSession.createDataFrame([], f"runs {RUNS}, corners {CORNERS}").schema
    shape = edges.select(*by, "_band").schema.add("before", "long").add("after", "long").add(lists["runs"]).add(lists["corners"])
    cut = edges.columns[n + 1]
    shape = shape.add("sets", T.ArrayType(T.ArrayType(edges.schema[cut].dataType)))
    wanted = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, n):
            names = table.select(range(n)).take(pa.array(starts)).combine_chunks()
            left, upper, band = (names.column(k).combine_chunks().to_numpy().astype(np.int64) for k in (n - 3, n - 2, n - 1))
            top = band * BAND - 1 + upper
            ids = table.column(n + 1)
            one = np.unique(numbers(table, n, 2)[0], return_index=True)[1]
            for low, high, found in _fill(table, starts, n, half, True, True, True):
                counts = []
                for group, row, x0, x1 in (found[:4], found[4:8]):
                    own = row >= 1
                    counts.append(np.bincount(group[own] - low, weights=(x1 - x0 + 1)[own], minlength=high - low).astype(np.int64))
                group, row, x0, x1 = found[4:8]
                owner, y, x_from, row_from, x_to, row_to = _corners(group, row, x0, x1)
                own = row >= 1
                g = group[own]
                runs = _lists(g, low, high, {"row": row[own] + top[g], "x0": x0[own] + left[g], "x1": x1[own] + left[g]})
                turns = {"y": y + top[owner], "x_from": x_from + left[owner], "row_from": row_from, "x_to": x_to + left[owner], "row_to": row_to}
                mine = names.slice(low, high - low)
                columns = [*(mine.column(i).combine_chunks() for i in range(n)), *map(pa.array, counts), runs, _lists(owner, low, high, turns)]
                held, of, inner = found[8:]
                members = pa.ListArray.from_arrays(_offsets(of, 0, len(held)), ids.take(pa.array(one[inner])).combine_chunks())
                columns.append(pa.ListArray.from_arrays(_offsets(held, low, high), members))
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, wanted.types)], schema=wanted)

    return edges.mapInArrow(run, shape)
