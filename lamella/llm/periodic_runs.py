"""Periodic runs of words, found on a grammar of each text.

Every text's word ids are compressed by Re-Pair: pairs of symbols that recur become a new
symbol, the more frequent of two overlapping pairs first; what is left is joined by a
balanced tree. A run lies across the boundary of the smallest symbol that holds it, so the
runs across a symbol's boundary are computed once, at its first place, whatever the number
of its places, and then translated to all of them. What a symbol cuts off is contained in
the run that a symbol above it finds, so only maximal intervals stay.

Candidates at a boundary come from grams that recur: a run of period q repeats at least
max(12 - q, q) words at distance q around the boundary, hence a gram of half that size that
begins or ends there. Grams have exact names by doubling, and the same names extend a
candidate to both sides in logarithmically many steps.

All steps are array operations on many texts at once. Names and symbols are a text's own,
so nothing depends on which texts are worked on together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import map_rows, table, utf8

#: Least length of a run in words; it also has to hold its period twice.
SHORTEST = 12
#: Words that are worked on at once (a longer text is worked on alone), and candidates.
CHUNK, CANDIDATES = 100_000, 1 << 20

Rewrite = Callable[[object, list[bytes]], list[bytes]]


def grouped(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` ordered by (a, b, x), and the number of each one's group of equal (a, b)."""
    if not len(x):
        return x, x
    bits = [int(v.max()).bit_length() for v in (a, b, x)]
    if sum(bits) < 63:
        v = (a << (bits[1] + bits[2])) | (b << bits[2]) | x
        v.sort()
        x, v = v & ((1 << bits[2]) - 1), v >> bits[2]
        new = v[1:] != v[:-1]
    else:
        order = np.lexsort((x, b, a))
        a, b, x = a[order], b[order], x[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return x, np.concatenate([[0], np.cumsum(new)])


class Grams:
    """Names of the grams of one length: equal ones of a text have one name, and grams that
    occur once in their text have none (-1). ``keys`` holds (name, place), ordered."""

    def __init__(self, length: int, first: np.ndarray, second: np.ndarray, step: int):
        size = len(first)
        x = np.flatnonzero(first[: size - step] >= 0)
        x = x[second[x + step] >= 0]
        x, group = grouped(first[x], second[x + step], x)
        again = np.bincount(group, minlength=1)[group] > 1 if len(x) else np.zeros(0, bool)
        x, group = x[again], group[again]
        self.length, self.shift = length, size.bit_length()
        self.names = np.full(size, -1, np.int64)
        self.names[x] = group
        self.keys = (group << self.shift) | x

    def __len__(self) -> int:
        return len(self.keys)

    def places(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges in ``keys`` of the places from ``low`` to ``high`` of the gram at each of ``at``."""
        name = self.names[at] << self.shift
        first = np.searchsorted(self.keys, name | np.maximum(low, 0), "left")
        return first, np.maximum(np.searchsorted(self.keys, name | np.maximum(high, 0), "right"), first)


def repair(symbols: np.ndarray, live: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Re-Pair of the texts in ``symbols``, each ended by a place of symbol -1.

    ``live`` are the places whose pair of symbols may recur. Returns the places (rule,
    start, middle, end) of all symbols made, in the order in which they were made, and the
    places at which the last symbols start.
    """
    size = len(symbols)
    symbols, after, before = symbols.copy(), np.arange(1, size + 1), np.arange(-1, size - 1)
    before[0] = 0
    alive, rank_at = symbols >= 0, np.zeros(size + 1, np.int64)
    made, rules = int(symbols.max(initial=0)) + 1, {}
    out: list[list[np.ndarray]] = [[], [], [], []]
    while len(live):
        x, group = grouped(symbols[live], symbols[after[live]], live)
        count = np.bincount(group)
        often = count[group] > 1
        x, group = x[often], group[often]
        if not len(x):
            break
        # Rank of each pair: by count, then by a fixed mix, so that no long chain of
        # neighbouring pairs waits for one another.
        rank = np.empty(len(count), np.int64)
        rank[np.lexsort(((np.arange(len(count)) * 2654435761) & 0xFFFFFFFF, count))] = np.arange(1, len(count) + 1)
        mine = rank[group]
        rank_at[x] = mine
        # In a stretch of one symbol, every second pair counts.
        linked = np.concatenate([[False], (after[x[:-1]] == x[1:]) & (group[1:] == group[:-1])])
        place = np.arange(len(x))
        odd = (place - np.maximum.accumulate(np.where(linked, 0, place))) & 1
        use = (odd == 0) & (rank_at[before[x]] <= mine) & (rank_at[after[x]] <= mine)
        rank_at[x] = 0
        s = x[use]
        m = after[s]
        e = after[m]
        pairs = (symbols[s] << 32) | symbols[m]
        distinct, which = np.unique(pairs, return_inverse=True)
        names = np.empty(len(distinct), np.int64)
        for k, pair in enumerate(distinct.tolist()):
            names[k] = rules.setdefault(pair, made + len(rules))
        for column, value in zip(out, (names[which], s, m, e), strict=True):
            column.append(value)
        symbols[s], after[s], before[e], alive[m] = names[which], e, s, False
        live = np.unique(np.concatenate([x[alive[x]], s, before[s]]))
        live = live[(symbols[live] >= 0) & alive[live]]
        live = live[symbols[after[live]] >= 0]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *c]) for c in out), np.flatnonzero(alive)


def tree_over(starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Nodes (start, middle, end) of balanced trees over the symbols of each text."""
    out = []
    while len(starts):
        place = np.arange(len(starts))
        first = np.concatenate([[True], text[1:] != text[:-1]])
        even = (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0
        joined = np.flatnonzero(even[:-1] & (text[1:] == text[:-1]))
        if not len(joined):
            break
        out.append((starts[joined], starts[joined + 1], ends[joined + 1]))
        ends = ends.copy()
        ends[joined] = ends[joined + 1]
        stay = np.ones(len(starts), bool)
        stay[joined + 1] = False
        starts, ends, text = starts[stay], ends[stay], text[stay]
    return out


def common_length(levels: list[Grams], x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Equal words from places ``x`` and ``y`` on (or before them), at most ``most``."""
    done = np.zeros(len(x), np.int64)
    for grams in reversed(levels):
        size = grams.length
        fits = np.flatnonzero(done + size <= most)
        shift = -done[fits] - size if back else done[fits]
        a = grams.names[x[fits] + shift]
        same = (a >= 0) & (a == grams.names[y[fits] + shift])
        done[fits[same]] += size
    return done


def minimal_periods(node: np.ndarray, i: np.ndarray, j: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Indices of the least period of each (node, i, j)."""
    order = np.lexsort((q, j, i, node))
    n, a, b = node[order], i[order], j[order]
    first = np.ones(len(order), bool)
    first[1:] = (n[1:] != n[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order[first]


def runs_across(
    start: np.ndarray, middle: np.ndarray, end: np.ndarray, searches: list[tuple[Grams, int, int]], levels: list[Grams], shortest: int
) -> tuple[np.ndarray, ...]:
    """Runs (node, i, j, q) across the middle of each node, cut off at its ends."""
    found: list[tuple[np.ndarray, ...]] = []
    for grams, least, most in searches:
        size = grams.length
        for offset in (0, -size):
            node = np.flatnonzero(end - start >= max(shortest, 2 * least))
            x = middle[node] + offset
            fits = (x >= start[node]) & (x + size <= end[node])
            node, x = node[fits], x[fits]
            known = grams.names[x] >= 0
            node, x = node[known], x[known]
            for low, high in (
                (x + least, np.minimum(x + most, end[node] - size)),
                (np.maximum(x - most, start[node]), x - least),
            ):
                first, last = grams.places(x, low, high)
                n = np.where(high >= low, last - first, 0)
                some = np.flatnonzero(n)
                # As many candidates at once as memory is meant for.
                slot = np.cumsum(n[some]) // CANDIDATES
                for part in np.split(some, np.flatnonzero(np.diff(slot)) + 1) if len(some) else ():
                    k = np.repeat(part, n[part])
                    at = np.arange(len(k)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
                    y = grams.keys[first[k] + at] & ((1 << grams.shift) - 1)
                    own, p, q = node[k], np.minimum(x[k], y), np.abs(x[k] - y)
                    # The gram is common to both places already.
                    i = p - common_length(levels, p, p + q, p - start[own], back=True)
                    p = p + size
                    j = p + q + common_length(levels, p, p + q, end[own] - p - q, back=False)
                    good = j - i >= np.maximum(shortest, 2 * q)
                    run = own[good], i[good], j[good], q[good]
                    best = minimal_periods(*run)
                    found.append(tuple(v[best] for v in run))
    none = np.zeros(0, np.int64)
    whole = tuple(np.concatenate([none, *c]) for c in zip(*found)) if found else (none,) * 4
    best = minimal_periods(*whole)
    return tuple(v[best] for v in whole)


def runs_of(ids: Sequence[np.ndarray], shortest: int = SHORTEST) -> list[np.ndarray]:
    """The runs (start, length, period) of each sequence of ids, by start, then period.

    A run is a stretch of the smallest period q, of at least max(shortest, 2 q) ids, that
    no neighbour extends. ``shortest`` is 12 or more.
    """
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(ids)
    # Each text takes its ids and one place that ends it; ids are told apart by text.
    sizes = np.array([len(v) for v in ids], np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)])
    total = int(firsts[-1])
    symbols = np.full(total, -1, np.int64)
    base = 0
    for k, v in enumerate(ids):
        if len(v):
            symbols[firsts[k] : firsts[k] + len(v)] = v + base
            base += int(v.max()) + 1
    text = np.repeat(np.arange(len(ids)), sizes + 1)
    often = np.bincount(symbols + 1, minlength=1)[symbols + 1] > 1
    words = np.where(often & (symbols >= 0), symbols, -1)
    one = Grams.__new__(Grams)
    one.length, one.names = 1, words
    two = Grams(2, words, words, 1)
    four = Grams(4, two.names, two.names, 2)
    if not len(four):
        return out
    # A run repeats at least six words: texts without a recurring gram of four hold none.
    able = np.zeros(len(ids), bool)
    able[text[four.names >= 0]] = True
    levels = [one, two, four]
    while len(levels[-1]):
        half = levels[-1]
        levels.append(Grams(2 * half.length, half.names, half.names, half.length))
    levels.pop()
    three = Grams(3, two.names, words, 2)
    searches = [(three, 1, 7)] + [(g, 2 * g.length, 4 * g.length - 1) for g in levels[2:]]

    live = np.flatnonzero((two.names >= 0) & able[text])
    (rule, s, m, e), starts = repair(symbols, live)
    starts = starts[able[text[starts]]]
    ends = np.concatenate([starts[1:], [total]])
    last = np.concatenate([text[starts][1:] != text[starts][:-1], [True]])
    ends[last] = firsts[text[starts[last]] + 1] - 1
    # A rule's first place stands for all its places; a tree node has one place.
    kinds, first, kind = np.unique(rule, return_index=True, return_inverse=True)
    nodes = [(s[first], m[first], e[first]), *tree_over(starts, ends, text[starts])]
    start, middle, end = (np.concatenate(c) for c in zip(*nodes))
    node, i, j, q = runs_across(start, middle, end, searches, levels, shortest)

    by_rule = np.argsort(kind, kind="stable")
    held = np.bincount(kind, minlength=len(start))
    held[len(kinds) :] = 1
    at = np.concatenate([[0], np.cumsum(held)])
    shifts = np.concatenate([s[by_rule] - start[kind[by_rule]], np.zeros(len(start) - len(kinds), np.int64)])
    k = np.repeat(np.arange(len(node)), held[node])
    turn = np.arange(len(k)) - np.repeat(np.cumsum(held[node]) - held[node], held[node])
    shift = shifts[at[node[k]] + turn]
    i, j, q = i[k] + shift, j[k] + shift, q[k]

    # Of one period, intervals within another one are parts of it.
    order = np.lexsort((-j, i, q))
    i, j, q = i[order], j[order], q[order]
    if len(q):
        far = np.maximum.accumulate(np.searchsorted(np.unique(q), q) * (total + 1) + j)
        whole = np.concatenate([[True], far[1:] > far[:-1]])
        i, j, q = i[whole], j[whole], q[whole]
    best = minimal_periods(np.zeros(len(i), np.int64), i, j, q)
    i, j, q = i[best], j[best], q[best]
    order = np.lexsort((q, i))
    i, j, q = i[order], j[order], q[order]
    owner = text[i]
    rows = np.stack([i - firsts[owner], j - i, q], axis=1)
    cuts = np.searchsorted(owner, np.arange(len(ids) + 1))
    for k in np.unique(owner).tolist():
        out[k] = rows[cuts[k] : cuts[k + 1]]
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period, joined by spaces."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shortest: int = SHORTEST,
    rewrite: Rewrite | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows ``(id, n_words, runs, collapsed)``, one per row of ``docs``.

    ``runs`` holds (start, length, period) by start, then period; ``collapsed`` is the text
    as UTF-8, its words joined by one space, without those that repeat a run's first
    period. ``rewrite`` may change a row's words first. Words are runs of other characters
    than ASCII white space. Null, empty and blank texts have no words and no runs. Rows are
    independent, so repeated rows and ids have one result each and ties do not arise. A
    very long text is worked on alone, in memory in proportion to it (times the logarithm
    of its longest repeat). Other columns are not read; an empty table has an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def step(ids, texts):
            words = [utf8(t).split() for t in texts]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
            runs, part, held = [], [], 0
            for w in words:
                if part and held + len(w) > chunk:
                    runs += runs_of(part, shortest)
                    part, held = [], 0
                known: dict[bytes, int] = {}
                part.append(np.array([known.setdefault(v, len(known)) for v in w], np.int64))
                held += len(w)
            runs += runs_of(part, shortest)
            listed = [[dict(zip(("start", "length", "period"), r)) for r in v.tolist()] for v in runs]
            return ids, [len(w) for w in words], listed, [collapsed(w, r) for w, r in zip(words, runs, strict=True)]

        return step

    schema = f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    made = map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col)), start, schema)
    return made.withColumnRenamed("id", id_col)


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, chosen by their id, made periodic from a place on."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark, folder: str) -> DataFrame:
    found = periodic_runs(table(spark, folder, "documents"), rewrite=planted)
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("best", F.array_max(ranked))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.l div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )
