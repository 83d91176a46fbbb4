"""Hard negatives by bounds along a spanning tree of the anchors.

Anchors of one label are dealt into blocks of about ``BLOCK``; each block gets a minimum
spanning tree. Rows are scored in tiles, anchor by anchor in the order of the tree: the
scores of a tile lie within an interval around those at the parent anchor, as wide as the
edge's length times the row's norm (Cauchy and Schwarz). Only rows whose interval meets the
anchor's window are scored again; the others pass their interval on. A window is what may
still enter the anchor's list: better than its worst member, and for negatives within the
given shares of a positive's score.

Anchors are a share of the table, so their blocks are sent out in rounds of bounded size;
each round reads the rows once. Every task hands on its best rows per list, and a rank over
those few gives the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import bounded_rows, map_rows, stored, table

#: Anchors of a block, rows of a tile, and bytes of the blocks of one round.
BLOCK, TILE, ROUND_BYTES = 512, 4096, 16_000_000
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of its positive's.
SHARES = (30, 90)
LONGEST = np.iinfo(np.int64).max
FAR = LONGEST // 200


def spanning_tree(vectors: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Prim's tree: the order, each one's parent (a place in the order; -1 for the first) and edge."""
    v = vectors.astype(np.float64)
    n = len(v)
    squares = (v * v).sum(axis=1)
    order, parents, edges = [0], [-1], [0.0]
    best, by = np.full(n, np.inf), np.zeros(n, np.int64)
    best[0] = -np.inf
    last = 0
    for _ in range(n - 1):
        away = squares + squares[last] - 2 * (v @ v[last])
        nearer = away < best
        best[nearer], by[nearer] = away[nearer], len(order) - 1
        last = int(np.argmin(np.where(np.isneginf(best), np.inf, best)))
        order.append(last)
        parents.append(int(by[last]))
        # From the difference itself, so that copies are at distance zero.
        edges.append(float(np.sqrt(((v[last] - v[order[parents[-1]]]) ** 2).sum())))
        best[last] = -np.inf
    return order, parents, np.array(edges)


class Tile:
    """Rows of one tile, with exact scores and with bounds on them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        wide = vectors.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(axis=1))
        self.largest = float(self.norms.max(initial=0.0))
        self.single, self.double = vectors.astype(np.float32), wide

    def only(self, keep: np.ndarray) -> Tile:
        return Tile(self.ids[keep], self.labels[keep], self.vectors[keep])

    def scores(self, anchor: np.ndarray, norm: float, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact integer scores: in the narrowest arithmetic in which every sum is exact."""
        pick = (lambda m: m) if rows is None else (lambda m: m[rows])
        most = 2 * norm * self.largest
        if most < 1 << 24:
            return (pick(self.single) @ anchor.astype(np.float32)).astype(np.int64)
        if most < 1 << 53:
            return (pick(self.double) @ anchor.astype(np.float64)).astype(np.int64)
        exact = pick(self.vectors).astype(object) @ anchor.astype(object)
        return np.array([min(max(int(s), -FAR), FAR) for s in exact], np.int64)


def walk(tile: Tile, block: dict, window: Callable, take: Callable, usable: np.ndarray | None) -> int:
    """Score a tile at every anchor of a block; the number of scores computed.

    ``window(k)`` is the interval of scores that still matter at anchor k, or None;
    ``take(k, rows, scores)`` gets the rows scored there. Rows outside ``usable`` only
    carry their bounds on.
    """
    lows: dict[int, np.ndarray] = {}
    highs: dict[int, np.ndarray] = {}
    waiting = list(block["children"])
    scored = 0
    for k, parent in enumerate(block["parents"]):
        limits = window(k)
        if parent < 0:
            low = high = tile.scores(block["vectors"][k], block["norms"][k]).astype(np.float64)
            rows = np.arange(len(tile.ids)) if usable is None else np.flatnonzero(usable)
            exact = low[rows].astype(np.int64) if abs(low).max(initial=0) < 1 << 53 else tile.scores(block["vectors"][k], block["norms"][k], rows)
            scored += len(low)
        else:
            # A little wider than the bound, for the rounding of norms and edges.
            reach = tile.norms * (block["edges"][k] * (1 + 1e-9))
            reach += 1e-9 * np.abs(highs[parent]) + 1e-3
            low, high = lows[parent] - reach, highs[parent] + reach
            rows = np.zeros(0, np.int64)
            if limits is not None:
                meets = (high >= limits[0]) & (low <= limits[1])
                rows = np.flatnonzero(meets if usable is None else meets & usable)
            if len(rows):
                whole = len(rows) == len(tile.ids)
                exact = tile.scores(block["vectors"][k], block["norms"][k], None if whole else rows)
                low[rows] = high[rows] = exact
                scored += len(rows)
            waiting[parent] -= 1
            if not waiting[parent]:
                del lows[parent], highs[parent]
        if waiting[k]:
            lows[k], highs[k] = low, high
        if limits is not None and len(rows):
            take(k, rows, exact)
    return scored


class Best:
    """The first rows of a list, by score descending, then id."""

    def __init__(self, size: int):
        self.size = size
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        return -LONGEST if len(self.ids) < self.size else int(self.scores[-1])

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least()
        if good.any():
            ids, scores = np.concatenate([self.ids, ids[good]]), np.concatenate([self.scores, scores[good]])
            first = np.lexsort((ids, -scores))[: self.size]
            self.ids, self.scores = ids[first], scores[first]


def unpacked(row, positives: dict | None = None) -> dict:
    """A stored block as arrays, with each anchor's positives ``(id, score)``."""
    vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(row["ids"]), -1)
    children = [0] * len(row["ids"])
    for p in row["parents"]:
        if p >= 0:
            children[p] += 1
    wide = vectors.astype(np.float64)
    return {
        "ids": list(row["ids"]),
        "label": row["label"],
        "parents": list(row["parents"]),
        "edges": list(row["edges"]),
        "vectors": vectors,
        "norms": np.sqrt((wide * wide).sum(axis=1)).tolist(),
        "children": children,
        "positives": [positives.get(i, []) for i in row["ids"]] if positives is not None else [],
    }


def tiles(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[Tile]:
    """Tiles of up to ``size`` rows from batches (id, label, vector); short vectors end in zeros."""
    held: list[list[np.ndarray]] = [[], [], []]
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        values, at = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
        lengths = np.diff(at)
        if (lengths == width).all():
            vectors = values[at[0] : at[-1]].reshape(-1, width)
        else:
            vectors = np.zeros((batch.num_rows, width), np.int64)
            for k in range(batch.num_rows):
                part = values[at[k] : at[k + 1]][:width]
                vectors[k, : len(part)] = part
        parts = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), vectors]
        for column, part in zip(held, parts, strict=True):
            column.append(part)
        count += batch.num_rows
        if count >= size:
            yield Tile(*[np.concatenate(c) for c in held])
            held, count = [[], [], []], 0
    if count:
        yield Tile(*[np.concatenate(c) for c in held])


def nearest_rows(rows: DataFrame, blocks: list, width: int, positives: int, tile: int) -> DataFrame:
    """Rows ``(anchor_id, id, score)``: every task's best rows of the anchors' own labels."""
    held = rows.sparkSession.sparkContext.broadcast(blocks)

    def run(batches):
        made = [unpacked(b) for b in held.value]
        lists = [[Best(positives) for _ in b["ids"]] for b in made]
        for t in tiles(batches, tile, width):
            parts: dict = {}
            for block, best in zip(made, lists, strict=True):
                label = block["label"]
                if label not in parts:
                    parts[label] = t.only(np.flatnonzero(t.labels == label))
                mine = parts[label]
                if len(mine.ids):

                    def take(k, at, scores, mine=mine, block=block, best=best):
                        other = mine.ids[at] != block["ids"][k]
                        best[k].add(mine.ids[at][other], scores[other])

                    walk(mine, block, lambda k, best=best: (best[k].least(), LONGEST), take, None)
        for block, best in zip(made, lists, strict=True):
            n = [len(b.ids) for b in best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(block["ids"], np.int64), n)),
                    pa.array(np.concatenate([b.ids for b in best])),
                    pa.array(np.concatenate([b.scores for b in best])),
                ],
                names=["anchor_id", "id", "score"],
            )

    made = rows.select("id", "label", "vector").mapInArrow(run, "anchor_id bigint, id bigint, score bigint")
    kept = stored(made, "nearest")
    held.destroy()
    return kept


def negatives_in_windows(
    rows: DataFrame, blocks: list, positives: dict, width: int, negatives: int, shares: tuple[int, int], tile: int
) -> DataFrame:
    """Every task's best rows of other labels within the window of each positive."""
    held = rows.sparkSession.sparkContext.broadcast((blocks, positives))

    def run(batches):
        listed, by_anchor = held.value
        made = [unpacked(b, by_anchor) for b in listed]
        lists = [[[Best(negatives) for _ in p] for p in b["positives"]] for b in made]
        # Windows in hundredths of a score; an empty one of a negative positive stays empty.
        spans = [[[(shares[0] * s, shares[1] * s) for _, s in p] for p in b["positives"]] for b in made]
        for t in tiles(batches, tile, width):
            for block, best, span in zip(made, lists, spans, strict=True):

                def window(k, best=best, span=span):
                    low = [max(-(-a // 100), b.least()) for (a, z), b in zip(span[k], best[k]) if a <= z]
                    high = [z // 100 for a, z in span[k] if a <= z]
                    return (min(low), max(high)) if low else None

                def take(k, at, scores, best=best, span=span, t=t):
                    for (a, z), b in zip(span[k], best[k]):
                        good = np.flatnonzero((scores >= -(-a // 100)) & (scores <= z // 100) & (scores >= b.least()))
                        if len(good):
                            b.add(t.ids[at[good]], scores[good])

                walk(t, block, window, take, t.labels != block["label"])
        for block, best in zip(made, lists, strict=True):
            kept = [
                (anchor, p, s, b)
                for anchor, own, found in zip(block["ids"], block["positives"], best, strict=True)
                for (p, s), b in zip(own, found, strict=True)
                if len(b.ids)
            ]
            if kept:
                n = [len(b.ids) for *_, b in kept]
                head = [pa.array(np.repeat(np.array(c, np.int64), n)) for c in list(zip(*kept))[:3]]
                tail = [pa.array(np.concatenate([getattr(b, c) for *_, b in kept])) for c in ("ids", "scores")]
                yield pa.RecordBatch.from_arrays([*head, *tail], names=NEGATIVE_COLUMNS)

    made = rows.select("id", "label", "vector").mapInArrow(run, ", ".join(f"{c} bigint" for c in NEGATIVE_COLUMNS))
    kept = stored(made, "negatives")
    held.destroy()
    return kept


NEGATIVE_COLUMNS = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]


def anchor_blocks(anchors: DataFrame, width: int, block: int, round_bytes: int) -> tuple[DataFrame, int]:
    """Rows ``(label, ids, parents, edges, vectors, turn)``: trees, dealt to rounds of bounded size;
    and the number of rounds."""
    sizes = anchors.groupBy("label").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts"))
    dealt = anchors.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    groups = dealt.groupBy("label", "part").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("a"))

    def start():
        def step(labels, ids, vectors):
            out: list[list] = [[], [], [], [], []]
            for label, own, lists in zip(labels, ids, vectors, strict=True):
                v = np.zeros((len(own), width), np.int64)
                for k, part in enumerate(lists):
                    v[k, : len(part)] = part
                order, parents, edges = spanning_tree(v)
                row = (label, [own[k] for k in order], parents, edges.tolist(), v[order].tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return step

    kind = anchors.schema["label"].dataType.simpleString()
    schema = f"label {kind}, ids array<bigint>, parents array<int>, edges array<double>, vectors binary"
    trees = stored(map_rows(groups.select("label", "a.id", "a.vector"), start, schema), "trees")
    weight = trees.agg(F.sum(F.octet_length("vectors") + 100 * F.size("ids"))).first()[0] or 0
    turns = -(-weight // round_bytes) or 1
    return trees.withColumn("turn", F.pmod(F.xxhash64("label", F.get("ids", 0)), F.lit(turns)).cast("int")), turns


def finite(vector: Column) -> Column:
    """Whether a vector has no null and no non-finite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def hard_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    shares: tuple[int, int] = SHARES,
    block: int = BLOCK,
    tile: int = TILE,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """Rows ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` holds id (long), label (an integer type), vector (array of longs) and anchor
    (boolean); other columns are not read. A score is the inner product with the anchor,
    higher ones first, ties by id. The positives of an anchor are the first other rows of
    its label, the negatives of a positive the first rows of other labels with
    ``shares[0] * positive <= 100 * negative <= shares[1] * positive``.

    Rows with a null id, label or vector, or a null component, take no part; a null
    ``anchor`` is false. Of several rows of one id, equal or not, the least (label, vector)
    counts, as an anchor if any of them is one. Shorter vectors count as ending in zeros.
    Scores beyond about 4.6e16 saturate there. Anchors without positives, or without rows
    in the windows, have no rows; neither has an empty table.
    """
    whole = F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False))
    clean = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & whole).select(
        "id", "label", "vector", F.coalesce("anchor", F.lit(False)).alias("anchor")
    )
    clean = stored(clean, "rows")
    often = clean.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    one = clean.join(often, "id", "left_semi").groupBy("id").agg(
        F.min(F.struct("label", "vector")).alias("v"), F.max("anchor").alias("anchor")
    )
    several = one.select("id", "v.label", "v.vector", "anchor")
    clean = stored(clean.join(often, "id", "left_anti").unionByName(several), "rows")
    width = max(1, clean.agg(F.max(F.size("vector"))).first()[0] or 1)
    blocks, turns = anchor_blocks(clean.where("anchor"), width, block, round_bytes)
    found = None
    for turn in range(turns):
        # One round's blocks and positives: bounded by round_bytes, whatever the table.
        own = [r.asDict() for r in blocks.where(F.col("turn") == turn).coalesce(1).toLocalIterator()]
        if not own:
            continue
        near = nearest_rows(clean, own, width, positives, tile)
        order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
        first = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
        by_anchor: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(bounded_rows(first.select("anchor_id", "rank", "id", "score"), "positives")):
            by_anchor.setdefault(r["anchor_id"], []).append((r["id"], r["score"]))
        part = negatives_in_windows(clean, own, by_anchor, width, negatives, shares, tile)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = clean.sparkSession.createDataFrame([], ", ".join(f"{c} bigint" for c in NEGATIVE_COLUMNS))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, folder: str) -> DataFrame:
    given = table(spark, folder, "embeddings").where(F.col("label").isNotNull() & finite(F.col("embedding")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(
        given.select(
            F.col("vec_id").alias("id"),
            moved.cast("bigint").alias("label"),
            F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"),
            (F.col("vec_id") % 100 == 0).alias("anchor"),
        )
    )
