"""SimHash near duplicates by tiled exact comparison of fingerprints.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set.
Distinct fingerprints are dealt into tiles by the population counts of their four 16-bit
parts. Two fingerprints within the radius differ in those counts by the radius in sum at
most, so all other pairs of tiles are skipped unseen; the pairs of tiles that are left are
compared as whole blocks with exclusive-or and bit counts in numpy.

Crowded tiles are cut into parts of about ``TILE`` fingerprints by a hash, and every pair
of parts is a row of its own, so neither a task nor a group grows with the table. A block
hands on a spanning star of every group of linked fingerprints in place of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import joined_hot, map_rows, stored, table, utf8
from lamella.operators.regions import connected_components

WIDTH, SEED, RADIUS = 3, 42, 2
PARTS, PART_BITS = 4, 16
#: Counts of a part lie in 0..16; with neighbours' steps they stay apart in base 32.
BASE = 32
#: Fingerprints of one part of a tile, and cells of a block that are compared at once.
TILE, CELLS = 1024, 1 << 20

PLACES = (256 * np.arange(8)).astype(np.uint16)
VALUE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``width`` words joined by spaces, A-Z lowered, repeats kept.

    Fewer words are one shingle, no words none.
    """
    import xxhash

    words = utf8(text).lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(words)) - 1 :]
    cut = [line[i:j] for i, j in zip(starts[: len(last)].tolist(), last.tolist(), strict=True)]
    return np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in cut), np.uint64, len(cut))


def fingerprint(hashes: np.ndarray, block: int = 65536) -> int:
    """The 64-bit majority of the hashes; a bit is set in over half of them. None give 0."""
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), block):
        rows = hashes[at : at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        # How often each byte value stands at each place, then the bits of the values.
        spots = np.bincount((rows + PLACES).ravel(), minlength=8 * 256)
        counts += spots.reshape(8, 256) @ VALUE_BITS
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(id, fp)``, one per row of ``docs``; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def step(ids, texts):
            made = np.array([fingerprint(shingle_hashes(t)) for t in texts], np.uint64)
            return ids, made.view(np.int64)

        return step

    return map_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col)), start, f"id {kind}, fp bigint")


def neighbour_steps(radius: int = RADIUS) -> list[int]:
    """Steps between the keys of tiles whose counts differ by ``radius`` in sum at most, one of each two directions."""
    steps = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    return sorted(sum(d * BASE**k for k, d in enumerate(s)) for s in steps if s >= (0,) * PARTS)


def tile_key(fp: Column) -> Column:
    """The population counts of the parts of a fingerprint, as digits."""
    key = F.lit(0)
    for k in range(PARTS):
        part = F.shiftright(fp, PART_BITS * k).bitwiseAND(F.lit((1 << PART_BITS) - 1))
        key = key + F.bit_count(part) * F.lit(BASE**k)
    return key.cast("int")


def block_links(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Stars ``(root, other)`` that connect what the links between ``x`` and ``y`` connect."""
    own, other = [], []
    height = max(1, CELLS // max(1, len(y)))
    for at in range(0, len(x), height):
        near = np.bitwise_count(x[at : at + height, None] ^ y[None, :]) <= radius
        i, j = np.nonzero(near)
        own.append(x[at + i])
        other.append(y[j])
    a, b = np.concatenate([x[:0], *own]), np.concatenate([x[:0], *other])
    real = a != b
    if not real.any():
        return x[:0], x[:0]
    nodes, ends = np.unique(np.concatenate([a[real], b[real]]), return_inverse=True)
    a, b = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        # Roots of both ends move, so a component shrinks to its least node in few rounds.
        np.minimum.at(label, label[a].copy(), low)
        np.minimum.at(label, label[b].copy(), low)
        while (label[label] != label).any():
            label = label[label]
    leaf = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[leaf]], nodes[leaf]


def links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that connect the fingerprints ``fp`` of ``classes`` as all their links do."""
    keyed = classes.select("fp", tile_key(F.col("fp")).alias("key"))
    # At most 17 ** 4 tiles, whatever the table: small enough to send to every task.
    parts = keyed.groupBy("key").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("parts"))
    parts = stored(parts, "tiles")
    cut = keyed.join(F.broadcast(parts), "key").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = stored(cut.groupBy("key", "part").agg(F.collect_list("fp").alias("fps")), "tiles")
    step = F.explode(F.array(*[F.lit(s) for s in neighbour_steps(radius)]))
    near = tiles.select("key", "part", F.col("fps").alias("x"), step.alias("step"))
    near = near.withColumn("to_key", F.col("key") + F.col("step"))
    near = near.join(F.broadcast(parts.select(F.col("key").alias("to_key"), "parts")), "to_key")
    first = F.when(F.col("step") == 0, F.col("part")).otherwise(F.lit(0))
    near = near.select("to_key", F.explode(F.sequence(first, F.col("parts") - 1)).alias("to_part"), "x")
    to = tiles.select(F.col("key").alias("to_key"), F.col("part").alias("to_part"), F.col("fps").alias("y"))
    blocks = near.join(to.hint("shuffle_hash"), ["to_key", "to_part"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            (xs, x_at), (ys, y_at) = [
                (c.values.to_numpy().view(np.uint64), c.offsets.to_numpy().tolist()) for c in batch.columns
            ]
            for k in range(batch.num_rows):
                found = block_links(xs[x_at[k] : x_at[k + 1]], ys[y_at[k] : y_at[k + 1]], radius)
                a.append(found[0])
                b.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"]
            )

    return blocks.mapInArrow(run, "a bigint, b bigint")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """Rows ``(id, fingerprint, component_id)``, one per row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the least id reachable by
    links of at most ``radius`` differing bits. Null, empty and blank texts have
    fingerprint zero and link like any other. Equal rows and equal fingerprints share a
    component; rows of one id with different texts are documents of their own. A row
    without an id has the component of its fingerprint, null if no row there has an id.
    Very long texts are hashed whole, in memory in proportion to one text. Other columns
    are not read, whatever their names. An empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    # Fingerprints of rows without any id still pass links on.
    labels = stored(connected_components(stored(links(classes, radius, tile), "links")), "labels")
    linked = labels.select(F.col("id").alias("fp"), "label").join(classes.select("fp", "least"), "fp")
    lowest = linked.groupBy("label").agg(F.min("least").alias("lowest"))
    found = joined_hot(linked.select("fp", "label"), lowest, "label")
    named = classes.join(found.select("fp", "lowest"), "fp", "left").select(
        "fp", F.coalesce("lowest", "least").alias("component_id"), "n"
    )
    named = stored(named, "components")
    return joined_hot(rows, named.drop("n"), "fp", named.select("fp", "n")).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op11_simhash_components(spark, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"))
