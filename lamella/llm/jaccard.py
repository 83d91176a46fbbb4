"""Size-aware heavy-light join on the Jaccard similarity of word n-gram sets.

Two sets of sizes a and b reach the similarity exactly when they share c(a, b) elements.

* Light sets (up to a boundary size) enumerate their subsets of c(a, b) elements for every
  partner size b: light sets that share such a subset are partners.
* Heavy sets are found by scanning inverted lists: every set posts its first elements
  under one global order, as many as a partner must meet (a - ceil(t a) + 1), and partners
  meet in a list. The order is by hash, with the elements that many documents hold last,
  so that common passages make no long lists. Light sets within reach of a heavy one post
  there as well.

The boundary has the least estimated cost of subsets and postings, from the sizes of all
sets. Copies of one set stand for each other throughout.

What is wanted of a list is connectivity, not all its pairs: each list's smallest set is
compared with the others (a star). Lists whose members are then all connected are done.
Lists that still hold several components get further stars between the components, from
other pivots, and what is left is compared pair by pair across components, so that no
link is missed and no pair inside a component is ever formed. Every candidate is verified
on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lamella.llm.common import bounded_rows, counted, discard, joined_hot, map_rows, stored, table, utf8
from lamella.operators.regions import connected_components

#: Words of an element, and the similarity in hundredths.
WIDTH = 5
SIMILAR = 75
#: A set beyond this size is never light, whatever the costs.
LIGHT_MOST = 24
#: Weight of one posting (shuffle, sort and verification) against one enumerated subset.
POSTING_COST = 8.0
#: Elements that are ordered last: at most so many, each in at least so many documents by
#: the tasks' summaries. Any choice gives the same links; it only keeps the lists short.
COMMON_MOST = 200_000
COMMON_FILES = 16
SUMMARY = 50_000
#: Further stars before the pairs across components.
STARS = 1
#: Least and greatest size of a filter of documents, in bits as a power of two; 2 ** 28 bits are
#: 32 MB. A filter that is too small lets other documents pass, which costs work and changes nothing.
FILTER_BITS = (16, 28)


def shared(a: int, b: int, similar: int = SIMILAR) -> int:
    """Least common elements of sets of sizes a and b: 100 i >= similar (a + b - i)."""
    return -(-similar * (a + b) // (100 + similar))


def element_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams.

    Words are runs of other characters than ASCII white space, with A-Z lowered; fewer
    than ``width`` words are one element, no words none.
    """
    import xxhash

    words = utf8(text).lower().split()
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        # Each place mixes its word before the sum, so that places do not commute.
        total = (total ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(32)))


class Summary:
    """Frequent elements of a task in bounded memory: counts of the heaviest are kept."""

    def __init__(self, keep: int = SUMMARY, buffer: int = 1_000_000):
        self.keep, self.buffer = keep, buffer
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, elements: np.ndarray) -> None:
        self.waiting.append(elements)
        self.size += len(elements)
        if self.size >= self.buffer:
            self.merge()

    def merge(self) -> None:
        new, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.waiting]), return_counts=True)
        several = counts > 1
        # An element once in the buffer matters only if it is known already.
        several |= np.isin(new, self.keys, assume_unique=True)
        keys = np.concatenate([self.keys, new[several]])
        self.keys, place = np.unique(keys, return_inverse=True)
        self.counts = np.bincount(place, np.concatenate([self.counts, counts[several]])).astype(np.int64)
        if len(self.keys) > self.keep:
            best = np.sort(np.argpartition(-self.counts, self.keep)[: self.keep])
            self.keys, self.counts = self.keys[best], self.counts[best]
        self.waiting, self.size = [], 0


def profiles(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows ``(id, n, sig, keys, counts)``: sizes and 128-bit signatures of the sets; rows
    with a null ``sig`` hold a task's frequent elements instead."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        import xxhash

        summary, id_type = Summary(), None

        def batch_of(ids, n, sig, keys, counts):
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(n, pa.int64()),
                    pa.array(sig, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(counts, pa.list_(pa.int64())),
                ],
                names=["id", "n", "sig", "keys", "counts"],
            )

        for batch in batches:
            id_type = batch.schema.types[0]
            n, sig = [], []
            for text in batch.column(1).to_pylist():
                elements = element_hashes(text, width)
                summary.add(elements)
                n.append(len(elements))
                sig.append(xxhash.xxh3_128_digest(elements.tobytes()))
            nothing = [None] * len(n)
            yield batch_of(batch.column(0), n, sig, nothing, nothing)
        if id_type is not None:
            summary.merge()
            often = summary.counts > 1
            yield batch_of([None], [0], [None], [summary.keys[often].view(np.int64)], [summary.counts[often]])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col))
    return rows.mapInArrow(run, f"id {kind}, n bigint, sig binary, keys array<bigint>, counts array<bigint>")


def light_boundary(sizes: dict[int, int], similar: int = SIMILAR, posting: float = POSTING_COST) -> int:
    """The largest light size, of least estimated cost, from the number of sets by size."""

    def subsets(a: int) -> int:
        least, most = shared(a, 0, similar), a * 100 // similar
        partners = range(max(1, -(-similar * a // 100)), most + 1)
        return sum(comb(a, shared(a, b, similar)) for b in partners if least <= a and shared(a, b, similar) <= min(a, b))

    def prefix(a: int) -> int:
        return a - -(-similar * a // 100) + 1

    def cost(light: int) -> float:
        enumerated = sum(sizes.get(a, 0) * subsets(a) for a in range(1, light + 1))
        reach = -(-similar * (light + 1) // 100)
        posted = sum(n * prefix(a) for a, n in sizes.items() if reach <= a <= LIGHT_MOST)
        return enumerated + posting * posted

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def light_keys(elements: np.ndarray, similar: int) -> list[int]:
    """Keys of the subsets a light set may share with a light partner of each size."""
    from itertools import combinations

    import xxhash

    a, keys = len(elements), []
    values = [v.tobytes() for v in elements]
    for b in range(-(-similar * a // 100), a * 100 // similar + 1):
        c = shared(a, b, similar)
        if c <= min(a, b):
            head = f"{min(a, b)} {max(a, b)} ".encode()
            keys += [xxhash.xxh64_intdigest(head + b"".join(s)) for s in combinations(values, c)]
    return keys


def postings(
    docs: DataFrame, heads: DataFrame, n_heads: int, common: list[int], light: int, id_col: str, text_col: str, width: int, similar: int
) -> DataFrame:
    """Rows ``(id, n, whole_rare, light, rare, often)`` of the sets of ``heads``.

    The filter may let a few copies of a head pass; they are linked with it like others.

    ``light`` holds the subset keys, ``rare`` and ``often`` the posted elements in their
    order; ``whole_rare`` is the number of elements of the whole set that are not common.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((np.array(sorted(common), np.int64).tobytes(), bit_filter(heads, n_heads)))

    def start():
        listed, (words, bits) = held.value
        last, wanted = np.sort(np.frombuffer(listed, np.int64).view(np.uint64)), BitFilter(words, bits)

        def step(ids, texts, hashes):
            out: list[list] = [[] for _ in range(6)]
            for key, text, use in zip(ids, texts, wanted.has(hashes).tolist(), strict=True):
                elements = element_hashes(text, width) if use else ()
                a = len(elements)
                if not a:
                    continue
                keys = light_keys(elements, similar) if a <= light else []
                late = np.zeros(a, bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, elements), len(last) - 1)] == elements
                rare, often = elements[~late], elements[late]
                # Sets that only light ones can be similar to need no lists of elements.
                first = a - -(-similar * a // 100) + 1 if 100 * a >= similar * (light + 1) else 0
                often = often[: max(0, first - len(rare))]
                row = (key, a, len(rare), np.array(keys, np.uint64).view(np.int64), rare[:first].view(np.int64), often.view(np.int64))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out if out[0] else None

        return step

    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col), F.xxhash64(id_col).alias("h")
    )
    schema = f"id {kind}, n bigint, whole_rare bigint, light array<bigint>, rare array<bigint>, often array<bigint>"
    return map_rows(rows, start, schema)


def lists_with_pivots(posted: DataFrame) -> DataFrame:
    """Rows ``(key, pivot, pivot_n, pivot_most, id, n, most, kind, posted, n_often)`` of the lists
    with several documents.

    ``most`` is the greatest number of elements a document has to share with another one
    for which this list matters. In a list of a rare element that is its size, and the
    pivot is the smallest set; these lists are short, so a window finds it. Documents of a
    list of a common element have posted all their rare ones, so two of them that share a
    rare element meet in its list; here they share common elements at most. The pivot is
    the document with the largest part of those. These lists, at most COMMON_MOST, may be
    long: their pivots are aggregates, combined before the shuffle and broadcast, and
    their rows stay in place.
    """
    sizes = [(F.size("rare") + F.size("often")).alias("posted"), F.size("often").alias("n_often")]
    # Keys of subsets are marked: partners that share one need no further bound.
    keyed = F.concat(
        F.transform("light", lambda k: F.struct(k.alias("key"), F.lit(0).alias("kind"))),
        F.transform("rare", lambda k: F.struct(k.alias("key"), F.lit(1).alias("kind"))),
    )
    rare = posted.select(F.explode(keyed).alias("_k"), "id", "n", *sizes).select("_k.key", "_k.kind", "id", "n", "posted", "n_often")
    order = Window.partitionBy("key").orderBy("n", "id")
    short = rare.select(
        "key",
        F.first("id").over(order).alias("pivot"),
        F.first("n").over(order).alias("pivot_n"),
        F.first("n").over(order).alias("pivot_most"),
        "id",
        "n",
        F.col("n").alias("most"),
        "kind",
        "posted",
        "n_often",
        F.lead("id").over(order).alias("_next"),
    )
    short = short.where((F.col("id") != F.col("pivot")) | F.col("_next").isNotNull()).drop("_next")
    often = posted.where(F.size("often") > 0).select(
        F.explode("often").alias("key"),
        "id",
        "n",
        (F.col("n") - F.col("whole_rare")).alias("most"),
        F.lit(2).alias("kind"),
        *sizes,
    )
    pivots = (
        often.groupBy("key")
        .agg(F.max(F.struct(F.col("most") / F.col("n"), "n", "id", "most")).alias("p"), F.count("*").alias("m"))
        .where("m > 1")
        .select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.most").alias("pivot_most"))
    )
    return short.unionByName(often.join(F.broadcast(pivots), "key").select(*short.columns))


def pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def within_reach(n: str, most: str, m: str, its_most: str, similar: int) -> Column:
    """Whether sets of sizes ``n`` and ``m`` are similar if they share the most they can."""
    common = F.least(n, most, m, its_most)
    return (100 + similar) * common >= similar * (F.col(n) + F.col(m))


def plausible(pairs: DataFrame, posted: DataFrame, similar: int) -> DataFrame:
    """The ``counted`` pairs whose posted elements leave similarity possible.

    Up to the lesser of the ends of the two posted parts, all elements of both sets are
    known; beyond it, the smaller rest may be shared at most.
    """
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    mine = with_maybe(posted, ends, "id", 2 * pairs.n_rows).where("_maybe")
    parts = mine.select("id", "n", "rare", "often", (F.size("light") > 0).alias("small"))

    def side(name: str) -> DataFrame:
        return parts.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "rare", "often", "small")])

    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def known(n, rare, often):
        """Posted elements in their order, and whether they are the whole set."""
        return np.array(rare, np.int64).view(np.uint64), np.array(often, np.int64).view(np.uint64), len(rare) + len(often) >= n

    def bound(n, x, m, y) -> int:
        if x[2] or y[2]:
            (rare, often, _), (its_rare, its_often, _) = x, y
            if x[2] and y[2]:
                return len(np.intersect1d(rare, its_rare, True)) + len(np.intersect1d(often, its_often, True))
        common, own, its = 0, 0, 0
        # The end of each part: in the common elements if it has any, else in the rare ones.
        ends = [(1, p[1][-1]) if len(p[1]) else (0, p[0][-1]) for p in (x, y) if not p[2]]
        late, last = min(ends)
        for flag, e, f in ((0, x[0], y[0]), (1, x[1], y[1])):
            if flag < late:
                e_in, f_in = e, f
            elif flag == late:
                e_in, f_in = e[e <= last], f[f <= last]
            else:
                continue
            own, its = own + len(e_in), its + len(f_in)
            common += len(np.intersect1d(e_in, f_in, True))
        return common + min(n - own, m - its)

    def start():
        def step(a, b, n, rare, often, small, m, its_rare, its_often, its_small):
            keep = []
            for k in range(len(a)):
                if small[k] or its_small[k]:
                    keep.append(k)
                    continue
                most = bound(n[k], known(n[k], rare[k], often[k]), m[k], known(m[k], its_rare[k], its_often[k]))
                if (100 + similar) * most >= similar * (n[k] + m[k]):
                    keep.append(k)
            return ([a[k] for k in keep], [b[k] for k in keep]) if keep else None

        return step

    kind = pairs.schema["a"].dataType.simpleString()
    columns = ["a", "b", *[f"{s}_{c}" for s in ("a", "b") for c in ("n", "rare", "often", "small")]]
    return map_rows(both.select(*columns), start, f"a {kind}, b {kind}").distinct()


class BitFilter:
    """A Bloom filter of ids by their hash, of bounded size whatever the number of rows."""

    def __init__(self, words: bytes, bits: int):
        self.words, self.bits = np.frombuffer(words, np.int64).view(np.uint64), bits

    def has(self, hashes: list[int]) -> np.ndarray:
        h = np.array(hashes, np.int64).view(np.uint64)
        found = np.ones(len(h), bool)
        for spot in (h >> np.uint64(64 - self.bits), h & np.uint64((1 << self.bits) - 1)):
            found &= (self.words[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        return found


def bit_filter(ids: DataFrame, n: int) -> tuple[bytes, int]:
    """The words and size of a filter of the ``n`` values of the column ``id``: 16 bits each, within FILTER_BITS."""
    low, high = FILTER_BITS
    bits = min(high, max(low, (16 * n).bit_length()))
    h = F.xxhash64("id")
    spots = ids.select(F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), F.pmod(h, F.lit(1 << bits)))).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("spot", F.lit(64)).cast("int"))).alias("bits")
    )
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in bounded_rows(words, "filter"):
        out[r["word"]] = r["bits"]
    return out.tobytes(), bits


def with_maybe(docs: DataFrame, ids: DataFrame, id_col: str, n: int) -> DataFrame:
    """``docs`` with a column ``_maybe``: false only where the id is surely not in the ``n`` rows of ``ids``.

    What is surely elsewhere needs no join, so that texts are shuffled for the rest alone.
    A null id is in none.
    """
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, n))

    def start():
        wanted = BitFilter(*held.value)
        return lambda hashes: [wanted.has(hashes).tolist()]

    h = F.xxhash64(id_col).alias("_h")
    marked = map_rows(docs.select(h, *docs.columns), start, "_maybe boolean", len(docs.columns))
    return marked.withColumn("_maybe", F.col("_maybe") & F.col(id_col).isNotNull())


def sets_of(docs: DataFrame, ids: DataFrame, n: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows ``(id, elements)`` of the documents in the ``n`` rows of ``ids`` (and maybe a few others)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, n))

    def start():
        wanted = BitFilter(*held.value)

        def step(ids, texts, hashes):
            use = np.flatnonzero(wanted.has(hashes)).tolist()
            if not use:
                return None
            return [ids[k] for k in use], [element_hashes(texts[k], width).tobytes() for k in use]

        return step

    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col), F.xxhash64(id_col).alias("h")
    )
    return map_rows(rows, start, f"id {kind}, elements binary")


def verified(
    pairs: DataFrame, posted: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similar: int
) -> DataFrame:
    """Those of the ``counted`` pairs ``(a, b)`` whose whole sets are similar, counted too."""
    kind = pairs.schema["a"].dataType.simpleString()
    if pairs.n_rows:
        pairs = counted(plausible(pairs, posted, similar), "plausible")
    if not pairs.n_rows:
        return counted(pairs.select("a", "b"), "links")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = stored(sets_of(docs, ends, 2 * pairs.n_rows, id_col, text_col, width), "sets")
    first = pairs.join(sets.select(F.col("id").alias("a"), F.col("elements").alias("x")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("elements").alias("y")), "b")

    def start():
        def step(a, b, x, y):
            keep = []
            for k in range(len(a)):
                s, t = np.frombuffer(x[k], np.uint64), np.frombuffer(y[k], np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                if len(s):
                    common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
                    if 100 * common >= similar * (len(s) + len(t) - common):
                        keep.append(k)
            return ([a[k] for k in keep], [b[k] for k in keep]) if keep else None

        return step

    links = counted(map_rows(both.select("a", "b", "x", "y"), start, f"a {kind}, b {kind}").distinct(), "links")
    discard(sets)
    discard(pairs)
    return links


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    similar: int = SIMILAR,
    light: int | None = None,
    common_files: int = COMMON_FILES,
    stars: int = STARS,
) -> DataFrame:
    """Rows ``(id, n_shingles, component_id)``, one per row of ``docs``.

    ``component_id`` is the least id reachable by links. Rows of one id with different
    texts are one document with the links of all of them. Null and empty texts have empty
    sets, which link with nothing. A row without an id takes the component of an identical
    set (null if all of those have no id) and links with nothing else.
    ``light`` fixes the boundary that is otherwise chosen by cost.
    """
    profile = stored(profiles(docs, id_col, text_col, width), "profiles")
    rows = profile.where(F.col("sig").isNotNull()).select("id", "n", "sig")
    often = (
        profile.where(F.col("sig").isNull())
        .select(F.explode(F.arrays_zip("keys", "counts")).alias("e"))
        .groupBy(F.col("e.keys").alias("key"))
        .agg(F.sum("e.counts").alias("m"))
        .where(F.col("m") >= common_files)
        .orderBy(F.desc("m"), "key")
        .limit(COMMON_MOST)
    )
    common = [r["key"] for r in bounded_rows(often.select("key"), "common")]
    sets = rows.where("n > 0").groupBy("sig")
    classes = counted(sets.agg(F.min("id").alias("rep"), F.first("n").alias("size"), F.count("*").alias("n")), "classes")
    if light is None:
        small = classes.where(F.col("size") <= LIGHT_MOST).groupBy("size").count()
        light = light_boundary({r["size"]: r["count"] for r in bounded_rows(small, "sizes")}, similar)

    heads = classes.select(F.col("rep").alias("id")).dropna().distinct()
    posted = stored(postings(docs, heads, classes.n_rows, common, light, id_col, text_col, width, similar), "postings")
    lists = counted(lists_with_pivots(posted), "lists")

    star = lists.where((F.col("id") != F.col("pivot")) & within_reach("n", "most", "pivot_n", "pivot_most", similar))
    tried = counted(star.select(*pair("pivot", "id")).distinct(), "pairs")
    links = verified(tried, posted, docs, id_col, text_col, width, similar)
    # Rows of one id with several texts hold their classes together.
    texts = rows.where("n > 0 AND id IS NOT NULL").groupBy("id")
    several = texts.agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("id")
    named = rows.where("n > 0").join(several, "id").join(classes.select("sig", "rep"), "sig")
    same = named.where("id <> rep").select(*pair("id", "rep")).distinct()
    labels = stored(connected_components(links.unionByName(same)), "labels")

    for turn in range(stars + 1):
        before, lists = lists, counted(open_lists(lists, labels), "open")
        discard(before)
        if not lists.n_rows:
            break
        more = across(lists, turn, similar) if turn < stars else all_across(lists, similar)
        more = counted(more.distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        found = verified(more, posted, docs, id_col, text_col, width, similar)
        tried = tried.unionByName(more)
        if found.n_rows:
            labels = stored(joined_labels(labels, found), "labels")

    reps = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    reps = stored(reps.select("sig", F.coalesce("label", "rep").alias("component_id"), F.col("n").alias("copies")), "reps")
    whole = joined_hot(rows.where("n > 0"), reps.drop("copies"), "sig", reps.select("sig", F.col("copies").alias("n")))
    empty = rows.where("n = 0").withColumn("component_id", F.col("id"))
    joined = whole.unionByName(empty.select(*whole.columns))
    return joined.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only the components that a link joins are labelled anew."""
    ends = links
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
        ends = ends.join(own, end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    crossing = ends.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b")
    new = stored(connected_components(crossing), "joined").select(F.col("id").alias("old"), F.col("label").alias("new"))
    moved = labels.join(new, F.col("label") == F.col("old"), "left").select("id", F.coalesce("new", "label").alias("label"))
    alone = new.join(labels.select(F.col("id").alias("old")), "old", "left_anti")
    return moved.unionByName(alone.select(F.col("old").alias("id"), F.col("new").alias("label")))


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(key, id, n, most, kind, posted, n_often, component)`` of the lists that hold several components."""
    own = ["key", "id", "n", "most", "kind", "posted", "n_often"]
    known = lists.select(*own).join(labels, "id", "left").select(*own, F.coalesce("label", "id").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    return known.join(mixed.select("key"), "key", "left_semi")


def across(lists: DataFrame, turn: int, similar: int) -> DataFrame:
    """Pairs ``(a, b)``: in each list, every member and one member of the list that another
    component offers, other ones in every turn."""
    order = F.xxhash64("id", F.lit(turn))
    offer = lists.groupBy("key", "component").agg(F.min(F.struct(order.alias("o"), "id", "n", "most")).alias("p"))
    rank = F.struct("p.o", "component", "p.id", "p.n", "p.most")
    best = offer.groupBy("key").agg(F.min(rank).alias("lo"), F.max(rank).alias("hi"))
    joined = lists.join(best, "key")
    other = F.when(F.col("component") != F.col("lo.component"), F.col("lo")).otherwise(F.col("hi"))
    rows = joined.select("id", "n", "most", other.alias("o")).select(
        "id", "n", "most", F.col("o.id").alias("other"), F.col("o.n").alias("m"), F.col("o.most").alias("its_most")
    )
    return rows.where(within_reach("n", "most", "m", "its_most", similar)).select(*pair("id", "other"))


def all_across(lists: DataFrame, similar: int) -> DataFrame:
    """All pairs ``(a, b)`` in different components whose common lists leave similarity possible.

    Every list two such documents share is open, so the number of common lists is the
    number of posted elements they share (of common elements, at most as many as both
    posted, where the pair also shares a rare one). Beyond the end of one of the posted
    parts at most the rest of that set is shared.
    """
    profile = ("id", "n", "posted", "n_often")
    x = lists.select("key", *[F.col(c).alias(f"its_{c}") for c in (*profile, "most", "component")])
    meet = (F.col("component") < F.col("its_component")) & within_reach("n", "most", "its_n", "its_most", similar)
    rows = lists.join(x, "key").where(meet)
    seen = rows.groupBy(*[f"{p}{c}" for p in ("", "its_") for c in profile]).agg(
        F.min("kind").alias("kind"),
        F.sum((F.col("kind") == 1).cast("int")).alias("rare"),
        F.sum((F.col("kind") == 2).cast("int")).alias("common"),
    )
    common = F.when(F.col("rare") > 0, F.least("n_often", "its_n_often")).otherwise(F.col("common"))
    rest = F.greatest(F.col("n") - F.col("posted"), F.col("its_n") - F.col("its_posted"))
    most = F.col("rare") + common + rest
    possible = (F.col("kind") == 0) | ((100 + similar) * most >= similar * (F.col("n") + F.col("its_n")))
    return seen.where(possible).select(*pair("id", "its_id"))


def op9_jaccard_join(spark, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))
