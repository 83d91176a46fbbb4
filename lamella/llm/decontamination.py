"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Texts are normalised to lower-cased words joined by single spaces. The automaton holds
every window of ``width`` consecutive words of an item (all words of a shorter one), each
between spaces, so that one scan of a document finds all windows at all places. A match's
place in the normalised text is mapped back to word numbers and to code points of the
original.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import WORD_BYTES, map_rows, table, utf8, words_of

WIDTH = 10
#: Bytes of items in one automaton; a larger benchmark is scanned in blocks of about this size.
BLOCK_BYTES = 4_000_000


def windows(words: list[bytes], width: int = WIDTH) -> Iterator[str]:
    """The item's windows as keys of the automaton (bytes written as Latin-1)."""
    for k in range(max(1, len(words) - width + 1) if words else 0):
        yield " " + b" ".join(words[k : k + width]).decode("latin-1") + " "


def automaton(items: list[tuple], width: int = WIDTH):
    """The automaton of (item id, text) rows; a key's value: its word count and item numbers."""
    import ahocorasick

    keys: dict[str, set[int]] = {}
    for number, (_, text) in enumerate(items):
        for key in windows(words_of(text), width):
            keys.setdefault(key, set()).add(number)
    made = ahocorasick.Automaton()
    for key, numbers in keys.items():
        made.add_word(key, (key.count(" ") - 1, len(key), tuple(numbers)))
    if keys:
        made.make_automaton()
    return made if keys else None


def scan(found, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Words of the text, hit runs as (first word, word after the last), and item numbers."""
    words = words_of(text)
    if found is None or not words:
        return len(words), [], set()
    joined = b" " + b" ".join(words) + b" "
    hits, numbers = [], set()
    for end, (count, size, items) in found.iter(joined.decode("latin-1")):
        hits.append((end - size + 1, count))
        numbers.update(items)
    if not hits:
        return len(words), [], numbers
    # Word k starts behind the k-th space of the joined text.
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    first = np.searchsorted(spaces, [h[0] for h in hits])
    runs = merged([(a, a + n) for a, (_, n) in zip(first.tolist(), hits, strict=True)])
    return len(words), runs, numbers


def places(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans ``[start, end)`` in the original text of runs of words."""
    raw = utf8(text)
    if not runs:
        return []
    flat = np.frombuffer(b" " + raw.translate(WORD_BYTES) + b" ", np.uint8) != 32
    edges = np.flatnonzero(flat[1:] != flat[:-1])
    starts, ends = edges[::2], edges[1::2]
    # Code points before a byte: the bytes that start one.
    points = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in runs]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``(id, n_words, n_hit, item_ids, spans)``, one per row of ``docs``, with the columns ``carry``.

    ``item_ids`` holds, as sorted strings, the items with a window in the text; ``spans``
    the hit stretches as code points of the original text. Null and empty texts have no
    words, null and empty items no windows; an item without an id counts as the empty
    string; repeated items are the same item. An empty benchmark hits nothing. The
    automaton, which is broadcast, holds a block of at most about ``block_bytes`` of
    items; with several blocks, the documents pass from one automaton to the next.
    """
    spark = docs.sparkSession
    known = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("body"))
    size = known.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    done = f"`{id_col}` {kind}, n_words bigint, n_hit bigint, item_ids array<string>, spans array<struct<start: bigint, end: bigint>>"
    passed = f"`{id_col}` {kind}, `{text_col}` string, runs array<struct<a: bigint, b: bigint>>, item_ids array<string>"
    rows = docs.select(F.col(id_col), F.col(text_col), *carry)
    for block in range(blocks):
        mine = known if blocks == 1 else known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast({"items": [tuple(r) for r in mine.toLocalIterator()]})
        last = block == blocks - 1
        rows = map_rows(rows, _scanner(held, width, last), done if last else passed, len(carry))
    return rows


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scanner(held, width: int, last: bool):
    def start():
        store = held.value
        if "automaton" not in store:  # once per Python worker
            store["automaton"] = automaton(store["items"], width)
        names, found = [r[0] for r in store["items"]], store["automaton"]

        def step(ids, texts, earlier=None, seen=None):
            out: list[list] = [[] for _ in range(5 if last else 4)]
            for k, (key, text) in enumerate(zip(ids, texts, strict=True)):
                n, runs, numbers = scan(found, text)
                items = {names[i] for i in numbers}
                if earlier is not None:
                    runs = merged(runs + [(r["a"], r["b"]) for r in earlier[k]])
                    items |= set(seen[k])
                if last:
                    spans = [{"start": a, "end": b} for a, b in places(text, runs)] if runs else []
                    values = (key, n, sum(b - a for a, b in runs), sorted(items), spans)
                else:
                    values = (key, text, [{"a": a, "b": b} for a, b in runs], sorted(items))
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return out

        return step

    return start


def op8_decontamination(spark, folder: str) -> DataFrame:
    leaks = find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
