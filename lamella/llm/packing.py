"""Hierarchical multi-length packing of token streams.

Documents are cut into pieces by context size: whole windows of the longest size first,
then what is left is routed to the smallest tier that holds it. Each tier packs its
pieces best-fit into sequences of its size. A sequence's gap is filled from the shorter
tiers, the last filler cut to fit, so that sequences of every tier are full (a tier's
size is a power of two and needs no padding); only the last, longest sequences of a task
stay open and are padded. Sequences are then dealt to step groups of equal token counts.

Each task packs what its partition holds: nothing is shuffled, and a task keeps only the
open pieces of a bounded window in memory.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import _arrow_schema, table
from lamella.llm.token_counts import byte_letters

#: Context sizes, shortest first; each a power of two.
TIERS = (512, 1024, 2048, 4096)
#: Tokens of a step group.
STEP_TOKENS = 131_072
#: Tokens a task gathers before it packs them.
WINDOW_TOKENS = 2_000_000
CACHE = 400_000

# Letters, numbers and the pre-token pattern of the lower-case vocabulary,
# for texts whose characters are all below U+0180 (their lower case is, too).
LOWER = "a-zªµºß-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
PIECES = f"'(?:s|t|re|ve|m|ll|d)|[{LOWER}]+|[{NUMBERS}]|[^\\s{LOWER}{NUMBERS}]+"
#: A text with other characters goes to the library as a whole (U+0130 lowers to two).
UNUSUAL = "[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u017f]"


class WordEncoder:
    """Token ids of texts, as little-endian unsigned 32-bit bytes.

    Pre-tokens do not cross white space and are encoded on their own, so the ids of a
    word are remembered. A text that is not plain is encoded by the library in one call.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model = self.whole.model
        self.stand_in = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.pieces, self.unusual = re.compile(PIECES), re.compile(UNUSUAL)
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.cache = cache

    def piece(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_in))
            got = np.array([t.id for t in tokens], "<u4").tobytes()
            if len(self.known) < self.cache:
                self.known[piece] = got
        return got

    def word(self, word: str) -> bytes:
        got = self.words.get(word)
        if got is None:
            got = b"".join(map(self.piece, self.pieces.findall(word)))
            if len(self.words) < self.cache:
                self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        if self.unusual.search(text) or any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, word = self.words.get, self.word
        return b"".join([known(w) or word(w) for w in text.lower().split()])


class Packer:
    """Packs pieces ``(key, start, length)`` into sequences, and deals them to step groups."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers must be powers of two")
        self.top = self.tiers[-1]

    def route(self, length: int) -> list[tuple[int, int, int]]:
        """Pieces of a document as (tier, start, length): full windows, then the rest."""
        full, rest = divmod(length, self.top)
        pieces = [(self.top, k * self.top, self.top) for k in range(full)]
        if rest:
            tier = next(t for t in self.tiers if t >= rest)
            pieces.append((tier, full * self.top, rest))
        return pieces

    def pack(self, lengths: list[int]) -> tuple[list[tuple[int, int, list]], list[tuple[int, int, int]]]:
        """Full sequences (tier, tokens, [(document, start, length)]) of the documents, and what is left.

        The left pieces, fewer tokens than one longest window, fill no sequence of any tier.
        """
        ready, waiting = [], {t: [] for t in self.tiers}
        for doc, length in enumerate(lengths):
            for tier, start, size in self.route(length):
                (ready if size == tier else waiting[tier]).append((doc, start, size))
        sequences = [(size, size, [(d, s, size)]) for d, s, size in ready]
        # Long pieces first; short ones are kept in order of length for best-fit filling.
        shelf: dict[int, list] = defaultdict(list)
        for tier in self.tiers:
            for piece in waiting[tier]:
                shelf[piece[2]].append(piece)
        stock = Stock(shelf, self.top)
        for tier in reversed(self.tiers):
            opened = sorted(waiting[tier], key=lambda p: (-p[2], p[0], p[1]))
            for piece in opened:
                if not stock.take(piece):
                    continue
                row, gap = [piece], tier - piece[2]
                while gap:
                    filler = stock.best(gap)
                    if filler is None:
                        break
                    doc, start, size = filler
                    row.append((doc, start, min(size, gap)))
                    if size > gap:
                        stock.add((doc, start + gap, size - gap))
                    gap -= min(size, gap)
                if gap:
                    for p in row:
                        stock.add(p)
                    # Nothing is left to fill it: shorter tiers may still use the pieces.
                    break
                sequences.append((tier, tier, row))
        return sequences, sorted(stock.rest(), key=lambda p: (p[0], p[1]))

    def groups(self, sequences: list) -> list[int]:
        """The step group of each sequence: equal tokens, attention cost spread evenly.

        The costliest sequence goes first, to the group with the least cost that still
        has room; sequences beyond all rooms open a further group.
        """
        tokens = sum(s[1] for s in sequences)
        count = max(1, -(-tokens // self.step_tokens))
        room = [self.step_tokens] * count
        cost = [sum(size * size for _, _, size in row) for _, _, row in sequences]
        heap = [(0, g) for g in range(count)]
        out = [0] * len(sequences)
        for k in sorted(range(len(sequences)), key=lambda k: (-sequences[k][1], -cost[k], k)):
            aside = []
            while heap and room[heap[0][1]] < sequences[k][1]:
                aside.append(heapq.heappop(heap))
            if heap:
                load, g = heapq.heappop(heap)
            else:
                load, g = 0, len(room)
                room.append(self.step_tokens)
            room[g] -= sequences[k][1]
            out[k] = g
            for item in aside:
                if room[item[1]]:
                    heapq.heappush(heap, item)
            if room[g]:
                heapq.heappush(heap, (load + cost[k], g))
        return out


class Stock:
    """Waiting pieces by length, with the longest that fits a gap found by a bitmap."""

    def __init__(self, shelf: dict[int, list], top: int):
        self.shelf, self.top = shelf, top
        self.held = {p for pieces in shelf.values() for p in pieces}
        self.mask = sum(1 << size for size in shelf)

    def take(self, piece) -> bool:
        if piece not in self.held:
            return False
        self.held.remove(piece)
        return True

    def add(self, piece) -> None:
        self.held.add(piece)
        self.shelf[piece[2]].append(piece)
        self.mask |= 1 << piece[2]

    def _pop(self, size: int):
        pieces = self.shelf[size]
        while pieces:
            piece = pieces.pop()
            if piece in self.held:
                self.held.remove(piece)
                if not pieces:
                    self.mask &= ~(1 << size)
                return piece
        self.mask &= ~(1 << size)
        return None

    def best(self, gap: int):
        """The longest waiting piece that fits, else the shortest, which is then cut."""
        while fits := self.mask & ((1 << (gap + 1)) - 1):
            if (piece := self._pop(fits.bit_length() - 1)) is not None:
                return piece
        while self.mask:
            if (piece := self._pop((self.mask & -self.mask).bit_length() - 1)) is not None:
                return piece
        return None

    def rest(self) -> list:
        return list(self.held)


SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
    "offset bigint, tier int, step_group bigint"
)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    window_tokens: int = WINDOW_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group)``.

    Every row of ``docs`` is a document: its ids, then ``end_id``; a null or empty text is
    ``end_id`` alone, repeated rows are packed each, and a null id stays null. A sequence
    shorter than its tier, at most one per task, is padded to the longest size.
    ``sequence_id`` and ``step_group`` are unique over tasks: they start with the number
    of the partition.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, {SCHEMA}").schema
    arrow = _arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, enc = Packer(tiers, step_tokens), WordEncoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        made = groups_made = 0
        # Waiting documents: (id, ids as bytes, tokens of the whole document, start of these ids).
        window: list[tuple] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal window, size, made, groups_made
            sequences, left = packer.pack([len(w[1]) // 4 for w in window])
            if last and left:
                sequences += close(left, packer.top)
                left = []
            groups = packer.groups(sequences)
            columns: list[list] = [[] for _ in arrow]
            for (tier, _, row), group in zip(sequences, groups, strict=True):
                offset = 0
                for doc, start, length in row:
                    key, ids, whole, skipped = window[doc]
                    part = ids[4 * start : 4 * (start + length)]
                    values = (key, skipped + start, length, zlib.crc32(part), whole, first + made, offset, tier, first + groups_made + group)
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                    offset += length
                made += 1
            groups_made += max(groups, default=-1) + 1
            # Pieces that fill nothing yet wait for the next window.
            window = [(window[d][0], window[d][1][4 * s : 4 * (s + n)], window[d][2], window[d][3] + s) for d, s, n in left]
            size = sum(len(w[1]) // 4 for w in window)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + tail
                window.append((key, ids, len(ids) // 4, 0))
                size += len(ids) // 4
                if size >= window_tokens:
                    yield from flush(False)
        if window:
            yield from flush(True)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, wanted)


def close(left: list[tuple[int, int, int]], top: int) -> list[tuple[int, int, list]]:
    """The open sequences of the pieces that are left: in order, cut at the longest size."""
    out, row, used = [], [], 0
    for doc, start, size in left:
        while size:
            part = min(size, top - used)
            row.append((doc, start, part))
            used, start, size = used + part, start + part, size - part
            if used == top:
                out.append((top, used, row))
                row, used = [], 0
    if row:
        out.append((top, used, row))
    return out


def op7_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
