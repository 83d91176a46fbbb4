"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks. Two neighbours are spliced at a
boundary between pre-tokens that both of them have: what a byte-level BPE makes of the
text from such a boundary on depends on that text alone, so from there the right chunk is
what one pass over the whole text would give. A boundary close to the left chunk's end is
not trusted, as the text cut off there could still change it. Where the overlap holds no
common boundary (one run longer than the overlap), the overlap is widened to the left
and, at last, joins the chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import map_rows, table, utf8

#: Characters of a chunk and of the first overlap.
CHUNK = 16384
OVERLAP = 256
#: Pieces a task remembers.
CACHE = 400_000

# The letters, numbers and pre-token pattern of the byte-level vocabulary,
# for texts whose characters are all below U+0250.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
PIECES = (
    f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+"
)
#: A character beyond the plain ones sends a text to the library as a whole.
UNUSUAL = "[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(other)}


class Encoder:
    """Pre-token ends and token counts of texts, as the tokenizer's library gives them."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer, processors

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        # Offsets that cover white space too; ids do not change.
        self.whole.post_processor = processors.ByteLevel(trim_offsets=False)
        self.model = self.whole.model
        self.stand_in = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.margin = max([1, *map(len, self.specials)]) + 1
        self.pieces = re.compile(PIECES)
        self.unusual = re.compile(UNUSUAL)
        self.known: dict[str, int] = {}
        self.groups: dict[str, int] = {}
        self.cache = cache

    def plain(self, text: str) -> bool:
        """Whether the pattern above splits this text just as the library does."""
        return self.unusual.search(text) is None and not any(s in text for s in self.specials)

    def piece(self, piece: str) -> int:
        """Tokens of one pre-token."""
        n = self.known.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.stand_in)))
            if len(self.known) < self.cache:
                self.known[piece] = n
        return n

    def group(self, group: str) -> int:
        """Tokens of a text between single spaces, the leading one included."""
        n = self.groups.get(group)
        if n is None:
            n = sum(map(self.piece, self.pieces.findall(group)))
            if len(self.groups) < self.cache:
                self.groups[group] = n
        return n

    def short(self, text: str) -> int:
        """Tokens of a text in one pass."""
        if not self.plain(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        if "  " in text:
            return sum(map(self.piece, self.pieces.findall(text)))
        # With single spaces only, a pre-token starts at every space.
        first, *rest = text.split(" ")
        known, group = self.groups.get, self.group
        n = group(first)
        for part in rest:
            k = known(part := " " + part)
            n += group(part) if k is None else k
        return n

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pre-tokens, and tokens up to each end."""
        if self.plain(text):
            parts = self.pieces.findall(text)
            ends, counts = [len(p) for p in parts], [self.piece(p) for p in parts]
        else:
            e = self.whole.encode(text, add_special_tokens=False)
            offsets, ends, counts, last = e.offsets, [], [], object()
            for word, (_, end) in zip(e.word_ids, offsets, strict=True):
                if word is None or word != last:
                    ends.append(end)
                    counts.append(1)
                else:
                    ends[-1], counts[-1] = end, counts[-1] + 1
                last = word
            return np.array(ends, np.int64), np.cumsum(counts, dtype=np.int64)
        return np.cumsum(ends, dtype=np.int64), np.cumsum(counts, dtype=np.int64)


def splice(encode: Callable, text: str, margin: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text from the spans of its overlapping chunks.

    ``at`` is always a boundary that one pass over the whole text has too: 0, or one that
    two neighbours share. ``encode`` gives the spans of a chunk.
    """

    def part(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        ends, counts = encode(text[start:end])
        # The start counts as an end with no tokens before it.
        return np.append(start, ends + start), np.append(0, counts)

    def before(counts: np.ndarray, ends: np.ndarray, position: int) -> int:
        return int(counts[np.searchsorted(ends, position, side="right") - 1])

    n, total, at, high = len(text), 0, 0, min(len(text), chunk)
    ends, counts = part(0, high)
    while high < n:
        wide = overlap
        while True:
            start = max(at, high - wide)
            top = min(n, high + max(chunk - wide, high - start))
            right_ends, right_counts = part(start, top)
            stable = ends[(ends > start) & (ends <= high - margin)]
            shared = stable[np.isin(stable, right_ends)]
            if len(shared) or start == at:
                break
            wide *= 2
        if len(shared):
            total += before(counts, ends, shared[-1]) - before(counts, ends, at)
            at = int(shared[-1])
        # Else the right chunk itself starts at a proven boundary and holds the left one.
        ends, counts, high = right_ends, right_counts, top
    return total + int(counts[-1]) - before(counts, ends, at)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Rows ``(id, n_bytes, n_tokens, over_limit)``, one per row of ``docs``.

    Null and empty texts have no tokens; repeated rows are counted each; a null id stays
    null. ``tokenizer`` is a path every executor has.
    """

    def start():
        enc = Encoder(tokenizer)

        def step(ids, texts):
            texts = [t or "" for t in texts]
            n = [
                enc.short(t) if len(t) <= chunk else splice(enc.spans, t, enc.margin, chunk, overlap)
                for t in texts
            ]
            return ids, [len(utf8(t)) for t in texts], n, [k > limit for k in n]

        return step

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col), F.col(text_col)),
        start,
        f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )


def op10_token_counts(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
