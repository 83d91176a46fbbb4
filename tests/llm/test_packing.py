import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamella.llm.packing import Packer, WordEncoder, pack_documents
from tests.llm.data import ODD, docs_of, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_match_the_library():
    library, enc, rng = Tokenizer.from_file(PATH), WordEncoder(PATH), random.Random(5)
    alphabet = " \n\t.,'!#aAbZéßñÉ0²sTlre<|>́　日ΣİȺ"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in texts + [prose(rng, 300)]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_pieces_cover_documents_and_fill_tiers(lengths):
    packer = Packer((4, 8, 16, 32), step_tokens=64)
    sequences, left = packer.pack(lengths)
    assert sum(n for _, _, n in left) < 32
    cover = defaultdict(list)
    for tier, tokens, row in sequences:
        assert tokens == tier == sum(n for _, _, n in row)
        for doc, start, n in row:
            cover[doc].append((start, n))
    for doc, start, n in left:
        cover[doc].append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(cover[doc]):
            assert start == at and n > 0
            at += n
        assert at == length
    groups = packer.groups(sequences)
    tokens = Counter()
    for (tier, _, _), g in zip(sequences, groups, strict=True):
        tokens[g] += tier
    assert all(n <= 64 for n in tokens.values())
    assert len(tokens) <= -(-sum(tokens.values()) // 64)


def test_rows_are_whole(spark):
    library, rng = Tokenizer.from_file(PATH), random.Random(6)
    texts = ODD + [prose(rng, rng.randint(1, 900)) for _ in range(60)] + ["same text here"] * 5
    df = docs_of(spark, texts, ["start", "length"]).repartition(3)
    rows = pack_documents(df, PATH, tiers=(64, 128, 256), step_tokens=1024, window_tokens=4000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
        short += at not in (64, 128, 256)
    assert short <= 3


def test_empty_table(spark):
    assert pack_documents(docs_of(spark, []), PATH).count() == 0
