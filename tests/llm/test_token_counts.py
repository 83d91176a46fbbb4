import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lamella.llm.token_counts import Encoder, count_tokens, splice
from tests.llm.data import ODD, docs_of, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    alphabet = " \n\t.,'!#aAbZéßñ0²sTlre<|>́　日"
    return [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(400)]


def test_whole_texts_match_the_library(library):
    enc = Encoder(PATH)
    for text in texts() + [prose(random.Random(1), 300)]:
        assert enc.short(text) == len(library.encode(text).ids), repr(text)


@pytest.mark.parametrize("chunk,overlap", [(40, 20), (64, 3), (200, 40)])
def test_spliced_chunks_match_one_pass(library, chunk, overlap):
    enc = Encoder(PATH)
    rng = random.Random(4)
    long = texts() + [" ".join(rng.sample(texts(), 40)) for _ in range(20)] + [prose(rng, 500), "y" * 1000 + " " + "z" * 1000]
    for text in long:
        assert splice(enc.spans, text, enc.margin, chunk, overlap) == len(library.encode(text).ids), repr(text)


def test_rows(spark, library):
    rows = ODD + ODD[:3] + [prose(random.Random(2), 8000)]
    got = count_tokens(docs_of(spark, rows, ["n_tokens", "n_bytes"]), PATH, limit=3, chunk=2000).collect()
    assert [r.doc_id for r in got] == list(range(len(rows)))
    for r, text in zip(got, rows, strict=True):
        n = len(library.encode(text or "").ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 3)


def test_empty_table(spark):
    assert count_tokens(docs_of(spark, []), PATH).count() == 0
