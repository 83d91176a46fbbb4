"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import re
import zlib

import numpy as np

from lamella.llm import periodic_runs as pr
from tests.llm.data import ODD, docs_of, prose


def plain_runs(ids, shortest=12):
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i < len(ids) - q:
            j = i
            while j < len(ids) - q and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((i, j - i, q) for (i, j), q in found.items())


def sequences(rng, most):
    """Random, constant, periodic, Fibonacci, Thue-Morse and patched sequences."""
    n = rng.randrange(most)
    kind = rng.randrange(7)
    if kind < 3:
        return [rng.randrange((1, 2, 40)[kind]) for _ in range(n)]
    if kind == 3:
        return ([rng.randrange(30) for _ in range(rng.randrange(1, 40))] * n)[:n]
    if kind == 4:
        out = []
        while len(out) < n:
            out += [rng.randrange(4) for _ in range(rng.randrange(1, 20))] * rng.randrange(1, 5)
        return out
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, (b + a if kind == 5 else b + [1 - v for v in b])
    return b[:n]


def test_against_all_periods():
    rng = random.Random(11)
    for shortest in (12, 12, 12, 20):
        texts = [sequences(rng, 220) for _ in range(60)]
        got = pr.runs_of([np.array(t, np.int64) for t in texts], shortest)
        for t, g in zip(texts, got):
            assert [tuple(r) for r in g.tolist()] == plain_runs(t, shortest)


def test_texts_are_independent():
    """A text's runs do not depend on its neighbours, nor on how many candidates fit at once."""
    rng = random.Random(12)
    texts = [np.array(sequences(rng, 300), np.int64) for _ in range(40)]
    together = pr.runs_of(texts)
    few, pr.CANDIDATES = pr.CANDIDATES, 7
    try:
        alone = [pr.runs_of([t])[0] for t in texts]
    finally:
        pr.CANDIDATES = few
    assert all((a == b).all() for a, b in zip(together, alone))


def test_grammar():
    """Symbols expand to the text, recurring pairs are gone, and a power takes few symbols."""
    rng = random.Random(13)
    for ids in ([0] * 4096, [1, 2, 3, 4, 5] * 500, [rng.randrange(3) for _ in range(2000)]):
        symbols = np.array([*ids, -1], np.int64)
        (rule, s, m, e), starts = pr.repair(symbols, np.arange(len(ids) - 1))
        content = {}
        for x, i, k, j in zip(rule.tolist(), s.tolist(), m.tolist(), e.tolist()):
            assert i < k < j
            assert content.setdefault(x, ids[i:j]) == ids[i:j]
        last = [int(i) for i in starts]
        assert last == sorted(last) and last[0] == 0
        ends = [*last[1:], len(ids)]
        pairs = [tuple(map(tuple, (ids[a:b], ids[b:c]))) for a, b, c in zip(last, ends, ends[1:])]
        assert len(content) < len(ids) / 2
        if len(set(ids)) < 3 and len(set(ids)) == 1:
            assert len(content) + len(pairs) < 40


def test_long_sequences():
    block = [k * k % 977 for k in range(3000)]
    ids = [*range(5000, 6000), *(block * 20), *range(7000, 8000), *([3] * 50_000)]
    (got,) = pr.runs_of([np.array(ids, np.int64)])
    rows = [tuple(r) for r in got.tolist()]
    assert (1000 + 60_000 + 1000, 50_000, 1) in rows
    assert max(rows, key=lambda r: r[1] if r[2] > 1 else 0)[1] >= 60_000
    # The squares repeat with period 977 inside each block.
    assert sum(r[2] == 977 for r in rows) >= 1


def plain_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {k for i, size, q in runs for k in range(i + q, i + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    return (doc_id, len(runs), *top, sha("".join(f"{i},{size},{q}\n" for i, size, q in runs)), sha(kept))


def test_query_against_plain_rows(spark, tmp_path):
    """The whole query: planted periods, odd texts, repeated phrases, and columns that clash."""
    rng = random.Random(14)
    texts = [*ODD]
    for _ in range(150):
        words = prose(rng, rng.randint(0, 120)).split()
        at = rng.randint(0, len(words))
        phrase = words[at : at + rng.randint(0, 9)] * rng.randint(0, 9)
        texts.append(" ".join([*words[:at], *phrase, *words[at:]]))
    docs_of(spark, texts, extra=("runs", "collapsed", "n_words", "best", "start", "id")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[:8] for r in pr.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {k: plain_row(k, t) for k, t in enumerate(texts)}
    assert sum(r[1] for r in got.values()) > 60


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[:8] for r in pr.op12_periodic_runs(spark, folder).collect()}
    for r in docs:
        if len((r.text or "").split()) <= 900:
            assert got[r.doc_id] == plain_row(r.doc_id, r.text)


def test_rows_without_words(spark):
    none = hashlib.sha256(b"").hexdigest()
    rows = [(None, None), (None, "a " * 30), (5, ""), (5, "b " * 12), (5, "b " * 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(v) for v in r.runs]) for r in pr.periodic_runs(docs, chunk=10).collect())
    assert got == [(0, 0, []), (0, 30, [(0, 30, 1)]), (5, 0, []), (5, 12, [(0, 12, 1)]), (5, 12, [(0, 12, 1)])]
    assert pr.periodic_runs(docs.where("false")).collect() == []
    assert hashlib.sha256(pr.collapsed([], np.zeros((0, 3), np.int64))).hexdigest() == none
