"""SimHash near duplicates against plain code over all pairs."""

import random

import numpy as np
import xxhash

from lamella.llm.simhash import BASE, block_links, neighbour_steps, simhash_components
from tests.llm.data import ODD, docs_of, prose


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=2):
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def near_copies(rng, n):
    out = [*ODD, *ODD[:3]]
    for _ in range(n):
        text = prose(rng, rng.randint(1, 400))
        out.append(text)
        words = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


def test_against_all_pairs(spark):
    texts = near_copies(random.Random(5), 60)
    docs = docs_of(spark, texts, extra=("id", "fp", "least", "label", "key", "n", "component_id", "fingerprint"))
    wanted = [plain_fingerprint(t) for t in texts]
    labels = plain_components(list(range(len(texts))), wanted)
    # Tiles of three fingerprints make every crowded tile several parts.
    for tile in (1024, 3):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(docs, tile=tile).collect()}
        assert got == {k: (f"{p:016x}", c) for k, (p, c) in enumerate(zip(wanted, labels))}


def test_wide_radius(spark):
    texts = near_copies(random.Random(6), 40)
    labels = plain_components(list(range(len(texts))), [plain_fingerprint(t) for t in texts], radius=9)
    got = simhash_components(docs_of(spark, texts), radius=9, tile=16).collect()
    assert [r.component_id for r in sorted(got, key=lambda r: r.doc_id)] == labels


def test_ids_and_empty_tables(spark):
    a, b = "one two three four", "quite another text of other words"
    rows = [(4, a), (2, a), (2, a), (None, a), (7, b), (None, "alone in the world"), (2, b)]
    got = simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    seen = sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None)
    assert seen == [(2, 2), (2, 2), (2, 2), (4, 2), (7, 2)]
    assert sorted((r.component_id or 0) for r in got if r.doc_id is None) == [0, 2]
    assert simhash_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_long_text(spark):
    text = prose(random.Random(1), 60_000)
    got = simhash_components(docs_of(spark, [text])).collect()
    assert got[0].fingerprint == f"{plain_fingerprint(text):016x}"


def test_steps_and_blocks():
    """Steps are one of each two directions; a block's stars connect what its pairs connect."""
    steps = neighbour_steps(2)
    assert len(steps) == len(set(steps)) == 21 and not set(steps) & {-s for s in steps if s}
    assert BASE > 16 + 2 * 2
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 6, 40).astype(np.uint64)
    roots, leaves = block_links(x, x, 1)
    assert len(roots) < len(np.unique(x))
    pairs = plain_components([int(v) for v in x], [int(v) for v in x], 1)
    for v, least in zip(x.tolist(), pairs):
        mine = dict(zip(leaves.tolist(), roots.tolist())).get(v, v)
        assert mine == least
