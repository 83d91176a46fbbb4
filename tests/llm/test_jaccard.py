import random
import re

import pytest
from pyspark.sql import functions as F

from lamella.llm.jaccard import element_hashes, jaccard_components, light_boundary, light_keys, shared
from tests.llm.data import ODD, docs_of, prose

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def element_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """(n_shingles, component) of each row (id, text), by comparing all pairs."""
    sets = [element_set(t) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j in range(k):
            t = sets[j]
            a, b = rows[k][0], rows[j][0]
            if s and t and None not in (a, b) and 100 * len(s & t) >= 75 * len(s | t):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
    return [(len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1).strip()
    return " ".join(words)


def corpus(seed, base_sizes, copies=6):
    rng = random.Random(seed)
    passage = prose(rng, 60)
    texts = list(ODD)
    for size in base_sizes:
        base = prose(rng, size)
        texts += [base, base.upper(), base]
        for k in range(copies):
            texts.append(edited(rng, base, rng.randint(1, max(1, size // 25))))
            # Chains: copies of copies drift away from the base.
            texts.append(edited(rng, texts[-1], max(1, size // 30)))
    texts += [prose(rng, rng.randint(80, 160)) + " " + passage + " " + prose(rng, 20) for _ in range(15)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("light,files,stars", [(None, 64, 3), (0, 3, 0), (12, 4, 1)])
def test_against_all_pairs(spark, light, files, stars):
    rows = corpus(14, [5, 6, 7, 9, 11, 12, 13, 14, 16, 18, 22, 30, 60, 150])
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit(1)).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, light=light, common_files=files, stars=stars).collect()}
    want = {i: w for (i, _), w in zip(rows, brute(rows), strict=True)}
    assert got == want
    assert sum(c != i for i, (_, c) in want.items()) >= 40


def test_awkward_rows(spark):
    rng = random.Random(15)
    base, other = prose(rng, 40), prose(rng, 40)
    rows = [(5, base), (5, base), (3, edited(rng, base, 1)), (7, other), (7, base), (9, edited(rng, other, 1)), (2, None), (2, ""), (None, base), (None, "alone here"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    want = [(i is None, i or 0, n, c) for (i, _), (n, c) in zip(rows, brute(rows), strict=True)]
    # A row without an id has the component of an identical set.
    want = [(x[0], x[1], x[2], 3) if x[0] and x[2] > 1 else x for x in want]
    assert [x[:3] for x in got] == sorted(x[:3] for x in want)
    assert {x[3] for x in got if x[1] in (3, 5, 7, 9)} == {3}
    assert [x[3] for x in got if x[0]].count(None) == 1
    assert jaccard_components(df.limit(0)).count() == 0


def test_light_sets_meet_exactly_when_they_share_enough():
    rng = random.Random(16)
    import numpy as np

    pool = [np.uint64(rng.getrandbits(64)) for _ in range(14)]
    for _ in range(300):
        a, b = (np.sort(np.array(rng.sample(pool, rng.randint(5, 11)), np.uint64)) for _ in range(2))
        common = len(np.intersect1d(a, b))
        similar = 100 * common >= 75 * (len(a) + len(b) - common)
        meet = bool(set(light_keys(a, 75)) & set(light_keys(b, 75)))
        if similar:
            assert meet
        assert shared(len(a), len(b)) == min(c for c in range(40) if 100 * c >= 75 * (len(a) + len(b) - c))


def test_boundary_follows_cost():
    assert light_boundary({}) == 0
    assert 4 <= light_boundary({3: 1000, 4: 1000}) <= 24
    assert light_boundary({3: 1000}, posting=0.1) == 0
    assert light_boundary({20: 1_000_000}) < 20


def test_elements():
    assert len(element_hashes("a b c d e")) == 1 and len(element_hashes("a b c d e f")) == 2
    assert len(element_hashes("A b\tc\n")) == 1 and (element_hashes("A b") == element_hashes(" a  b ")).all()
    assert len(element_hashes(None)) == 0
    assert element_hashes("a b c d e") != element_hashes("b a c d e")
