import random
import re

import pytest

from lamella.llm.decontamination import find_leaks
from tests.llm.data import ODD, docs_of, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, items, width=10):
    keys = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(AZ))
        for k in range(max(1, len(words) - width + 1) if words else 0):
            keys.setdefault(tuple(words[k : k + width]), set()).add(str(item))
    out = []
    for text in texts:
        low = (text or "").translate(AZ)
        spans = [m.span() for m in WORD.finditer(low)]
        words, hit, found = [low[a:b] for a, b in spans], set(), set()
        for key, names in keys.items():
            for k in range(len(words) - len(key) + 1):
                if tuple(words[k : k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    found |= names
        out.append((len(words), len(hit), sorted(found), [spans[k] for k in sorted(hit)]))
    return out


def tables():
    rng = random.Random(7)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 30, 12, 10, 9, 3])] + [(6, None), (7, ""), (8, "!!!"), (3, prose(rng, 11))]
    items.append((9, items[0][1]))
    texts = list(ODD) + [prose(rng, 50) for _ in range(5)]
    for _, text in items:
        if text:
            words = text.split()
            texts.append(prose(rng, 20) + " " + text.upper() + "! " + prose(rng, 20))
            texts.append(prose(rng, 5) + "\n" + " - ".join(words[:10]) + " " + prose(rng, 5))
            texts.append(" ".join(words[:9]))
            texts.append(text + " " + text)
    return texts, items


@pytest.mark.parametrize("block", [4_000_000, 300])
def test_against_brute_force(spark, block):
    texts, items = tables()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(docs_of(spark, texts, ["item_id", "n_hit"]), bench, block_bytes=block).collect()
    assert [r.doc_id for r in got] == list(range(len(texts)))
    want = brute(texts, items)
    assert sum(n > 0 for _, n, _, _ in want) >= 20
    for r, text, (n_words, n_hit, found, spans) in zip(got, texts, want, strict=True):
        assert (r.n_words, r.n_hit, r.item_ids) == (n_words, n_hit, found)
        for s in r.spans:
            inside = [x for x in spans if s.start <= x[0] and x[1] <= s.end]
            assert inside and inside[0][0] == s.start and inside[-1][1] == s.end
        assert sum(any(s.start <= a and b <= s.end for s in r.spans) for a, b in spans) == n_hit


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert find_leaks(docs_of(spark, []), none).count() == 0
    assert {r.n_hit for r in find_leaks(docs_of(spark, ["some words", None]), none).collect()} == {0}
