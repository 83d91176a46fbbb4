import random
import re

from lamella.llm.licenses import TEMPLATES, Index, find_licenses, op2_licenses
from tests.llm.data import ODD, docs_of, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}


def brute(text):
    words = WORD.findall((text or "").translate(AZ))
    starts, labels = [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        own = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    return len(words), sorted(starts), sorted(labels)


def texts():
    rng = random.Random(8)
    notices = [prose(rng, 80) + "\n" + t + " " + prose(rng, 60) for t, _ in TEMPLATES.values()]
    broken = ["Released under the licence of MIT.", "the mit-license, MIT LICENSE mit license general public  license"]
    return ODD + notices + broken + [prose(rng, 200) for _ in range(10)] + ["license version 2 apache the under licensed"]


def test_base_and_templates(spark):
    rows = find_licenses(docs_of(spark, texts(), ["label", "score", "n_words"])).collect()
    assert len(rows) == len(texts())
    for r, text in zip(rows, texts(), strict=True):
        assert (r.n_words, r.starts, r.base) == brute(text), text
    found = [[m.label for m in r.matches] for r in rows]
    at = len(ODD)
    for k, name in enumerate(TEMPLATES):
        assert name in found[at + k], name
        assert all(0 < m.score <= 1 for m in rows[at + k].matches)
    # Words out of place, and prose, are no notice.
    assert found[-1] == [] and all(f == [] for f in found[at + len(TEMPLATES) + 2 : -1])


def test_index_counts_all_documents():
    every = {w for text, _ in TEMPLATES.values() for w in WORD.findall(text.lower())}
    index = Index({None: 1000, **dict.fromkeys(every, 900), "charge": 1, "sublicense": 2})
    assert index.idf[b"charge"] > index.idf[b"sublicense"] > 3
    assert all(v < 1 for w, v in index.idf.items() if w not in (b"charge", b"sublicense"))


def test_inserted_words_are_bridged():
    words = WORD.findall("this library is free software you can really redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation")
    assert "lgpl-notice" in Index({None: 10}).match([w.encode() for w in words])


def test_query(spark, tmp_path):
    docs_of(spark, texts()).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(op2_licenses(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    for r, text in zip(rows, texts(), strict=True):
        n, starts, labels = brute(text)
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(starts), ",".join(labels))
        assert (r.first_word, r.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_empty_table(spark):
    assert find_licenses(docs_of(spark, [])).count() == 0
