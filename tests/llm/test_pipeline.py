"""The stages one by one on a small corpus, each against what it should keep."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.data import ODD, docs_of, prose
from tests.llm.test_credentials import TEXTS as SECRETS
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_decontamination import tables
from tests.llm.test_jaccard import brute as components
from tests.llm.test_jaccard import corpus

SMALL = "/root/testdata/sf0.001"


def rows(df):
    assert df.columns == list(cp.COLUMNS)
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "jaccard_join", "benchmark_decontamination", "secret_scan", "packing"]


def test_quality_keeps_good_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    kept = dict(rows(cp.quality_classifier(spark, docs.withColumn("score", F.lit(1)), "/root/testdata/sf0.01")))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[k] == v for k, v in kept.items())
    assert sum((k in kept) == bool(q) for k, q in labels.items()) > 0.97 * len(labels)


def test_one_document_of_each_group(spark):
    data = corpus(17, [6, 12, 40, 90], copies=3)
    data += [data[-1], (None, "no id"), (None, data[0][1])]
    df = spark.createDataFrame(data, "doc_id bigint, text string").select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("source", "string"), ("n_chars", "bigint"))]
    )
    want = {d for d, c in zip(data, (c for _, c in components(data)), strict=True) if d[0] is not None and d[0] == c}
    assert rows(cp.jaccard_join(spark, df, SMALL)) == sorted([*want, *(x for x in data if x[0] is None)], key=str)


def test_texts_of_one_id(spark):
    """Unrelated texts of a repeated id all stay, once each; copies and blank ones do not."""
    rng = random.Random(31)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    data = [(1, a), (5, b), (5, c), (5, c), (5, None), (5, " "), (6, a), (7, d), (7, d), (8, None), (8, ""), (9, b + " more")]
    data += [(20, prose(rng, 30)) for _ in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("source", "string"), ("n_chars", "bigint"))]
    )
    got = rows(cp.jaccard_join(spark, df, SMALL))
    wanted = {(1, a), (7, d), (8, ""), *data[12:]}
    best = max(b, c)
    # Of the texts of id 5 the greatest keeps the id; b and its near copy are one group.
    wanted |= {(5, b), (5, c)} if best == b else {(5, c), (9, b + " more")}
    assert got == sorted(wanted, key=str)


def test_leaking_documents_go(spark, tmp_path):
    texts, items = tables()
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = rows(cp.benchmark_decontamination(spark, docs_of(spark, texts), str(tmp_path)))
    clean = [(k, t) for k, (t, (_, n, _, _)) in enumerate(zip(texts, leaks(texts, items), strict=True)) if not n]
    assert got == sorted(clean, key=str)


def test_secrets_are_masked(spark):
    texts = ODD + SECRETS
    df = docs_of(spark, texts).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("bigint")))
    out = {r.doc_id: r for r in cp.secret_scan(spark, df, SMALL).collect()}
    assert len(out) == len(texts) and all(out[k].text == t for k, t in enumerate(ODD))
    assert "04dbebab" not in out[len(ODD)].text
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.values())


@pytest.fixture(scope="module")
def whole(spark):
    return cp.run(spark, SMALL).collect()


def test_run_packs_what_the_stages_keep(spark, whole):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    kept = {r.doc_id for r in docs.collect()}
    assert 0 < len(kept) < 200 and {r.doc_id for r in whole} == kept
    tokens = defaultdict(int)
    for r in whole:
        tokens[r.doc_id] += r.length
    assert all(tokens[r.doc_id] == r.doc_tokens for r in whole)


def test_empty_documents(spark):
    docs = docs_of(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_real_text_of_a_repeated_id_stays(spark):
    data = [(1, None), (1, "one two three four five six"), (1, ""), (2, ""), (2, "seven eight nine ten eleven twelve")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").select(
        "*", *[F.lit(None).cast(t).alias(n) for n, t in (("lang", "string"), ("source", "string"), ("n_chars", "bigint"))]
    )
    assert rows(cp.jaccard_join(spark, df, SMALL)) == [data[1], data[4]]
