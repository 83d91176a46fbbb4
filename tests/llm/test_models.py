"""Held-out quality and awkward rows of the learned operators."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm.common import labelled_sample
from lamella.llm.cotraining import op6_quality_cotraining, quality_scores
from lamella.llm.languages import Mixture, language_mixtures, op4_language_mixture
from lamella.llm.toxicity import Ftrl, features, op3_toxicity, toxicity_scores
from tests.llm.data import ODD, docs_of, prose

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id", "left")
    return {r.doc_id: r for r in docs.collect()}


def auc(scores, labels):
    order = np.argsort(np.argsort(scores))
    up = np.array(labels) == 1
    return (order[up].sum() - up.sum() * (up.sum() - 1) / 2) / (up.sum() * (~up).sum())


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op3_toxicity(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert auc([r.score for r in rows], [labels[r.doc_id] for r in rows]) > 0.95
    clean = [r for r in rows if not labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_toxicity_rows(spark):
    rng = random.Random(9)
    texts = ODD + [prose(rng, 40) + (" rotten fool" if k % 2 else "") for k in range(80)] + ["a rotten fool"] * 3
    labels = spark.createDataFrame([(len(ODD) + k, k % 2) for k in range(80)] + [(None, 1), (99999, 0)], "doc_id bigint, label int")
    rows = toxicity_scores(docs_of(spark, texts, ["score", "label"]), labels).collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert rows[-1].score > 0.5 > rows[1].score
    assert rows[0].score == rows[1].score
    # No labels at all: the same score for everything.
    none = toxicity_scores(docs_of(spark, texts), labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert toxicity_scores(docs_of(spark, []), labels).count() == 0


def test_one_row_of_an_id_is_learned(spark):
    """An id that repeats gives one row; labels without a document do not use up the bound."""
    docs = docs_of(spark, ["a", "b", "c", None], ["label"])
    many = docs.unionByName(docs.where("doc_id = 1").withColumn("text", F.explode(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: k.cast("string")))))
    labels = spark.createDataFrame([(k, k % 2) for k in [1, 1, 2, 3, *range(100, 400)]] + [(None, 1), (0, None)], "doc_id bigint, label int")
    rows = labelled_sample(many, labels, "doc_id", ["text"], 3).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(1, 1), (2, 0), (3, 1)]
    again = labelled_sample(many.repartition(5), labels, "doc_id", ["text"], 3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert labelled_sample(docs.limit(0), labels, "doc_id", ["text"], 3).count() == 0


def test_ftrl_weights_are_sparse():
    model, rng = Ftrl(bits=12), random.Random(10)
    for k in range(600):
        words = [rng.choice("abcdefghij").encode() * rng.randint(1, 3) for _ in range(20)] + [b"bad"] * (k % 2)
        model.learn(np.unique(features(words, 12)), k % 2)
    every = np.arange(1 << 12)
    assert 0 < np.count_nonzero(model.weights(every)) < 200


def test_languages_held_out(spark, truth):
    rows = op4_language_mixture(spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id].lang for r in held) > 0.98 * len(held)


def test_language_rows(spark):
    a = ["alpha beta gamma delta " * k for k in range(1, 20)]
    b = ["zuvix quorlo pyxen wozzik " * k for k in range(1, 20)]
    learn = docs_of(spark, a + b).withColumn("lang", F.when(F.col("doc_id") < len(a), "aa").otherwise("bb"))
    texts = ODD + ["beta gamma delta", "quorlo zuvix", (a[5] * 3 + b[5])]
    rows = language_mixtures(docs_of(spark, texts, ["score", "mixture"]), learn).collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r, text in zip(rows, texts, strict=True):
        letters = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert [r.lang_pred for r in rows[-3:]] == ["aa", "bb", "aa"]
    shares = {m.lang: m.share for m in rows[-1].mixture}
    assert abs(shares["aa"] - 0.75) < 0.1 and abs(sum(shares.values()) - 1) < 1e-6
    assert {r.lang_pred for r in language_mixtures(docs_of(spark, texts), learn.limit(0)).collect()} == {"und"}


def test_mixture_recovers_proportions():
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 1000, (64, 3)).astype(float) ** 2
    model = Mixture(["x", "y", "z"], counts)
    p = model.p @ np.array([0.7, 0.0, 0.3])
    got = model.infer(rng.choice(64, 40_000, p=p / p.sum()))
    assert set(got) == {0, 2} and abs(got[0] - 0.7) < 0.05


def test_quality_held_out(spark, truth):
    rows = op6_quality_cotraining(spark, FOLDER).collect()
    known = [r for r in rows if truth[r.doc_id].quality is not None]
    assert sum(r.kept == bool(truth[r.doc_id].quality) for r in known) > 0.97 * len(known)


def test_quality_unseen_labels(spark, truth):
    """Labels of one fold only; the others are held out."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality_scores(docs, labels.where("doc_id % 3 <> 0")).collect()
    held = [r for r in rows if r.doc_id % 3 == 0 and truth[r.doc_id].quality is not None]
    assert auc([r.score for r in held], [truth[r.doc_id].quality for r in held]) > 0.97


def test_quality_rows(spark):
    texts = ODD + [prose(random.Random(k), 30) for k in range(10)]
    labels = spark.createDataFrame([(20, 1), (21, 0), (22, None), (None, 1)], "doc_id bigint, label int")
    docs = docs_of(spark, texts, ["score"]).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    for known in (labels, labels.limit(0), labels.where("label = 1")):
        rows = quality_scores(docs, known).collect()
        assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_quality_pool_is_the_corpus(spark):
    """A kind of page beyond any fixed pool, without labels, is learned from the other view."""
    rng = random.Random(21)
    good, bad = ["meadow river", "harbour lantern"], ["casino jackpot", "prize bonus"]

    def text(words, extra):
        return " ".join(rng.choice(words) for _ in range(12)) + extra

    rows = [(k, text((bad, good)[k % 2], ""), "en", ("spam", "press")[k % 2], 100) for k in range(400)]
    # The only 12 pages of two rare kinds hide in 9,000 unlabelled ones; the source tells what they are.
    rows += [(1000 + k, text((bad, good)[k % 2], ""), "en", ("spam", "press")[k % 2], 100) for k in range(9000)]
    rows += [(20_000 + k, (" zqzq" * 30, " vjvj" * 30)[k % 2], "en", ("spam", "press")[k % 2], 100) for k in range(12)]
    probe = [(30_000 + k, (" zqzq" * 30, " vjvj" * 30)[k % 2], "en", "other", 100) for k in range(2)]
    docs = spark.createDataFrame(rows + probe, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id bigint, label int")
    scores = {r.doc_id: r.text_score for r in quality_scores(docs, labels).where("doc_id >= 30000").collect()}
    assert scores[30_001] - scores[30_000] > 0.3
