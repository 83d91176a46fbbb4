"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

Every coordinate has its own learning rate, and the L1 part of the proximal step keeps
most weights at exactly zero, so the model that is broadcast is a short list of (feature,
weight). The labelled rows it learns from are a bounded sample; scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import bucket_of, distinct_labels, labelled_sample, map_rows, table, words_of

#: Feature space, labelled rows at most, passes over them.
BITS = 20
ROWS = 20000
PASSES = 10
#: Learning rate, its offset, L1 and L2 of the proximal step.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1


def features(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """Feature numbers of words, word pairs, and pairs with one word between; with repeats."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        skips = h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1)
        every = np.concatenate([h, pairs, skips]) * np.uint64(0xD6E8FEB86659FD93)
    return (every >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal on binary features."""

    def __init__(self, bits: int = BITS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > self.l1, -(z - np.sign(z) * self.l1) / rate, 0.0)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step; ``at`` has no repeats."""
        w, b = self.weights(at), self.bias()
        p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
        g = p - label
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
        step = ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha
        self.bias_z += g - step * b
        self.bias_n += g * g


def fit(sample: DataFrame, text_col: str = "text", passes: int = PASSES, bits: int = BITS) -> DataFrame:
    """Rows ``(feature, weight)`` of a model of ``(text, label)`` rows; feature -1 is the bias.

    ``sample`` is bounded; one task learns from it, in the order of the rows' hashes, and
    can be run again elsewhere with the same result.
    """

    def run(batches) -> Iterator:
        import pyarrow as pa

        rows = sorted(
            (r["_key"], r[text_col] or "", r["label"]) for batch in batches for r in batch.to_pylist()
        )
        model = Ftrl(bits)
        data = [(np.unique(features(words_of(text), bits)).astype(np.int32), label) for _, text, label in rows]
        for _ in range(passes):
            for at, label in data:
                model.learn(at, label)
        every = np.flatnonzero(np.abs(model.z) > model.l1)
        numbers, weights = np.append(every, -1), np.append(model.weights(every), model.bias())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(numbers, pa.int64()), "weight": pa.array(weights, pa.float64())})

    rows = sample.select(F.xxhash64(text_col).alias("_key"), text_col, "label").repartition(1)
    return rows.mapInArrow(run, "feature bigint, weight double")


def score_texts(
    docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS
) -> DataFrame:
    """Rows ``(id, score)``, one per row of ``docs``; null and empty texts get the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        known = dict(held.value)
        bias = known.pop(-1, 0.0)
        dense = np.zeros(1 << bits)
        dense[list(known)] = list(known.values())
        active = dense != 0

        def step(ids, texts):
            out = []
            for text in texts:
                at = features(words_of(text), bits)
                total = bias + dense[np.unique(at[active[at]])].sum()
                out.append(float(1 / (1 + np.exp(-np.clip(total, -35, 35)))))
            return ids, out

        return step

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, f"`{id_col}` {kind}, score double")


def toxicity_scores(
    docs: DataFrame,
    labelled: DataFrame,
    rows: int = ROWS,
    passes: int = PASSES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows ``(id, score)`` of all ``docs``, learned from at most ``rows`` rows ``(id, label)``.

    Labels of ids without a document and null ids are left out. With one class only, or
    no labels, the score is the same for all texts. Repeated rows are scored each, but
    one row of an id is learned.
    """
    sample = labelled_sample(docs, labelled, id_col, [text_col], rows)
    weights = {r["feature"]: r["weight"] for r in fit(sample, text_col, passes).toLocalIterator()}
    return score_texts(docs, weights, id_col, text_col)


def op3_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = distinct_labels(table(spark, folder, "labels"), "toxic")
    scored = toxicity_scores(docs, labels.where(bucket_of("doc_id", 5) != 0))
    return scored.select(
        "doc_id",
        (bucket_of("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
