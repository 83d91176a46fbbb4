"""Languages of texts by mixture inference.

Byte trigrams of the lower-cased words give each language a distribution. A document is
explained as a mixture of languages whose proportions expectation-maximisation estimates
from the likelihoods of its trigrams; languages join the mixture one by one as long as the
likelihood gains more than the penalty for one language more.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import WORD_BYTES, bucket_of, map_rows, table, utf8

#: Buckets of trigrams, as a power of two.
BITS = 15
#: Steps of one estimation, its least change, and the penalty (in log likelihood, times the
#: log of the trigrams) of a language in the mixture. Trigrams overlap, so a document's
#: likelihood counts a third.
STEPS = 12
LEAST_CHANGE = 1e-3
PENALTY = 2.0
OVERLAP = 3
SMOOTHING = 0.1

LATIN = re.compile("[A-Za-z]")
#: As WORD_BYTES, with digits as spaces.
LETTER_BYTES = bytes(32 if 48 <= b <= 57 else b for b in WORD_BYTES)


def trigram_buckets(text: str | None, bits: int = BITS) -> np.ndarray:
    """The bucket of every byte trigram of the words, with one space around each word."""
    joined = b" " + b" ".join(utf8(text).translate(LETTER_BYTES).split()) + b" "
    if len(joined) < 3:
        return np.zeros(0, np.int64)
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((key * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Rows ``(lang, bucket, n)`` over all rows with a language; a task sends each pair once."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << bits, np.int64)
                sums[lang] += np.bincount(trigram_buckets(text, bits), minlength=1 << bits)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict(
                {"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(own[at], pa.int64())}
            )

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col), F.col(text_col))
    return rows.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Mixture:
    """Trigram distributions of languages, and the mixtures of documents."""

    def __init__(self, langs: list[str], counts: np.ndarray, penalty: float = PENALTY):
        self.langs, self.penalty = langs, penalty
        smooth = counts + SMOOTHING
        self.p = (smooth / smooth.sum(axis=0)).astype(np.float64)
        self.log_p = np.log(self.p)

    def estimate(self, likelihood: np.ndarray, n: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, float]:
        """Proportions of the chosen languages, and the log likelihood they reach."""
        own = likelihood[:, chosen]
        if len(chosen) == 1:
            return np.ones(1), float(n @ np.log(own[:, 0]))
        share, total = np.full(len(chosen), 1 / len(chosen)), n.sum()
        for _ in range(STEPS):
            weighted = own * share
            weighted *= (n / weighted.sum(axis=1))[:, None]
            new = weighted.sum(axis=0) / total
            change = np.abs(new - share).max()
            share = new
            if change < LEAST_CHANGE:
                break
        return share, float(n @ np.log(own @ share))

    def infer(self, buckets: np.ndarray) -> dict[int, float]:
        """Proportion of each language of the chosen set."""
        counts = np.bincount(buckets, minlength=len(self.p))
        at = np.flatnonzero(counts)
        n = counts[at].astype(np.float64)
        likelihood = self.p[at]
        step = self.penalty * np.log(n.sum() + 1)
        first = int(np.argmax(n @ self.log_p[at]))
        chosen, (share, reached) = [first], self.estimate(likelihood, n, [first])
        if len(self.langs) > 1:
            # The whole mixture tells in which order languages may join.
            every, _ = self.estimate(likelihood, n, list(range(len(self.langs))))
            for lang in np.argsort(-every).tolist():
                if lang == first:
                    continue
                more, value = self.estimate(likelihood, n, [*chosen, lang])
                if (value - reached) / OVERLAP <= step:
                    break
                chosen, share, reached = [*chosen, lang], more, value
        return dict(zip(chosen, share.tolist(), strict=True))


def language_mixtures(
    docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Rows ``(id, lang_pred, score, mixture)``, one per row of ``docs``.

    Learns from the text and language of all rows of ``learn_from`` with a language.
    ``mixture`` has the proportions of the chosen languages, ``lang_pred`` is the largest
    (the first by name on a tie), ``score`` its proportion. A text that is null or has no
    letter is ``und`` with score 0, as is every text where no language was learned.
    Repeated rows are predicted each. Tasks get one array per learned language.
    """
    spark = docs.sparkSession
    sums: dict[str, np.ndarray] = {}
    for r in trigram_counts(learn_from, lang_col, text_col).toLocalIterator():
        sums.setdefault(r["lang"], np.zeros(1 << BITS))[r["bucket"]] = r["n"]
    langs = sorted(sums)
    held = spark.sparkContext.broadcast((langs, np.stack([sums[k] for k in langs], axis=1) if langs else None))
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        names, counts = held.value
        model = Mixture(names, counts) if names else None

        def step(ids, texts):
            preds, scores, mixtures = [], [], []
            for text in texts:
                mixture = {}
                if model is not None and text and (LATIN.search(text) or any(map(str.isalpha, text))):
                    buckets = trigram_buckets(text)
                    mixture = model.infer(buckets) if len(buckets) else {}
                best = min(mixture, key=lambda k: (-mixture[k], names[k]), default=None)
                preds.append("und" if best is None else names[best])
                scores.append(0.0 if best is None else min(1.0, mixture[best]))
                mixtures.append([{"lang": names[k], "share": v} for k, v in sorted(mixture.items())])
            return ids, preds, scores, mixtures

        return step

    schema = f"`{id_col}` {kind}, lang_pred string, score double, mixture array<struct<lang: string, share: double>>"
    return map_rows(docs.select(F.col(id_col), F.col(text_col)), start, schema)


def op4_language_mixture(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_mixtures(docs, docs.where(bucket_of("doc_id", 3) != 1))
    return found.select(
        "doc_id",
        (bucket_of("doc_id", 3) == 1).alias("held_out"),
        "lang_pred",
        "score",
        F.size("mixture").cast("bigint").alias("n_languages"),
    )
