"""Quality by co-training: a text-content and a page-metadata classifier teach each other.

Both start from a bounded sample of labelled documents. In every round each labels the
documents it is sure of, among all documents outside that sample, and the other learns
them. The two are then calibrated on held-out labels and combined, and score all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import bounded_rows, discard, distinct_labels, labelled_sample, map_rows, stored, table, utf8

#: Labelled rows at most, rounds, calibrated probability of a class from which a label is handed over.
LABELLED = 4000
ROUNDS = 4
SURE = 0.95
PASSES = 4
BITS = 15
#: Tasks that combine what the parts of the pool have learned, feature by feature.
COMBINED = 16
#: Numbers of the metadata view: hashed categories first, then dense values.
CATEGORIES = 256
DENSE = 10
#: A document with at least this combined score is kept.
KEEP = 0.5


def text_view(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the raw text: features and values of length 1."""
    b = np.frombuffer(b" " + utf8(text) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    hashed = (key * np.uint32(2654435761)) >> np.uint32(32 - bits)
    # Sorting a text's own hashes takes less than looking through all features.
    hashed.sort()
    first = np.concatenate([[0], np.flatnonzero(hashed[1:] != hashed[:-1]) + 1])
    at = hashed[first].astype(np.int64)
    value = np.sqrt(np.diff(first, append=len(hashed)))
    return at, value / np.sqrt(value @ value)


def meta_view(text: str | None, source: str | None, lang: str | None, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """The page's metadata: source, language and size, and the shape of its layout."""
    raw = utf8(text)
    words, n = raw.split(), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    length = len(text or "") if n_chars is None else n_chars
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    blanks = int(counts[9:14].sum() + counts[32])
    w = max(1, len(words))
    dense = [
        np.log1p(max(0, length)) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(n / max(1, len(lines))) / 7,
        len(set(words)) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        counts[65:91].sum() / n,
        counts[list(b"#*$%&|<>!")].sum() / n * 4,
        counts[48:58].sum() / n,
        (len(raw) - blanks) / w / 10,
    ]
    names = (f"source={source}", f"lang={lang}", f"size={int(np.log2(max(1, length)))}", "bias")
    hashed = [zlib.crc32(x.encode("utf-8", "surrogatepass")) % CATEGORIES for x in names]
    at = np.array([*hashed, *range(CATEGORIES, CATEGORIES + DENSE)])
    return at, np.array([0.3, 0.3, 0.3, 1.0, *dense])


class Logistic:
    """Logistic regression on sparse rows by AdaGrad steps."""

    def __init__(self, size: int, rate: float = 0.5, l2: float = 1e-5):
        self.w, self.g = np.zeros(size + 1), np.full(size + 1, 1e-8)
        self.rate, self.l2 = rate, l2

    def margin(self, row) -> float:
        at, value = row
        return float(self.w[at] @ value + self.w[-1])

    def step(self, row, label: int, weight: float) -> None:
        at, value = row
        p = 1 / (1 + np.exp(-min(max(self.margin(row), -35.0), 35.0)))
        slope = (p - label) * weight
        step = slope * value + self.l2 * self.w[at]
        self.g[at] += step * step
        self.w[at] -= self.rate * step / np.sqrt(self.g[at])
        self.g[-1] += slope * slope
        self.w[-1] -= self.rate * slope / np.sqrt(self.g[-1])

    def learn(self, rows: list, labels: list[int], weight: list[float], passes: int, seed: int) -> None:
        order = np.random.default_rng(seed)
        for _ in range(passes):
            for k in order.permutation(len(rows)):
                self.step(rows[k], labels[k], weight[labels[k]])


class State:
    """Both models, their calibrations and the weights of the classes; None while a class has no labels."""

    def __init__(self):
        self.models = (Logistic(1 << BITS), Logistic(CATEGORIES + DENSE))
        self.curves = [(1.0, 0.0), (1.0, 0.0)]
        self.weight: list[float] | None = None

    def plain(self) -> tuple:
        """The state as arrays and numbers, which a broadcast can carry without this module."""
        return [(m.w, m.g) for m in self.models], self.curves, self.weight

    @staticmethod
    def of(plain: tuple) -> State:
        """A copy of what :meth:`plain` gave."""
        out = State()
        for model, (w, g) in zip(out.models, plain[0], strict=True):
            model.w, model.g = w.copy(), g.copy()
        out.curves, out.weight = list(plain[1]), plain[2]
        return out

    def odds(self, view: int, row) -> float:
        a, b = self.curves[view]
        return a * self.models[view].margin(row) + b


def calibration(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the held-out margins (Platt)."""
    a, b = 1.0, 0.0
    # Targets short of 0 and 1 keep the curve finite on separable data.
    up, down = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-6)
        g = np.array([r @ margins + 1e-3 * (a - 1), r.sum() + 1e-3 * b])
        m = np.array([[h @ margins**2 + 1e-3, h @ margins], [h @ margins, h.sum() + 1e-3]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def from_labels(sample: DataFrame, state: State, turn: int, passes: int = PASSES) -> State:
    """``state`` after it has learned the rows ``(_key, text, source, lang, n_chars, label)``.

    The rows are bounded and one task reads them. A fifth of them, by key, only
    calibrates; with few labels all of them do both.
    """
    given = sample.sparkSession.sparkContext.broadcast(state.plain())

    def run(batches) -> Iterator:
        import pyarrow as pa

        rows = sorted(
            (tuple(r[c] for c in ("_key", "text", "source", "lang", "n_chars", "label")) for b in batches for r in b.to_pylist()),
            key=lambda r: (r[0], r[1] or "", r[5]),
        )
        held = [r for r in rows if r[0] % 5 == 0]
        base = [r for r in rows if r[0] % 5]
        if len({r[5] for r in held}) < 2 or len({r[5] for r in base}) < 2:
            held = base = rows
        labels, truth = [r[5] for r in base], np.array([r[5] for r in held], float)
        weight = [len(labels) / (2 * max(1, labels.count(y))) for y in (0, 1)]
        for v, model in enumerate(State.of(given.value).models):
            view = (lambda r: text_view(r[1])) if v == 0 else (lambda r: meta_view(*r[1:5]))
            model.learn([view(r) for r in base], labels, weight, passes, turn)
            curve = calibration(np.array([model.margin(view(r)) for r in held]), truth) if held else (1.0, 0.0)
            at = np.flatnonzero((model.w != 0) | (model.g > 1e-8))
            # Features -1 and -2: slope and offset, and the weights of the classes.
            extra = [(-1, *curve), *([(-2, *weight)] if len(set(labels)) == 2 else [])]
            columns = [np.concatenate(c) for c in zip((at, model.w[at], model.g[at]), zip(*extra, strict=True), strict=True)]
            yield pa.RecordBatch.from_pydict(
                {"view": pa.array([v] * len(columns[0]), pa.int32()), "feature": pa.array(columns[0].astype(np.int32))}
                | {name: pa.array(c.astype(float)) for name, c in zip(("w", "g"), columns[1:], strict=True)}
            )

    out = State()
    for view, feature, w, g in sample.repartition(1).mapInArrow(run, "view int, feature int, w double, g double").toLocalIterator():
        if feature == -1:
            out.curves[view] = (w, g)
        elif feature == -2:
            out.weight = [w, g]
        else:
            out.models[view].w[feature], out.models[view].g[feature] = w, g
    given.destroy()
    return out


def from_each_other(pool: DataFrame, state: State, sure: float = SURE) -> State:
    """``state`` after each model has learned all rows of ``pool`` of which the other is sure.

    ``pool`` has the columns (text, source, lang, n_chars). Every task starts from the
    given models and learns the sure rows it reads, as they come. The moves of a feature
    are averaged over the tasks, each with the weight of the squared slopes it saw there.
    """
    given = pool.sparkSession.sparkContext.broadcast(state.plain())
    least = float(np.log(sure / (1 - sure)))

    def run(batches) -> Iterator:
        import pyarrow as pa

        known, own = State.of(given.value), State.of(given.value).models
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                views = (text_view(row[0]), meta_view(*row))
                for v, view in enumerate(views):
                    odds = known.odds(v, view)
                    if abs(odds) >= least:
                        label = int(odds > 0)
                        own[1 - v].step(views[1 - v], label, known.weight[label])
        for v, (model, old) in enumerate(zip(own, known.models, strict=True)):
            gain = model.g - old.g
            at = np.flatnonzero(gain > 0)
            yield pa.RecordBatch.from_pydict(
                {
                    "view": pa.array([v] * len(at), pa.int32()),
                    "feature": pa.array(at.astype(np.int32)),
                    "moved": pa.array((model.w - old.w)[at]),
                    "gain": pa.array(gain[at]),
                }
            )

    parts = pool.mapInArrow(run, "view int, feature int, moved double, gain double").repartition(COMBINED, "view", "feature")

    def exact(c):
        # Decimal sums do not depend on the order in which the tasks end.
        return F.sum(c.cast("decimal(38, 14)")).cast("double")

    sums = parts.groupBy("view", "feature").agg(
        exact(F.col("gain") * F.col("moved")).alias("moved"), exact(F.col("gain") * F.col("gain")).alias("squared"), exact(F.col("gain")).alias("gain")
    )
    out = State.of(state.plain())
    for view, feature, moved, squared, gain in bounded_rows(sums.where("gain > 0"), "moves"):
        out.models[view].w[feature] += moved / gain
        out.models[view].g[feature] += squared / gain
    given.destroy()
    return out


def quality_scores(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    labelled_rows: int = LABELLED,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Rows ``(id, text_score, meta_score, score)`` of all rows of ``docs``, with the columns ``carry``.

    ``docs`` has the columns of documents (id, text, lang, source, n_chars); ``labelled``
    rows ``(id, label)`` with label 1 for good. Learns from at most ``labelled_rows``
    labelled documents, those of the least hashes, and in every round from all other rows
    of ``docs`` of which a model is sure, also those without an id; labels beyond the
    sample are not looked at, and one row of a labelled id is learned. Nulls are values of their own (a null text is empty); labels
    without a document are left out; with no labels at all, or one class only, no labels
    are handed over and the scores say nothing but keep their range.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("_id"), "text", "source", "lang", "n_chars")
    known = labelled.select(F.col(id_col).alias("_id"), "label")
    chosen = labelled_sample(own, known, "_id", ["text", "source", "lang", "n_chars"], labelled_rows)
    sample = stored(
        chosen.select(
            "_id", F.crc32(F.col("_id").cast("string").cast("binary")).alias("_key"), "text", "source", "lang", "n_chars", "label"
        ),
        "labelled",
    )
    pool = own.join(F.broadcast(sample.select("_id").distinct()), "_id", "left_anti").drop("_id")
    state = from_labels(sample, State(), 0)
    for turn in range(1, ROUNDS + 1):
        if state.weight is not None:
            state = from_each_other(pool, state)
        state = from_labels(sample, state, turn)
    discard(sample)
    held = spark.sparkContext.broadcast(state.plain())
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        state = State.of(held.value)

        def step(ids, texts, sources, langs, sizes):
            out: list[list] = [[], [], []]
            for text, source, lang, size in zip(texts, sources, langs, sizes, strict=True):
                odds = [state.odds(0, text_view(text)), state.odds(1, meta_view(text, source, lang, size))]
                for column, x in zip(out, (*odds, sum(odds) / 2), strict=True):
                    column.append(float(1 / (1 + np.exp(-np.clip(x, -35, 35)))))
            return ids, *out

        return step

    rows = docs.select(F.col(id_col), "text", "source", "lang", "n_chars", *carry)
    return map_rows(rows, start, f"`{id_col}` {kind}, text_score double, meta_score double, score double", len(carry))


def op6_quality_cotraining(spark, folder: str) -> DataFrame:
    labels = distinct_labels(table(spark, folder, "labels"), "quality")
    scored = quality_scores(table(spark, folder, "documents"), labels)
    return scored.withColumn("kept", F.col("score") >= KEEP)
