"""Scalar expressions for scores, ratios and arrays of class values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(F.lit(2.0) * p * r, p + r)}


def sigmoid(v: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-v))


def argmax(values: Column) -> Column:
    """Index of the largest array element, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def labels_sequential(labels: Column) -> Column:
    """Whether the labels other than 0 are exactly 1..max."""
    found = F.array_except(F.array_distinct(labels), F.array(F.lit(0)))
    top = F.array_max(labels)
    return F.when(top < 1, F.size(found) == 0).otherwise(
        (F.size(found) == top) & (F.array_min(found) == 1)
    )
