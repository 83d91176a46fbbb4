"""Detector evaluation: greedy matching, counts, ratios, mask scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lamella.functions import boxes as bx
from lamella.functions.scores import precision_recall_f1
from lamella.operators.regions import connected_components
from lamella.operators.spatial import overlap_pairs
from lamella.session import durable

OVERALL = "__overall__"
#: Rounds of mutual best pairs before what is left is matched component by component.
ROUNDS = 2
#: A group with no more pairs of a truth box and a prediction is matched in one stretch of rows.
GROUP_PAIRS = 250_000


def _mutual_round(left: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Take all pairs that are the best of both their boxes: (taken with m, the pairs left).

    Under a total order such a pair is always in the greedy result. The round needs only
    per-box maxima, combined before the shuffle.
    """
    rank = F.struct("iou", "pred", "gt")
    best_p = left.groupBy(*keys, "pred").agg(F.max(rank).alias("b"), F.first("np").alias("np")).select(*keys, "pred", "b.gt", "np")
    best_g = left.groupBy(*keys, "gt").agg(F.max(rank).alias("b"), F.first("ng").alias("ng")).select(*keys, "b.pred", "gt", "ng")
    taken = best_p.join(best_g, [*keys, "pred", "gt"]).withColumn("m", F.least("np", "ng")).drop("np", "ng")
    taken = durable(taken)
    used_p = taken.select(*keys, "pred", F.col("m").alias("_mp"))
    used_g = taken.select(*keys, "gt", F.col("m").alias("_mg"))
    rest = left.join(used_p, [*keys, "pred"], "left").join(used_g, [*keys, "gt"], "left")
    rest = rest.withColumns(
        {"np": F.col("np") - F.coalesce("_mp", F.lit(0)), "ng": F.col("ng") - F.coalesce("_mg", F.lit(0))}
    )
    return taken, durable(rest.where("np > 0 AND ng > 0").select(*left.columns))


def _component_matches(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Greedy matching per connected component of the pairs, which are streamed in order.

    Pairs that share no box do not contend. A task reads the pairs of its components from
    the best one on and remembers only what is left of the boxes of the present one.
    """

    def node(side: str, key: str) -> Column:
        return F.struct(*keys, F.lit(side).alias("_side"), F.col(key).cast("string").alias("_key"))

    labels = connected_components(pairs.select(node("p", "pred").alias("a"), node("g", "gt").alias("b")))
    at = labels.select(F.col("id").alias("_node"), F.to_json("label").alias("_label"))
    labelled = pairs.withColumn("_node", node("p", "pred")).join(at, "_node")
    return _streamed(labelled, ["_label"], [*keys, "pred", "gt"])


def _streamed(pairs: DataFrame, by: Sequence[str], own: Sequence[str]) -> DataFrame:
    """The pairs (own, m) taken in descending (iou, pred, gt) order per ``by``.

    A task remembers only what is left of the boxes of the present stretch of pairs. The
    window brings the pairs of a stretch together; Spark may drop a repartition for it.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("iou"), F.desc("pred"), F.desc("gt")))
    text = [F.col(c).cast("string").alias(f"_{c}") for c in ("pred", "gt")]
    ranked = pairs.withColumn("_rank", rank).sortWithinPartitions(*by, "_rank").select(*own, "np", "ng", "_rank", *text)
    shape = pairs.select(*own, F.col("np").alias("m")).schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_p, free_g = {}, {}
        for batch in batches:
            places, counts = [], []
            rows = zip(*(c.to_pylist() for c in batch.columns[len(own) :]), strict=True)
            for place, (n_pred, n_gt, rank, pred, gt) in enumerate(rows):
                if rank == 1:
                    free_p, free_g = {}, {}
                m = min(free_p.get(pred, n_pred), free_g.get(gt, n_gt))
                if m > 0:
                    free_p[pred], free_g[gt] = free_p.get(pred, n_pred) - m, free_g.get(gt, n_gt) - m
                    places.append(place)
                    counts.append(m)
            kept = batch.take(pa.array(places, pa.int64())).columns[: len(own)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, arrow.types[-1])], schema=arrow)

    return ranked.mapInArrow(run, shape)


def _matches(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs (keys, pred, gt, m) taken in descending (iou, pred, gt) order.

    ``pairs`` also holds ``np`` and ``ng``, the number of equal boxes each side stands for;
    ``m`` is the number of matches of the pair. ``pairs`` are read often. Rounds that take mutual
    best pairs leave little, and that contends in small components.
    """
    left, found = pairs, []
    for _ in range(ROUNDS):
        taken, left = _mutual_round(left, keys)
        found.append(taken.select(*keys, "pred", "gt", "m"))
    if not left.isEmpty():
        found.append(_component_matches(left, keys))
    return reduce(DataFrame.unionByName, found)


def greedy_matches(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one pairs (keys, pred, gt) taken in descending (iou, pred, gt) order per group."""
    one = F.lit(1).cast("bigint")
    return _matches(durable(pairs.withColumns({"np": one, "ng": one})), list(keys)).drop("m")


_SIDES = ("x1", "y1", "x2", "y2")


def _tied(pairs: DataFrame, keys: Sequence[str], side: str, n: str) -> DataFrame:
    """Classes of several boxes with the same IoU as another class to one box.

    There the keys of the single boxes decide, so such classes must be taken apart.
    """
    level = [*keys, "gt" if side == "pred" else "pred", "iou"]
    several = pairs.groupBy(*level).agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
    return pairs.where(F.col(n) > 1).join(several, level, "left_semi").select(*keys, side).distinct()


def _take_apart(
    pairs: DataFrame, tied: DataFrame, boxes: DataFrame, classes: DataFrame, keys: Sequence[str], side: str, n: str
) -> DataFrame:
    """``pairs`` with the single boxes of ``tied`` classes in place of the class."""
    named = classes.select(*keys, *_SIDES, F.col("key").alias(side)).join(tied, [*keys, side], "left_semi")
    single = named.join(boxes.select(*keys, *_SIDES, "key"), [*keys, *_SIDES]).select(*keys, side, "key")
    opened = pairs.join(single, [*keys, side]).drop(side).withColumnRenamed("key", side)
    opened = opened.withColumn(n, F.lit(1).cast("bigint")).select(*pairs.columns)
    return pairs.join(tied, [*keys, side], "left_anti").select(*pairs.columns).unionByName(opened)


def box_classes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Classes of equal boxes of a group: their greatest ``key`` and their number ``n``."""
    return durable(df.groupBy(*keys, *_SIDES).agg(F.max("key").alias("key"), F.count("*").alias("n")))


def class_matches(gt: DataFrame, pred: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Greedy matches (keys, pred, gt, m) of classes of equal boxes.

    Equal boxes have the same IoU with everything, so copies are paired as one class
    with a count, and n copies against m copies make one pair instead of n * m. Only
    classes in a tie between different boxes are taken apart again.
    """
    keys = list(keys)
    cg, cp = [box_classes(df, keys) for df in (gt, pred)]
    score = bx.iou(bx.box("l_"), bx.box("r_"))

    def side(df: DataFrame, name: str, n: str, p: str) -> DataFrame:
        return df.select(*keys, F.col("key").alias(name), F.col("n").alias(n), *[F.col(c).alias(f"{p}{c}") for c in _SIDES])

    near = overlap_pairs(side(cp, "pred", "np", "l_"), side(cg, "gt", "ng", "r_"), keys, residual=score >= F.lit(float(threshold)))
    pairs = durable(near.select(*keys, "pred", "gt", score.alias("iou"), "np", "ng"))
    if not pairs.where("np > 1 OR ng > 1").isEmpty():
        tied_gt, tied_pred = _tied(pairs, keys, "gt", "ng"), _tied(pairs, keys, "pred", "np")
        pairs = _take_apart(pairs, tied_gt, gt, cg, keys, "gt", "ng")
        pairs = durable(_take_apart(pairs, tied_pred, pred, cp, keys, "pred", "np"))
    return _matches(pairs, keys)


def _group_matches(gt: DataFrame, pred: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Greedy matches (keys, m) of groups with few pairs of boxes, which are compared pair by pair.

    Boxes are shuffled once, by their group, and their pairs stay where they are made.
    """

    def side(df: DataFrame, name: str, p: str) -> DataFrame:
        # A box with a missing side touches nothing.
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in _SIDES])
        return df.where(known).select(*keys, F.col("key").alias(name), *[F.col(c).alias(f"{p}{c}") for c in _SIDES])

    score = bx.iou(bx.box("l_"), bx.box("r_"))
    met = side(pred, "pred", "l_").join(side(gt, "gt", "r_"), list(keys)).withColumn("iou", score)
    one = F.lit(1).cast("bigint")
    pairs = met.where(F.col("iou") >= F.lit(float(threshold))).select(*keys, "pred", "gt", "iou", one.alias("np"), one.alias("ng"))
    return _streamed(pairs, keys, keys)


def match_boxes(gt: DataFrame, pred: DataFrame, keys: Sequence[str], threshold: float = 0.3) -> DataFrame:
    """True positives, false positives and misses per group.

    Inputs hold ``keys``, an orderable ``key`` unique inside the group, and x1..y2. The
    threshold must be positive: boxes without common area never pair. Groups of at most
    ``GROUP_PAIRS`` pairs of a truth box and a prediction are matched by themselves. Larger
    ones are never gathered: classes of equal boxes, then mutual best pairs, then the
    components of what is left. Both give the same counts.
    """
    if threshold <= 0:
        raise ValueError("the IoU threshold must be positive")
    keys = list(keys)
    gt, pred = [durable(df.select(*keys, "key", *_SIDES)) for df in (gt, pred)]
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = gt.select(*keys, none.alias("_p"), one.alias("_g")).unionByName(pred.select(*keys, one.alias("_p"), none.alias("_g")))
    sizes = durable(sides.groupBy(*keys).agg(F.sum("_p").alias("_p"), F.sum("_g").alias("_g")))
    large = sizes.where(F.col("_p").cast("double") * F.col("_g") > GROUP_PAIRS).select(*keys)
    if large.isEmpty():
        found = _group_matches(gt, pred, keys, threshold)
    else:
        small, hot = [[df.join(large, keys, how) for df in (gt, pred)] for how in ("left_anti", "left_semi")]
        found = _group_matches(*small, keys, threshold).unionByName(class_matches(*hot, keys, threshold).select(*keys, "m"))
    matches = found.groupBy(*keys).agg(F.sum("m").alias("_m"))
    tp = F.coalesce("_m", F.lit(0)).cast("bigint")
    return sizes.join(matches, keys, "left").select(
        *keys, tp.alias("tp"), (F.col("_p") - tp).alias("fp"), (F.col("_g") - tp).alias("fn")
    )


def _with_overall(df: DataFrame, by: Sequence[str], marker: str, aggs: Sequence[Column]) -> DataFrame:
    sets = [[*by, marker], list(by)]
    out = df.groupingSets(sets, *by, marker).agg(F.grouping(marker).alias("_all"), *aggs)
    overall = F.col("_all") == 1
    return out.withColumn("is_overall", overall).withColumn(
        marker, F.when(overall, F.lit(OVERALL)).otherwise(F.col(marker))
    ).drop("_all")


def detection_metrics(matches: DataFrame, marker: str = "marker", by: Sequence[str] = ()) -> DataFrame:
    """Sums and ratios per marker, and over all markers as ``__overall__``.

    ``n_fovs`` counts input rows: one per field of view and marker.
    """
    n = F.sum("n_fovs") if "n_fovs" in matches.columns else F.count("*")
    sums = _with_overall(
        matches,
        by,
        marker,
        [*[F.sum(c).cast("bigint").alias(c) for c in ("tp", "fp", "fn")], n.cast("bigint").alias("n_fovs")],
    )
    prf = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select(*by, marker, "is_overall", "tp", "fp", "fn", *[c.alias(k) for k, c in prf.items()], "n_fovs")


def mask_scores(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Dice and pixel accuracy per group of rows with boolean ``gt`` and ``pred``.

    Two empty masks have Dice 1.
    """
    flag = lambda c: F.sum(c.cast("bigint"))
    g, p = F.col("gt"), F.col("pred")
    sums = pixels.groupBy(*keys).agg(
        (flag(g) + flag(p)).alias("total"), flag(g & p).alias("both"), flag(g == p).alias("same"), F.count("*").alias("n")
    )
    dice = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.col("both") / F.col("total"))
    return sums.select(*keys, dice.alias("dice"), (F.col("same") / F.col("n")).alias("accuracy"))


def mask_scores_arrays(gt: Column, pred: Column) -> dict[str, Column]:
    """The same scores for two boolean arrays of one row."""
    count = lambda a: F.size(F.filter(a, lambda v: v))
    total = count(gt) + count(pred)
    both = count(F.zip_with(gt, pred, lambda a, b: a & b))
    same = count(F.zip_with(gt, pred, lambda a, b: a == b))
    return {
        "dice": F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * both / total),
        "accuracy": F.when(F.size(gt) == 0, F.lit(1.0)).otherwise(same / F.size(gt)),
    }


def segmentation_metrics(scores: DataFrame, marker: str = "marker", by: Sequence[str] = ()) -> DataFrame:
    """Mean Dice and accuracy per marker; the overall row averages all fields of view."""
    out = _with_overall(
        scores,
        by,
        marker,
        [F.avg("dice").alias("mean_dice"), F.avg("accuracy").alias("mean_accuracy"), F.count("*").cast("bigint").alias("n_fovs")],
    )
    return out.select(*by, marker, "is_overall", "mean_dice", "mean_accuracy", "n_fovs")


def of_known_slides(rows: DataFrame, slide_paths: DataFrame) -> DataFrame:
    """The rows of slides with a recorded path."""
    known = slide_paths.where(F.col("slide_path").isNotNull()).select("slide_name").distinct()
    return rows.join(known, "slide_name", "left_semi")


def ground_truth_boxes(pairs: DataFrame, slide_paths: DataFrame | None, channels: Sequence[str] | None = None) -> DataFrame:
    """Truth boxes of slides with a recorded path, from markers-in-fields-of-view pairs.

    Boxes take the marker's own size. Fields of view and slides without a box of the
    wanted channels have no rows. Without ``slide_paths`` the fields of view were already
    those of known slides, which are far fewer rows to look up than the pairs.
    """
    from lamella.functions.boxes import centre_box

    rows = pairs if channels is None else pairs.where(F.col("biomarker").isin(list(channels)))
    rows = rows if slide_paths is None else of_known_slides(rows, slide_paths)
    sides = centre_box(*[F.col(c) for c in ("x", "y", "w", "h")])
    return rows.select(
        "slide_name",
        "fov_id",
        F.col("biomarker").alias("marker"),
        F.struct("created_at", "marker_id").alias("key"),
        *[c.alias(k) for k, c in sides.items()],
    )
