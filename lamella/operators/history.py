"""Evaluation history: models, evaluations and metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.operators.evaluation import OVERALL
from lamella.session import durable, numbered

# The age limits offered for the history, in days (NULL = all).
TIME_RANGES = {"all": None, "day": 1, "week": 7, "month": 30, "year": 365}


def _with_ids(new: DataFrame, current: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number ``new`` on from the greatest id in ``current``."""
    top = current.agg(F.max("id")).scalar()
    rows = numbered(new, [F.col(c).asc() for c in order], (), "_k")
    return rows.withColumn("id", F.coalesce(top, F.lit(0)) + F.col("_k")).drop("_k")


def save_evaluations(
    runs: DataFrame, metrics: DataFrame, models: DataFrame, evaluations: DataFrame
) -> dict[str, DataFrame]:
    """The rows that finished runs add to models, evaluations and evaluation_metrics.

    ``runs`` holds run_id, model_name, task, created_at, iou_threshold, n_slides and
    images; ``metrics`` holds run_id and metric rows, overall ones included. A known
    (name, type) keeps its model id. Segmentation runs have no IoU threshold.
    """
    names = runs.select(F.col("model_name").alias("name"), F.col("task").alias("model_type")).distinct()
    unknown = names.join(models, ["name", "model_type"], "left_anti")
    new_models = durable(_with_ids(unknown, models, ["name", "model_type"]).select("id", "name", "model_type"))
    every = models.select("id", "name", "model_type").unionByName(new_models).select(
        F.col("id").alias("model_id"), F.col("name").alias("model_name"), F.col("model_type").alias("task")
    )
    per_run = metrics.groupBy("run_id").agg(
        F.sum(F.when(~F.col("is_overall"), F.col("n_fovs"))).cast("bigint").alias("n_fovs"),
        F.sort_array(F.collect_list(F.when(~F.col("is_overall"), F.col("marker")))).alias("markers"),
    )
    rows = runs.join(every, ["model_name", "task"]).join(per_run, "run_id", "left")
    rows = rows.withColumns(
        {
            "iou_threshold": F.when(F.col("task") == "detection", F.col("iou_threshold")),
            "n_fovs": F.coalesce("n_fovs", F.lit(0)),
            "markers": F.coalesce("markers", F.array().cast("array<string>")),
        }
    )
    new_evals = durable(_with_ids(rows, evaluations, ["created_at", "run_id"]))
    ids = new_evals.select("run_id", F.col("id").alias("evaluation_id"))
    return {
        "models": new_models,
        "evaluations": new_evals.select(
            "id", "model_id", "created_at", "iou_threshold", "n_slides", "n_fovs", "images", "markers"
        ),
        "evaluation_metrics": metrics.join(ids, "run_id").drop("run_id"),
    }


def delete_evaluations(
    ids: DataFrame, models: DataFrame, evaluations: DataFrame, metrics: DataFrame
) -> dict[str, DataFrame]:
    """What stays: other evaluations, their metrics, and models still in use."""
    gone = ids.select("id").distinct()
    kept = evaluations.join(gone, "id", "left_anti")
    used = kept.select(F.col("model_id").alias("id")).distinct()
    return {
        "models": models.join(used, "id", "left_semi"),
        "evaluations": kept,
        "evaluation_metrics": metrics.join(gone.withColumnRenamed("id", "evaluation_id"), "evaluation_id", "left_anti"),
    }


def evaluation_records(models: DataFrame, evaluations: DataFrame, metrics: DataFrame) -> DataFrame:
    """Evaluations with their model and nested metric rows (markers sorted, overall last)."""
    fields = [c for c in metrics.columns if c not in ("evaluation_id", "is_overall", "marker")]
    nested = metrics.groupBy(F.col("evaluation_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("is_overall", "marker", *fields))).alias("metrics")
    )
    m = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "model_type")
    return evaluations.join(m, "model_id").join(nested, "id", "left")


def newest_first(evaluations: DataFrame) -> DataFrame:
    return evaluations.orderBy(F.desc("created_at"), F.desc("id"))


def primary_score(model_type: Column, f1: Column, dice: Column) -> Column:
    """F1, or mean Dice for segmentation, at three decimals."""
    return F.bround(F.when(model_type == "segmentation", dice).otherwise(f1), 3)


def marker_columns(evaluations: DataFrame) -> DataFrame:
    """Sorted distinct markers over the evaluations' marker lists."""
    return evaluations.select(F.explode("markers").alias("marker")).distinct().orderBy("marker")


def evaluation_pivot(scores: DataFrame, markers: Sequence[str] | None = None, unnamed: str = "unnamed") -> DataFrame:
    """One row per evaluation, one column per marker plus OVERALL, NULL where absent.

    ``scores`` holds evaluation_id, marker and score. Without a list, every marker that
    occurs has a column (Spark looks for them in a job of its own); the empty marker's
    column is called ``unnamed``.
    """
    named = scores.withColumn("marker", F.when(F.col("marker") == "", F.lit(unnamed)).otherwise(F.col("marker")))
    columns = None if markers is None else [*(m or unnamed for m in markers), OVERALL]
    wide = named.groupBy("evaluation_id").pivot("marker", columns).agg(F.first("score"))
    return wide.withColumnRenamed(OVERALL, "OVERALL")


def filter_evaluations(records: DataFrame, name: str, max_age_days: int | None, now: Column) -> DataFrame:
    """Model name contains the text (any case); with an age limit, created since then."""
    out = records.where(F.contains(F.lower("model_name"), F.lit(name.strip().lower())))
    if max_age_days is None:
        return out
    created = F.col("created_at")
    if records.schema["created_at"].dataType.simpleString() == "string":
        created = nm.parse_time(created)
    return out.where(created >= now - F.make_dt_interval(F.lit(max_age_days)))


def sort_evaluations(records: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Sort by a column; missing values come first ascending and last descending."""
    col = F.col(key)
    return records.orderBy(col.asc_nulls_first() if ascending else col.desc_nulls_last(), "id")
