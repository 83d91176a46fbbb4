"""Queries on the evaluation history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions import names as nm
from lamella.functions.scores import precision_recall_f1
from lamella.operators import evaluation as ev
from lamella.operators import history as hs
from lamella.plans.flagship import RATIO_SQL, rounded
from lamella.plans.registry import query
from lamella.session import numbered
from lamella.sources.derived import Tables

COUNTS_SQL = {
    "em": RATIO_SQL.replace("{by}", "evaluation_id, ")
    + """SELECT evaluation_id, CASE WHEN grouping(marker) = 1 THEN '__overall__' ELSE marker END AS marker, grouping(marker) = 1 AS is_overall, CAST(SUM(tp) AS BIGINT) AS tp,
 CAST(SUM(fp) AS BIGINT) AS fp, CAST(SUM(fn) AS BIGINT) AS fn, CAST(SUM(n_fovs) AS BIGINT) AS n_fovs FROM {evaluation_counts} GROUP BY GROUPING SETS ((evaluation_id, marker), (evaluation_id))) a) b""",
    "scored": """SELECT m.evaluation_id, m.marker, round_even(CASE WHEN d.model_type = 'segmentation' THEN m.recall ELSE m.f1 END, 3) AS score
 FROM {em} m JOIN {evaluations} e ON e.id = m.evaluation_id JOIN {eval_models} d ON d.id = e.model_id""",
    "runs": """SELECT CAST(e.id AS BIGINT) AS run_id, d.name || CASE WHEN e.id % 2 = 0 THEN '-v2' ELSE '' END AS model_name, d.model_type AS task, e.created_at
 FROM {evaluations} e JOIN {eval_models} d ON d.id = e.model_id""",
    "newm": """SELECT name, model_type, (SELECT MAX(id) FROM {eval_models}) + row_number() OVER (ORDER BY name, model_type) AS id FROM (
 SELECT DISTINCT model_name AS name, task AS model_type FROM {runs}) q WHERE NOT EXISTS (SELECT 1 FROM {eval_models} k WHERE k.name = q.name AND k.model_type = q.model_type)""",
    "gone": "SELECT e.id FROM {evaluations} e JOIN {eval_models} d ON d.id = e.model_id WHERE d.model_type = 'segmentation' OR e.created_at < TIMESTAMP '1996-01-01'",
}


def metrics_of(t: Tables) -> DataFrame:
    sums = ev.detection_metrics(t.evaluation_counts, by=["evaluation_id"])
    return rounded(sums, "precision", "recall", "f1")


def records_of(t: Tables) -> DataFrame:
    m = t.eval_models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"), "model_type")
    return t.evaluations.join(m, "model_id")


@query(
    "evaluation_metrics",
    "SELECT evaluation_id, marker, is_overall, tp, fp, fn, precision, recall, f1, n_fovs FROM {em}",
    COUNTS_SQL,
)
def evaluation_metrics(t: Tables) -> DataFrame:
    return metrics_of(t)


@query(
    "precision_recall_f1",
    "SELECT evaluation_id, marker, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p+r = 0 THEN 0 ELSE 2*p*r/(p+r) END, 6) AS f1 FROM (SELECT *, CASE WHEN tp+fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE)/(tp+fp) END AS p, CASE WHEN tp+fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE)/(tp+fn) END AS r FROM (SELECT evaluation_id, marker, CASE WHEN fn = 1 THEN 0 ELSE tp END AS tp, CASE WHEN fn = 1 THEN 0 ELSE fp END AS fp, fn FROM {evaluation_counts}) z) q",
)
def prf(t: Tables) -> DataFrame:
    one = F.col("fn") == 1
    c = t.evaluation_counts.withColumns({k: F.when(one, 0).otherwise(F.col(k)) for k in ("tp", "fp")})
    cols = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return rounded(c.select("evaluation_id", "marker", *[v.alias(k) for k, v in cols.items()]), *cols)


@query(
    "save_evaluation",
    """SELECT r.run_id, (SELECT MAX(id) FROM {evaluations}) + row_number() OVER (ORDER BY r.created_at, r.run_id) AS evaluation_id,
 COALESCE(n.id, k.id) AS model_id, CASE WHEN r.task = 'detection' THEN CAST(0.3 AS DOUBLE) END AS iou_threshold, COALESCE(x.n_fovs, 0) AS n_fovs, COALESCE(x.markers, '') AS markers
 FROM {runs} r LEFT JOIN {newm} n ON n.name = r.model_name AND n.model_type = r.task LEFT JOIN {eval_models} k ON k.name = r.model_name AND k.model_type = r.task
 LEFT JOIN (SELECT evaluation_id, CAST(SUM(n_fovs) AS BIGINT) AS n_fovs, string_agg(marker, ',' ORDER BY marker) AS markers FROM {evaluation_counts} GROUP BY evaluation_id) x ON x.evaluation_id = r.run_id""",
    COUNTS_SQL,
)
def save_evaluation(t: Tables) -> DataFrame:
    r = records_of(t)
    suffix = F.when(F.col("id") % 2 == 0, "-v2").otherwise("")
    runs = r.select(
        F.col("id").alias("run_id"),
        F.concat("model_name", suffix).alias("model_name"),
        F.col("model_type").alias("task"),
        "created_at",
        F.lit(0.3).alias("iou_threshold"),
        F.lit(1).alias("n_slides"),
        # The run id travels in the image list, which the history stores as it is.
        F.array(F.col("id").cast("string")).alias("images"),
    )
    metrics = metrics_of(t).withColumnRenamed("evaluation_id", "run_id")
    added = hs.save_evaluations(runs, metrics, t.eval_models, t.evaluations)["evaluations"]
    return added.select(
        F.get("images", 0).cast("bigint").alias("run_id"),
        F.col("id").alias("evaluation_id"),
        "model_id",
        "iou_threshold",
        "n_fovs",
        nm.csv_join(F.col("markers")).alias("markers"),
    )


@query(
    "delete_evaluations",
    """SELECT 'model' AS kind, CAST(m.id AS BIGINT) AS id, CAST(0 AS BIGINT) AS n FROM {eval_models} m WHERE EXISTS (SELECT 1 FROM {evaluations} e WHERE e.model_id = m.id AND e.id NOT IN (SELECT id FROM {gone}))
 UNION ALL SELECT 'evaluation', e.id, COUNT(x.marker) FROM {evaluations} e LEFT JOIN {evaluation_counts} x ON x.evaluation_id = e.id WHERE e.id NOT IN (SELECT id FROM {gone}) GROUP BY e.id""",
    COUNTS_SQL,
)
def delete_evaluations(t: Tables) -> DataFrame:
    old = F.col("created_at") < F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))
    gone = records_of(t).where((F.col("model_type") == "segmentation") | old).select("id")
    kept = hs.delete_evaluations(gone, t.eval_models, t.evaluations, t.evaluation_counts)
    counts = kept["evaluation_metrics"].groupBy(F.col("evaluation_id").alias("id")).agg(F.count("*").alias("n"))
    models = kept["models"].select(F.lit("model").alias("kind"), F.col("id").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("n"))
    evals = kept["evaluations"].join(counts, "id", "left")
    return models.unionByName(evals.select(F.lit("evaluation").alias("kind"), "id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


@query(
    "evaluation_records",
    """SELECT e.id, m.name AS model_name, e.created_at, x.metrics FROM {evaluations} e JOIN {eval_models} m ON m.id = e.model_id
 LEFT JOIN (SELECT evaluation_id, string_agg(marker || ':' || CAST(tp AS STRING) || ':' || CAST(fp AS STRING) || ':' || CAST(fn AS STRING), ';' ORDER BY is_overall, marker) AS metrics FROM {em} GROUP BY evaluation_id) x ON x.evaluation_id = e.id""",
    COUNTS_SQL,
)
def evaluation_records(t: Tables) -> DataFrame:
    text = F.transform("metrics", lambda m: F.concat_ws(":", m["marker"], m["tp"], m["fp"], m["fn"]))
    rec = hs.evaluation_records(t.eval_models, t.evaluations, metrics_of(t))
    return rec.select("id", "model_name", "created_at", F.array_join(text, ";").alias("metrics"))


def scores_of(t: Tables) -> DataFrame:
    rec = records_of(t).select(F.col("id").alias("evaluation_id"), "model_type")
    # Recall stands in for the mean Dice of segmentation models.
    score = hs.primary_score(F.col("model_type"), F.col("f1"), F.col("recall"))
    return metrics_of(t).join(rec, "evaluation_id").select("evaluation_id", "marker", score.alias("score"))


@query(
    "evaluation_pivot",
    """SELECT evaluation_id, MAX(CASE WHEN marker = 'CD68' THEN score END) AS "CD68", MAX(CASE WHEN marker = 'CD8' THEN score END) AS "CD8", MAX(CASE WHEN marker = 'FOXP3' THEN score END) AS "FOXP3",
 MAX(CASE WHEN marker = 'PanCK' THEN score END) AS "PanCK", MAX(CASE WHEN marker = '' THEN score END) AS "unnamed", MAX(CASE WHEN marker = '__overall__' THEN score END) AS "OVERALL" FROM {scored} GROUP BY evaluation_id""",
    COUNTS_SQL,
)
def evaluation_pivot(t: Tables) -> DataFrame:
    return hs.evaluation_pivot(scores_of(t))


@query("marker_columns", "SELECT DISTINCT marker FROM {evaluation_counts}")
def marker_columns(t: Tables) -> DataFrame:
    lists = t.evaluation_counts.groupBy("evaluation_id").agg(F.sort_array(F.collect_set("marker")).alias("markers"))
    return hs.marker_columns(lists)


@query(
    "filter_evaluations",
    "SELECT e.id, m.name AS model_name, e.created_at FROM {evaluations} e JOIN {eval_models} m ON m.id = e.model_id WHERE contains(m.name, 'n_1') AND e.created_at >= TIMESTAMP '1997-06-30' - INTERVAL 365 DAY",
)
def filter_evaluations(t: Tables) -> DataFrame:
    now = F.to_timestamp_ntz(F.lit("1997-06-30 00:00:00"))
    return hs.filter_evaluations(records_of(t), " N_1 ", hs.TIME_RANGES["year"], now).select("id", "model_name", "created_at")


@query("evaluations_newest_first", "SELECT id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS pos FROM {evaluations}")
def evaluations_newest_first(t: Tables) -> DataFrame:
    rows = hs.newest_first(t.evaluations).select("id", "created_at")
    return numbered(rows, [F.desc("created_at"), F.desc("id")], (), "pos")


@query(
    "sort_evaluations",
    "SELECT id, iou_threshold, row_number() OVER (ORDER BY iou_threshold ASC NULLS FIRST, id) AS pos FROM {evaluations}",
)
def sort_evaluations(t: Tables) -> DataFrame:
    rows = hs.sort_evaluations(t.evaluations.select("id", "iou_threshold"), "iou_threshold")
    return numbered(rows, [F.col("iou_threshold").asc_nulls_first(), F.col("id").asc()], (), "pos")


@query(
    "iso_date_local",
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'no date ' || CAST(id AS STRING) ELSE strftime(created_at, '%Y-%m-%d %H:%M') END AS shown FROM {evaluations}",
)
def iso_date_local(t: Tables) -> DataFrame:
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("no date "), F.col("id"))).otherwise(
        F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    )
    return t.evaluations.select("id", nm.iso_date_local(text).alias("shown"))


@query(
    "csv_list",
    "SELECT e.id AS evaluation_id, COALESCE(x.joined, '') AS joined, CAST(CASE WHEN COALESCE(x.joined, '') = '' THEN 0 ELSE x.n END AS INT) AS n FROM {evaluations} e LEFT JOIN (SELECT evaluation_id, string_agg(DISTINCT marker, ',' ORDER BY marker) AS joined, COUNT(DISTINCT marker) AS n FROM {evaluation_counts} GROUP BY evaluation_id) x ON x.evaluation_id = e.id",
)
def csv_list(t: Tables) -> DataFrame:
    named = t.evaluation_counts.groupBy("evaluation_id").agg(F.sort_array(F.collect_set("marker")).alias("ms"))
    rows = t.evaluations.select(F.col("id").alias("evaluation_id")).join(named, "evaluation_id", "left")
    joined = nm.csv_join(F.coalesce("ms", F.array().cast("array<string>")))
    return rows.select("evaluation_id", joined.alias("joined")).withColumn("n", F.size(nm.csv_split(F.col("joined"))))
