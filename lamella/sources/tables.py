"""Annotation tables on disk: schemas, reading, and replacing the rows of saved slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.session import durable, is_small

ANNOTATIONS = (
    "id string, type string, created_at timestamp, modified_at timestamp, created_by string, "
    "color_r int, color_g int, color_b int, biomarker string, x double, y double, w double, h double, slide_name string"
)
REGION_POINTS = "annotation_id string, seq int, px double, py double, ring int, slide_name string"
SLIDE_PATHS = "slide_name string, slide_path string"
MODELS = "id bigint, name string, model_type string"
EVALUATIONS = (
    "id bigint, model_id bigint, created_at timestamp, iou_threshold double, n_slides int, n_fovs bigint, "
    "images array<string>, markers array<string>"
)
EVALUATION_METRICS = (
    "evaluation_id bigint, marker string, is_overall boolean, tp bigint, fp bigint, fn bigint, precision double, "
    "recall double, f1 double, mean_dice double, mean_accuracy double, n_fovs bigint"
)
SCHEMAS = {
    "annotations": ANNOTATIONS,
    "region_points": REGION_POINTS,
    "slide_paths": SLIDE_PATHS,
    "models": MODELS,
    "evaluations": EVALUATIONS,
    "evaluation_metrics": EVALUATION_METRICS,
}
#: One folder holds annotations and region points of all slides, so that one write replaces
#: both; ``record`` tells the rows apart. The third kind is the one row that replaces the
#: rows of a slide saved without annotations.
STORE = "annotation_store"
STORED = ANNOTATIONS.removesuffix(", slide_name string") + ", " + REGION_POINTS.removesuffix(", slide_name string")
STORED += ", record string, slide_name string"
ANNOTATION, POINT, EMPTY = "annotation", "point", "empty"
#: Slides are dealt to so many folders, however many there are. A store keeps its number.
BUCKETS = 256
#: A save leaves the files of other slides apart from its own, until a bucket has more than
#: so many files besides one for so many bytes.
SMALL_FILES, FILE_BYTES = 4, 8 << 20


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("slide_name"), F.lit(BUCKETS)).cast("int")


def _layout(spark: SparkSession, path: str) -> str | None:
    """The column whose values name the folders of the store; stores of before have one per slide."""
    if not _exists(spark, path):
        return None
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(place)
    while found.hasNext():
        name = found.next().getPath().getName()
        if "=" in name:
            return name.split("=")[0]
    return None


def _records(store: DataFrame, record: str, schema: str) -> DataFrame:
    names = store.sparkSession.createDataFrame([], schema).columns
    return store.where(F.col("record") == record).select(*names)


def read_annotations(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """annotations, region_points and slide_paths below ``root``.

    The first two are views of the store that :func:`save_annotations` writes. Its folders
    are buckets of slides, sorted by slide_name, so a slide filter skips row groups. Stores
    with a folder per slide are read as well. Roots from before the store hold a folder for
    each table. A root without slide paths has none.
    """
    if _exists(spark, f"{root}/{STORE}"):
        store = spark.read.schema(STORED).parquet(f"{root}/{STORE}")
        tables = {"annotations": _records(store, ANNOTATION, ANNOTATIONS), "region_points": _records(store, POINT, REGION_POINTS)}
    else:
        tables = _separate(spark, root)
    if _exists(spark, f"{root}/slide_paths"):
        return tables | {"slide_paths": read_table(spark, root, "slide_paths")}
    return tables | {"slide_paths": spark.createDataFrame([], SLIDE_PATHS)}


def _separate(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    annotations = read_table(spark, root, "annotations").where("type <> ''")
    points = read_table(spark, root, "region_points").where("annotation_id <> ''")
    return {"annotations": annotations, "region_points": upgrade_region_points(points)}


def upgrade_region_points(df: DataFrame) -> DataFrame:
    """Points of files from before rings existed belong to ring 0."""
    if "ring" not in df.columns:
        return df.withColumn("ring", F.lit(0))
    return df.withColumn("ring", F.coalesce("ring", F.lit(0)))


def save_annotations(
    annotations: DataFrame, points: DataFrame, slides: DataFrame, root: str, now: Column
) -> None:
    """Replace all rows of ``slides`` below ``root`` by the given rows; other slides stay.

    ``points`` are the region points of ``annotations``, with slide_name. Both go into one
    table and are replaced by one write, so no slide is ever seen with the annotations of
    one save and the points of another. Only the buckets of the saved slides are rewritten,
    their other slides as they are; so two saves of slides of one bucket must not run at the
    same time. Every saved slide has one row more, which reading leaves out, so that one
    without rows is replaced, too. The first save below a root with separate folders takes
    their other slides along. A store with a folder per slide keeps that form.

    The new files are complete before they take the place of any old one, so the rows may
    come from the store itself.
    """
    spark = annotations.sparkSession
    path = f"{root}/{STORE}"
    exists, layout = _exists(spark, path), _layout(spark, path) or "bucket"
    annotations, others, stay = annotations.withColumn("modified_at", now), [], None
    listed = slides.select("slide_name").distinct()
    if not exists and _exists(spark, f"{root}/annotations"):
        others = [df.join(listed, "slide_name", "left_anti") for k, df in _separate(spark, root).items()]
    if exists:
        # The saved slides tell the buckets, the rows that go and the rows that mark them.
        listed = durable(listed)
    if exists and layout == "bucket":
        touched = listed.agg(F.collect_set(_bucket())).first()[0]
        old = spark.read.schema(f"{STORED}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
        if is_small(listed) and not _scattered(spark, path, touched):
            stay = old.join(F.broadcast(listed), "slide_name", "left_anti")
        else:
            old = old.join(listed, "slide_name", "left_anti")
            others = [_records(old, ANNOTATION, ANNOTATIONS), _records(old, POINT, REGION_POINTS), old.where(F.col("record") == EMPTY).select("slide_name")]
    rows = _packed([annotations, points, listed, *others])
    rows = rows.withColumn("bucket", _bucket()) if layout == "bucket" else rows
    rows = _unpacked(rows.hint("rebalance", layout))
    if stay is not None:
        # They lie in files of their buckets already.
        rows = rows.unionByName(stay.select(*rows.columns))
    (
        rows.sortWithinPartitions(*dict.fromkeys([layout, "slide_name"]))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(layout)
        .parquet(path)
    )


def _scattered(spark: SparkSession, path: str, buckets: list[int]) -> bool:
    """Whether the buckets have so many small files that their rows should be dealt anew."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [place for place in (hadoop(f"{path}/bucket={b}") for b in buckets) if store.exists(place)]
    found = [store.getContentSummary(place) for place in folders]
    return sum(s.getFileCount() for s in found) > SMALL_FILES * len(found) + sum(s.getLength() for s in found) // FILE_BYTES


def _fields(df: DataFrame, schema: str) -> list[T.StructField]:
    return [f for f in df.sparkSession.createDataFrame([], schema).schema if f.name != "slide_name"]


def _packed(tables: list[DataFrame]) -> DataFrame:
    """Rows (slide_name, annotation, point) of annotations, of region points and of slides alone.

    A row goes into its bucket with the columns of its kind only, those that some table has.
    """
    have = {c for df in tables for c in df.columns}
    kinds = {k: [f for f in _fields(tables[0], schema) if f.name in have] for k, schema in ((ANNOTATION, ANNOTATIONS), (POINT, REGION_POINTS))}

    def packed(df: DataFrame) -> DataFrame:
        kind = ANNOTATION if "id" in df.columns else POINT if "annotation_id" in df.columns else EMPTY
        value = lambda f: (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        held = {k: F.struct(*[value(f) for f in fields]) for k, fields in kinds.items()}
        none = {k: F.lit(None).cast(T.StructType(fields)) for k, fields in kinds.items()}
        return df.select("slide_name", *[(held if k == kind else none)[k].alias(k) for k in kinds])

    rows = packed(tables[0])
    for df in tables[1:]:
        rows = rows.unionByName(packed(df))
    return rows


def _unpacked(rows: DataFrame) -> DataFrame:
    """The columns of the store from packed rows."""
    record = F.when(F.col(ANNOTATION).isNotNull(), ANNOTATION).when(F.col(POINT).isNotNull(), POINT).otherwise(EMPTY)
    given = {"record": record, "slide_name": F.col("slide_name")}
    for kind in (ANNOTATION, POINT):
        given |= {name: F.col(f"{kind}.{name}") for name in rows.schema[kind].dataType.names}
    flat = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.sparkSession.createDataFrame([], STORED).schema]
    return rows.select(*flat, *[c for c in rows.columns if c == "bucket"])
