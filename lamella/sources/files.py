"""Exported annotation files: listings, box text, region JSON, structured folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.functions import names as nm
from lamella.session import durable

REGION_JSON = "id string, channel string, points array<array<double>>, holes array<array<array<double>>>"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of all files below ``root``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", r"^file:/+", "/").alias("path"))


def _file_name() -> Column:
    """The name of the file of a row; Spark gives it with %20 for a blank and the like."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def _int(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int"))


def of_slides(df: DataFrame, slides: DataFrame, stem: str) -> DataFrame:
    """Join rows to every slide whose name and ``_`` start the file stem; adds ``rest``.

    A stem is cut at its underscores, which turns the prefix test into an equi-join and
    serves slide and channel names that hold underscores themselves. Only prefixes of as
    many parts as some slide name has are joined: a first part that all stems share is else
    one key with every row.
    """
    df = df.drop("slide_name")
    names = slides.select("slide_name").distinct()
    parts = names.agg(F.collect_set(F.size(F.split("slide_name", "_"))).alias("_parts")).scalar()
    every = df.withColumn("_k", F.explode(parts))
    fits = every.where(F.col("_k") <= F.greatest(F.size(F.split(stem, "_")) - 1, F.lit(1)))
    cut = fits.withColumn("_s", nm.cut_name(F.col(stem), F.col("_k")))
    return cut.join(names, cut["_s"]["prefix"] == names["slide_name"]).select(
        "slide_name", F.col("_s.rest").alias("rest"), *df.columns
    )


def parse_box_text(lines: DataFrame) -> DataFrame:
    """Rows (slide_name, biomarker, fov_x, fov_y, x, y) of box-text lines.

    ``lines`` holds slide_name, biomarker and value. Lines without a key or with fewer
    than two whole coordinates are skipped; boxes without four whole parts give no row,
    and a field of view without boxes one row of NULL x and y.
    """
    at = F.instr("value", ":")
    key = F.trim(F.substring(F.col("value"), F.lit(1), at - 1))
    tail = F.substr(key, F.length("slide_name") + 1)
    coords = F.split(F.trim(tail, F.lit("_")), "_")
    head = lines.where(at > 0).select(
        "slide_name",
        "biomarker",
        _int(F.get(coords, 0)).alias("fov_x"),
        _int(F.get(coords, 1)).alias("fov_y"),
        F.split(F.trim(F.substr("value", at + 1)), r"\s+").alias("_boxes"),
    )
    # Most boxes are four short numbers, which one look tells; the others are taken apart.
    whole = lambda b: F.transform(F.split(b, ","), _int)
    good = F.filter("_boxes", lambda b: b.rlike(r"^[+-]?\d{1,9}(,[+-]?\d{1,9}){3}\z") | (F.size(whole(b)) == 4) & ~F.exists(whole(b), lambda v: v.isNull()))
    rows = head.where(F.col("fov_x").isNotNull() & F.col("fov_y").isNotNull())
    text = rows.select("slide_name", "biomarker", "fov_x", "fov_y", F.explode_outer(good).alias("_text"))
    parts = F.split("_text", ",")
    box = text.withColumn("b", F.array(*[_int(F.get(parts, k)) for k in range(4)]))
    centre = lambda lo: (F.get("b", lo) + F.get("b", lo + 2)) / 2.0
    return box.select(
        "slide_name",
        "biomarker",
        "fov_x",
        "fov_y",
        (F.col("fov_x") + centre(0)).alias("x"),
        (F.col("fov_y") + centre(1)).alias("y"),
    )


def read_box_text(spark: SparkSession, path: str, slides: DataFrame) -> DataFrame:
    """Parse the text files ``slide_channel.txt`` of a folder for the given slides."""
    lines = spark.read.text(path).select("value", nm.stem(_file_name()).alias("stem"))
    return parse_box_text(of_slides(lines, slides, "stem").withColumnRenamed("rest", "biomarker"))


COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>, "
    "categories array<struct<id:bigint,name:string>>"
)


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """The annotations of COCO documents, each with its image and category by their ids.

    The file name gives slide_name when it ends with ``_coco.json``. Ids count within a
    document, in any order.
    """
    docs = spark.read.schema(COCO).json(path, multiLine=True)
    named = F.regexp_extract(_file_name(), r"^(.+)_coco\.json$", 1)
    docs = docs.select(_file_name().alias("document"), F.nullif(named, F.lit("")).alias("slide_name"), "*")
    keyed = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["id"], x)))
    flat = docs.select("document", "slide_name", keyed("images").alias("_i"), keyed("categories").alias("_c"), F.explode("annotations").alias("a"))
    image = F.element_at("_i", F.col("a.image_id"))
    return flat.select(
        "document",
        "slide_name",
        F.col("a.id").alias("id"),
        F.col("a.image_id").alias("image_id"),
        image["file_name"].alias("file_name"),
        image["width"].alias("width"),
        image["height"].alias("height"),
        F.col("a.category_id").alias("category_id"),
        F.element_at("_c", F.col("a.category_id"))["name"].alias("biomarker"),
        *[F.get("a.bbox", k).alias(f"bbox_{c}") for k, c in enumerate("xywh")],
        F.col("a.area").alias("area"),
        F.col("a.iscrowd").alias("iscrowd"),
    )


def regions_from_json(docs: DataFrame) -> DataFrame:
    """Regions with rings (outer first) of columns id, channel, points, holes."""
    ring = lambda r: F.transform(r, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    holes = F.coalesce("holes", F.array().cast("array<array<array<double>>>"))
    rest = [c for c in docs.columns if c not in ("id", "channel", "points", "holes")]
    return docs.where(F.col("points").isNotNull() & F.col("channel").isNotNull()).select(
        *rest,
        "id",
        F.col("channel").alias("biomarker"),
        F.concat(F.array(ring(F.col("points"))), F.transform(holes, ring)).alias("rings"),
    )


def read_regions_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Region files: JSON lines, or with ``multi_line`` one array document per file.

    The file name gives slide_name when it ends with ``_regions.json``.
    """
    docs = spark.read.schema(REGION_JSON + ", slide_name string").json(path, multiLine=multi_line)
    named = F.regexp_extract(_file_name(), r"^(.+)_regions\.json$", 1)
    docs = docs.select("*", F.nullif(named, F.lit("")).alias("_named"))
    docs = docs.withColumn("slide_name", F.coalesce("_named", "slide_name")).drop("_named")
    return regions_from_json(docs)


def region_image_fovs(files: DataFrame, slides: DataFrame) -> DataFrame:
    """Field-of-view corners (slide_name, fov_x, fov_y) of region image names."""
    rows = of_slides(files.withColumn("_stem", nm.stem(F.col("file_name"))), slides, "_stem")
    parts = F.split("rest", "_")
    at = rows.where(F.size(parts) >= 3).select(
        "slide_name",
        _int(F.element_at(parts, -2)).alias("fov_x"),
        _int(F.element_at(parts, -1)).alias("fov_y"),
    )
    return at.where(F.col("fov_x").isNotNull() & F.col("fov_y").isNotNull())


def load_structured(
    boxes: DataFrame,
    region_fovs: DataFrame,
    regions: DataFrame,
    fov_w: float = bx.FOV_SIZE,
    fov_h: float = bx.FOV_SIZE,
    now: Column | None = None,
) -> DataFrame:
    """All annotations of parsed files in one table that can be saved.

    Fields of view are unique per whole-number corner over marker text and region image
    names; they have the default size and no channel. Rows get ``now`` as their time, and
    regions keep the id of their document. Other ids are made from what a row says and,
    where several rows say the same, from their number among those.
    """
    # Fields of view and markers both read the parsed boxes.
    boxes = durable(boxes)
    corners = boxes.select("slide_name", "fov_x", "fov_y").unionByName(region_fovs).distinct()
    fovs = corners.select(
        F.lit("fov").alias("type"),
        "slide_name",
        F.lit("").alias("biomarker"),
        F.col("fov_x").cast("double").alias("x"),
        F.col("fov_y").cast("double").alias("y"),
        F.lit(float(fov_w)).alias("w"),
        F.lit(float(fov_h)).alias("h"),
    )
    size = F.lit(bx.MARKER_SIZE)
    same = ["slide_name", "biomarker", "x", "y"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy("fov_x", "fov_y"))
    markers = boxes.where(F.col("x").isNotNull()).withColumn("_copy", copy).select(
        F.lit("cell_marker").alias("type"), *same, size.alias("w"), size.alias("h"), "_copy"
    )
    shapes = regions.select(F.lit("region").alias("type"), "id", "slide_name", "biomarker", "rings")
    rows = fovs.unionByName(markers, allowMissingColumns=True).unionByName(shapes, allowMissingColumns=True)
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("type", *same, "_copy")]
    made = F.sha2(F.concat_ws("|", *said), 256)
    return rows.withColumns({"id": F.coalesce("id", made), "created_at": F.current_timestamp() if now is None else now}).drop("_copy")
