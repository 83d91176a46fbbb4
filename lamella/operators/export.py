"""Dataset export: box text, COCO tables, region documents, image-file plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import boxes as bx
from lamella.functions import names as nm
from lamella.session import durable, numbered
from lamella.sources.files import of_slides
from lamella.sources.ordered_files import write_ordered

FOV_GROUP = ["slide_name", "biomarker", "fov_id"]


def of_channels(df: DataFrame, channels: Sequence[str] | None) -> DataFrame:
    """The rows of the chosen channels; None stands for all."""
    return df if channels is None else df.where(F.col("biomarker").isin(list(channels)))


def _line_key() -> Column:
    return F.concat_ws("_", "slide_name", nm.whole(F.col("fov_x")), nm.whole(F.col("fov_y")))


def _box_text() -> Column:
    return F.concat_ws(",", *bx.export_box(*[F.col(c) for c in ("x", "y", "fov_x", "fov_y")]).values())


def box_text_lines(pairs: DataFrame) -> DataFrame:
    """Box-text lines of marker/field-of-view pairs: ``slide_x_y: x1,y1,x2,y2 ...``.

    One line per channel and field of view with markers, boxes in marker load order. A line
    is one value here; :func:`export_box_text` writes lines box by box.
    """
    item = F.struct("created_at", "marker_id", _box_text().alias("text"))
    grouped = pairs.groupBy(*FOV_GROUP, "fov_created_at", "fov_x", "fov_y").agg(F.sort_array(F.collect_list(item)).alias("_boxes"))
    text = F.array_join(F.transform("_boxes", lambda b: b["text"]), " ")
    return grouped.select("slide_name", "biomarker", "fov_id", "fov_created_at", F.concat(_line_key(), F.lit(": "), text).alias("line"))


def export_box_text(pairs: DataFrame, path: str, channels: Sequence[str] | None = None) -> DataFrame:
    """Write the files ``{slide}_{channel}.txt`` below ``path``; returns (file, bytes).

    A file has a line per field of view with markers of the channel, in load order, and a
    line its boxes, in load order. Keys, boxes and line ends are rows of their own, so a
    crowded field of view is no single value and a large file is written by many tasks.
    """
    rows = of_channels(pairs, channels).withColumn("file", F.format_string("%s_%s.txt", "slide_name", "biomarker"))
    lines = rows.select("file", "fov_created_at", "fov_id", "slide_name", "fov_x", "fov_y").distinct()
    order = ["fov_created_at", "fov_id", "_turn", "created_at", "marker_id"]

    def piece(df: DataFrame, turn: int, text: Column, *own: Column) -> DataFrame:
        own = own or [F.lit(None).cast(pairs.schema[c].dataType).alias(c) for c in order[3:]]
        return df.select("file", *order[:2], F.lit(turn).alias("_turn"), *own, text.alias("text"))

    boxes = piece(rows, 1, F.concat(F.lit(" "), _box_text()), *[F.col(c) for c in order[3:]])
    heads = piece(lines, 0, F.concat(_line_key(), F.lit(":")))
    return write_ordered(boxes.unionByName(heads).unionByName(piece(lines, 2, F.lit("\n"))), order, path)


def coco_categories(markers: DataFrame) -> DataFrame:
    """Category ids 1.. per slide by sorted marker channel."""
    names = markers.select("slide_name", F.col("biomarker").alias("name")).distinct()
    w = Window.partitionBy("slide_name").orderBy("name")
    return names.select("slide_name", F.row_number().over(w).cast("bigint").alias("id"), "name")


def coco_images(pairs: DataFrame) -> DataFrame:
    """Image ids 1.. per slide by channel and load order of the field of view."""
    images = pairs.select(*FOV_GROUP, "fov_created_at", "fov_x", "fov_y", "fov_w", "fov_h").distinct()
    order = [F.col(c).asc() for c in ("biomarker", "fov_created_at", "fov_id")]
    ids = numbered(images, order, ["slide_name"], "id")
    name = nm.fov_file_name(*[F.col(c) for c in ("slide_name", "biomarker", "fov_x", "fov_y")])
    return ids.select(
        "slide_name",
        "id",
        name.alias("file_name"),
        F.col("fov_w").cast("int").alias("width"),
        F.col("fov_h").cast("int").alias("height"),
        "biomarker",
        "fov_id",
    )


def coco_annotations(pairs: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotation ids 1.. per slide by image and marker load order, boxes of fixed size."""
    link = images.select(*FOV_GROUP, F.col("id").alias("image_id"))
    cats = categories.select("slide_name", F.col("name").alias("biomarker"), F.col("id").alias("category_id"))
    rows = pairs.join(link, FOV_GROUP).join(cats, ["slide_name", "biomarker"])
    edge = 2 * bx.EXPORT_HALF
    corner = lambda c: F.bround(F.col(c) - bx.EXPORT_HALF - F.col(f"fov_{c}"), 2)
    flat = rows.select("slide_name", "image_id", "category_id", "created_at", "marker_id", corner("x").alias("bbox_x"), corner("y").alias("bbox_y"))
    order = [F.col(c).asc() for c in ("image_id", "created_at", "marker_id")]
    return numbered(flat, order, ["slide_name"], "id").select(
        "slide_name",
        "id",
        "image_id",
        "category_id",
        "bbox_x",
        "bbox_y",
        F.lit(edge).alias("bbox_w"),
        F.lit(edge).alias("bbox_h"),
        F.lit(edge * edge).alias("area"),
        F.lit(0).alias("iscrowd"),
    )


def export_coco(pairs: DataFrame, markers: DataFrame, path: str, channels: Sequence[str] | None = None) -> DataFrame:
    """Write one COCO document ``{slide}_coco.json`` per slide below ``path``; returns (file, bytes).

    ``channels`` chooses the channels, and category ids count the chosen ones of a slide.
    Slides without annotations have no document. Every object is a row, so a document is
    written by as many tasks as it needs.
    """
    pairs = durable(of_channels(pairs, channels))
    images = durable(coco_images(pairs))
    slides = images.select("slide_name").distinct()
    categories = durable(coco_categories(of_channels(markers, channels)).join(slides, "slide_name", "left_semi"))
    bbox = F.array(*[F.col(f"bbox_{c}").cast("double") for c in ("x", "y", "w", "h")]).alias("bbox")
    annotations = coco_annotations(pairs, images, categories)
    lists = [
        ("images", images, F.struct("id", "file_name", "width", "height")),
        ("annotations", annotations, F.struct("id", "image_id", "category_id", bbox, "area", "iscrowd")),
        ("categories", categories, F.struct("id", "name")),
    ]
    file = F.concat("slide_name", F.lit("_coco.json")).alias("file")

    def piece(df: DataFrame, turn: int, id_: Column, text: Column) -> DataFrame:
        return df.select(file, F.lit(turn).alias("_turn"), id_.cast("bigint").alias("_id"), text.alias("text"))

    # The ids of a list count from 1, which tells its first object.
    rows = piece(slides, 2 * len(lists), F.lit(0), F.lit("\n]}\n"))
    for k, (name, df, fields) in enumerate(lists):
        opening = f'{{"{name}": [' if k == 0 else f'\n],\n"{name}": ['
        rows = rows.unionByName(piece(slides, 2 * k, F.lit(0), F.lit(opening)))
        comma = F.when(F.col("id") > 1, ",\n").otherwise("\n")
        rows = rows.unionByName(piece(df, 2 * k + 1, F.col("id"), F.concat(comma, F.to_json(fields))))
    return write_ordered(rows, ["_turn", "_id"], path)


def regions_json(regions: DataFrame) -> DataFrame:
    """One JSON object {id, channel, points, holes} per region with its ``rings``."""
    pairs = lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    rings = F.transform("rings", pairs)
    body = F.struct(
        "id",
        F.col("biomarker").alias("channel"),
        F.coalesce(F.get(rings, 0), F.array().cast("array<array<double>>")).alias("points"),
        F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes"),
    )
    return regions.select("slide_name", "id", F.to_json(body).alias("js"))


def export_regions_json(regions: DataFrame, path: str) -> None:
    """Write region objects as JSON lines to ``{slide}_regions.json`` below ``path``, which is replaced.

    Regions without a slide, and of slides whose name would hide a file or name a folder, go
    to one more file; their objects hold slide_name themselves.
    """
    context = regions.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    odd = F.col("slide_name").isNull() | F.col("slide_name").rlike("^[_.]|/") | (F.col("slide_name") == "")
    named = F.concat(F.substring("js", F.lit(1), F.length("js") - 1), F.lit(","), F.substr(F.to_json(F.struct("slide_name")), F.lit(2)))
    file = F.when(odd, "regions.json").otherwise(F.concat("slide_name", F.lit("_regions.json")))
    text = F.when(odd & F.col("slide_name").isNotNull(), named).otherwise(F.col("js"))
    docs = regions_json(regions).select(file.alias("file"), "slide_name", "id", F.concat(text, F.lit("\n")).alias("text"))
    # Their order is found on a sample first: objects are made once for both.
    write_ordered(durable(docs), ["slide_name", "id"], path)


def expected_names(fovs: DataFrame, channel: str = "biomarker") -> DataFrame:
    name = nm.fov_file_name(*[F.col(c) for c in ("slide_name", channel, "x", "y")])
    return fovs.select("slide_name", name.alias("file_name")).distinct()


def files_of_slides(files: DataFrame, slides: DataFrame) -> DataFrame:
    """(slide_name, file_name) for each listed slide whose name and ``_`` start the file name."""
    return of_slides(files.select("file_name"), slides, "file_name").select("slide_name", "file_name")


def fov_sync_plan(fovs: DataFrame, files: DataFrame, channels: DataFrame | None = None) -> DataFrame:
    """What to do per image file: write, keep or delete.

    ``files`` holds slide_name and file_name. With ``channels`` (slide_name, name) a
    field of view of an unknown channel whose image is missing is skipped.
    """
    name = nm.fov_file_name(*[F.col(c) for c in ("slide_name", "biomarker", "x", "y")])
    want = fovs.select("slide_name", name.alias("file_name"), F.col("biomarker").alias("name"), F.lit(True).alias("known"))
    if channels is not None:
        have = channels.select("slide_name", "name").distinct().withColumn("_has", F.lit(True))
        want = want.drop("known").join(have, ["slide_name", "name"], "left").withColumn("known", F.coalesce("_has", F.lit(False)))
    want = want.groupBy("slide_name", "file_name").agg(F.max("known").alias("known"))
    got = files.select("slide_name", "file_name", F.lit(True).alias("_on_disk")).distinct()
    action = (
        F.when(F.col("known").isNull(), "delete")
        .when(F.col("_on_disk"), "keep")
        .when(F.col("known"), "write")
        .otherwise("skip")
    )
    return want.join(got, ["slide_name", "file_name"], "full_outer").select("slide_name", "file_name", action.alias("action"))


def missing_fov_images(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Slides with at least one expected image file absent."""
    return expected.join(files, ["slide_name", "file_name"], "left_anti").select("slide_name").distinct()


def expected_marker_images(pairs: DataFrame) -> DataFrame:
    """Image names of every channel with a marker in a field of view."""
    cols = [F.col(c) for c in ("slide_name", "biomarker", "fov_x", "fov_y")]
    return pairs.select("slide_name", nm.fov_file_name(*cols).alias("file_name")).distinct()


def expected_region_images(fovs: DataFrame, regions: DataFrame) -> DataFrame:
    """Image names of fields of view whose channel has a region on the slide."""
    has = regions.select("slide_name", "biomarker").distinct()
    return expected_names(fovs.join(has, ["slide_name", "biomarker"], "left_semi"))

