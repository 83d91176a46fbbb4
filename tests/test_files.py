"""Files written by the sinks read back, and saving replaces only the saved slides."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lamella.operators import export as ex
from lamella.operators import regions as rn
from lamella.operators import spatial as sp
from lamella.operators.catalog import slide_catalog
from lamella.plans.region_queries import region_table
from lamella.sources import files as fl
from lamella.sources.ordered_files import write_ordered
from lamella.sources import sqlview
from lamella.sources import tables as tb
from lamella.sources.derived import Tables


@pytest.fixture(scope="module")
def t(spark):
    from lamella.session import tune

    return Tables(tune(spark), "/root/testdata/sf0.001")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_box_text(spark, t, tmp_path):
    pairs = sp.markers_in_fovs(t.markers, t.fovs)
    written = ex.export_box_text(pairs, str(tmp_path / "boxes"))
    back = fl.read_box_text(spark, str(tmp_path / "boxes"), t.slides)
    lines = ex.box_text_lines(pairs)
    stems = lines.select(F.col("line").alias("value"), F.concat_ws("_", "slide_name", "biomarker").alias("stem"))
    want = fl.parse_box_text(fl.of_slides(stems, t.slides, "stem").withColumnRenamed("rest", "biomarker"))
    cols = ["slide_name", "biomarker", "fov_x", "fov_y", "x", "y"]
    assert rows(back, *cols) == rows(want, *cols)
    # The files are, byte for byte, their lines in load order.
    texts = {}
    for r in sorted(lines.collect(), key=lambda r: (r.fov_created_at, r.fov_id)):
        name = f"{r.slide_name}_{r.biomarker}.txt"
        texts[name] = texts.get(name, "") + r.line + "\n"
    assert {p.name: p.read_text() for p in (tmp_path / "boxes").iterdir()} == texts
    assert {r.file: r.bytes for r in written.collect()} == {k: len(v.encode()) for k, v in texts.items()}


def test_ordered_files_in_parts(spark, tmp_path):
    """A large file is made of many parts, keeps its order, and replaces an older one."""
    n = 20_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "small é.txt").otherwise("large.txt").alias("file"),
        (-F.col("id")).alias("k"),
        F.concat(F.col("id").cast("string"), F.lit("ß ")).alias("text"),
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):
            write_ordered(df, ["k"], str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["large.txt", "small é.txt"]
    assert (tmp_path / "large.txt").read_text() == "".join(f"{k}ß " for k in reversed(range(n)) if k % 3)
    assert (tmp_path / "small é.txt").read_text() == "".join(f"{k}ß " for k in reversed(range(n)) if k % 3 == 0)
    assert write_ordered(df.where("false"), ["k"], str(tmp_path / "none")).collect() == []


def test_small_files_are_written_once(spark, tmp_path):
    """Only files at the ends of a task go through parts; all others are not copied."""
    from lamella.session import _STORED

    n = 3000
    df = spark.range(n).select(F.format_string("f%04d", F.col("id") % 300).alias("file"), "id", F.format_string("%d ", "id").alias("text"))
    written = write_ordered(df, ["id"], str(tmp_path))
    want = {f"f{k:04d}": "".join(f"{i} " for i in range(k, n, 300)) for k in range(300)}
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == want
    assert {r.file: r.bytes for r in written.collect()} == {k: len(v) for k, v in want.items()}
    parts = spark.read.parquet(_STORED[spark.sparkContext.applicationId][-2])
    tasks = parts.select("part").distinct().count()
    assert parts.where("path IS NOT NULL").count() <= 2 * tasks < 300


def test_box_text_files_of_other_tools(spark, tmp_path):
    (tmp_path / "my_slide_CD_8.txt").write_text(
        "my_slide_10_-20: 0,0,20,20 5,5,25,26\nmy_slide_10_-20: 1,2,3\n\nno key\nmy_slide_x_1: 0,0,1,1\nmy_slide_7_8:\n"
    )
    slides = spark.createDataFrame([("my_slide",), ("other",)], "slide_name string")
    out = rows(fl.read_box_text(spark, str(tmp_path), slides), "slide_name", "biomarker", "fov_x", "fov_y", "x", "y")
    assert out == sorted(
        [
            ("my_slide", "CD_8", 10, -20, 20.0, -10.0),
            ("my_slide", "CD_8", 10, -20, 25.0, -4.5),
            ("my_slide", "CD_8", 10, -20, None, None),
            ("my_slide", "CD_8", 7, 8, None, None),
        ],
        key=repr,
    )


def test_coco(spark, t, tmp_path):
    pairs = sp.markers_in_fovs(t.markers, t.fovs)
    ex.export_coco(pairs, t.markers, str(tmp_path))
    docs = {p.name.removesuffix("_coco.json"): json.loads(p.read_text()) for p in tmp_path.iterdir()}
    assert set(docs) == {r.slide_name for r in pairs.select("slide_name").distinct().collect()}
    assert sum(len(d["annotations"]) for d in docs.values()) == pairs.count()
    channels = {}
    for r in t.markers.select("slide_name", "biomarker").distinct().collect():
        channels.setdefault(r.slide_name, []).append(r.biomarker)
    for slide, d in docs.items():
        assert list(d) == ["images", "annotations", "categories"]
        assert [c["name"] for c in d["categories"]] == sorted(channels[slide])
        for part in d.values():
            assert [x["id"] for x in part] == list(range(1, len(part) + 1))
        images = [a["image_id"] for a in d["annotations"]]
        assert images == sorted(images) and set(images) == {x["id"] for x in d["images"]}
        assert all(len(a["bbox"]) == 4 and a["bbox"][2:] == [20, 20] and a["area"] == 400 and a["iscrowd"] == 0 for a in d["annotations"])
    back = fl.read_coco(spark, str(tmp_path))
    assert back.count() == pairs.count() and back.where("file_name IS NULL OR biomarker IS NULL").count() == 0


def test_regions_json(spark, t, tmp_path):
    regions = region_table(t)
    ex.export_regions_json(regions, str(tmp_path / "regions"))
    back = fl.read_regions_json(spark, str(tmp_path / "regions"))
    assert rows(back, "slide_name", "id", "biomarker", "rings") == rows(regions, "slide_name", "id", "biomarker", "rings")


def test_region_documents_are_few_files(spark, t, tmp_path):
    """One file a slide, whatever its name, and no folder; an older export is replaced."""
    names = {"a": "slide 1", "g": "50%+é", "b": "_hidden", "c": "x/y", "d": None, "e": ".dot", "f": "slide 1"}
    regions = spark.createDataFrame(
        [(k, v, "CD8", [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.5)]]) for k, v in names.items()],
        "id string, slide_name string, biomarker string, rings array<array<struct<x:double,y:double>>>",
    )
    ex.export_regions_json(region_table(t), str(tmp_path / "regions"))
    ex.export_regions_json(regions, str(tmp_path / "regions"))
    assert sorted(p.name for p in (tmp_path / "regions").iterdir()) == ["50%+é_regions.json", "regions.json", "slide 1_regions.json"]
    back = fl.read_regions_json(spark, str(tmp_path / "regions"))
    assert rows(back, "slide_name", "id", "biomarker", "rings") == rows(regions, "slide_name", "id", "biomarker", "rings")


def test_region_document_of_other_tools(spark, tmp_path):
    doc = [{"id": "a", "channel": "CD8", "points": [[0, 0], [4, 0], [4, 4]]}, {"id": "b", "channel": "X", "points": [[0, 0]], "holes": [[[1, 1]]]}, {"id": "bad"}]
    (tmp_path / "my_slide_regions.json").write_text(json.dumps(doc, indent=2))
    out = {r.id: r for r in fl.read_regions_json(spark, str(tmp_path), multi_line=True).collect()}
    assert set(out) == {"a", "b"} and out["a"].slide_name == "my_slide"
    assert len(out["a"].rings) == 1 and len(out["b"].rings) == 2


def test_rings_round_trip(t):
    regions = rn.assemble_regions(t.region_points)
    cols = ["annotation_id", "seq", "px", "py", "ring"]
    assert rows(rn.explode_region_points(regions), *cols) == rows(t.region_points, *cols)


def test_missing_outer_ring(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0, 1)], "annotation_id string, seq int, px double, py double, ring int")
    r = rn.assemble_regions(df).first().rings
    assert r[0] == [] and len(r[1]) == 1


def save(t, root, annotations, slides, now):
    points = t.region_points.join(t.regions.select(F.col("id").alias("annotation_id"), "slide_name"), "annotation_id")
    points = points.join(slides, "slide_name", "left_semi")
    tb.save_annotations(annotations, points, slides, root, F.lit(now).cast("timestamp"))


def test_save_replaces_slides(spark, t, tmp_path):
    root = str(tmp_path / "db")
    everything = t.annotations.select("slide_name").distinct()
    save(t, root, t.annotations, everything, "2024-01-01")
    t.slides.write.parquet(f"{root}/slide_paths")
    first = rows(tb.read_annotations(spark, root)["annotations"], "id", "slide_name", "type")
    assert first == rows(t.annotations, "id", "slide_name", "type")
    stored = tb.read_annotations(spark, root)["annotations"]
    one = stored.where("slide_name = 'slide_1' AND type = 'cell_marker'").withColumn("x", F.col("x") + 1)
    two = spark.createDataFrame([("slide_1",), ("slide_2",)], "slide_name string")
    save(t, root, one, two, "2024-02-02")
    after = tb.read_annotations(spark, root)["annotations"]
    assert after.where("slide_name = 'slide_2'").count() == 0
    assert rows(after.where("slide_name = 'slide_1'"), "id") == rows(t.annotations.where("slide_name = 'slide_1' AND type = 'cell_marker'"), "id")
    assert after.where("slide_name = 'slide_1' AND modified_at < '2024-02-02'").count() == 0
    others = "slide_name NOT IN ('slide_1', 'slide_2')"
    assert rows(after.where(others), "id") == rows(t.annotations.where(others), "id")
    assert after.where(others + " AND modified_at <> '2024-01-01'").count() == 0
    sqlview.register_views(spark, root, ("annotations", "region_points", "slide_paths"))
    n = sqlview.query(spark, "SELECT count(*) AS n FROM annotations -- all of them").first().n
    assert n == after.count()
    for bad in ("DROP VIEW annotations", "INSERT INTO annotations SELECT * FROM annotations", "SELECT 1); DROP VIEW annotations --", "SET x=1"):
        with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
            sqlview.query(spark, bad)
    n = sqlview.query(spark, "WITH a AS (SELECT * FROM annotations) SELECT count(*) AS n FROM a WHERE id IN (SELECT id FROM annotations)").first().n
    assert n == after.count()
    for bad in (
        "SELECT java_method('java.lang.Math', 'max', 3, 4)",
        "SELECT reflect('java.lang.Math', 'max', 3, 4)",
        "SELECT * FROM text.`/etc/hosts`",
        "SELECT id FROM annotations WHERE id IN (SELECT value FROM text.`/etc/hosts`)",
        "SELECT * FROM some_other_table",
        # Names that are put together, shadowed views, table functions, nested reads.
        "SELECT IDENTIFIER('java_method')('java.lang.Math', 'max', 3, 4)",
        "SELECT * FROM IDENTIFIER('text.`/etc/hosts`')",
        "SELECT * FROM IDENTIFIER(java_method('java.lang.System', 'getProperty', 'user.dir'))",
        "WITH a AS (WITH b AS (SELECT * FROM IDENTIFIER('text.`/etc/hosts`')) SELECT * FROM b) SELECT * FROM a",
        "WITH annotations AS (SELECT * FROM text.`/etc/hosts`) SELECT * FROM annotations",
        "SELECT (SELECT max(value) FROM text.`/etc/hosts`) AS x",
        "SELECT * FROM range(3)",
        "SELECT try_reflect('java.lang.Math', 'max', 3, 4)",
    ):
        with pytest.raises(PermissionError):
            sqlview.query(spark, bad)
    spark.range(3).createOrReplaceTempView("someone_elses")
    with pytest.raises(PermissionError):
        sqlview.query(spark, "SELECT * FROM someone_elses")
    for good in ("SELECT explode(array(1, 2)) AS x", "SELECT * FROM VALUES (1), (2)", "SELECT b.x FROM annotations a JOIN LATERAL (SELECT a.x) b"):
        assert sqlview.query(spark, good).count() > 0


def test_one_write_for_both_tables(spark, t, tmp_path):
    """Annotations and points are one table; folders of their own are taken over by the first save."""
    root = str(tmp_path / "db")
    points = t.region_points.join(t.regions.select(F.col("id").alias("annotation_id"), "slide_name"), "annotation_id")
    t.annotations.write.partitionBy("slide_name").parquet(f"{root}/annotations")
    points.drop("ring").write.partitionBy("slide_name").parquet(f"{root}/region_points")
    old = tb.read_annotations(spark, root)
    assert old["annotations"].count() == t.annotations.count() and old["slide_paths"].count() == 0
    assert old["region_points"].where("ring = 0").count() == points.count()
    slide = points.select("slide_name").orderBy("slide_name").limit(1)
    gone = t.annotations.limit(0)
    tb.save_annotations(gone, points.limit(0), slide, root, F.lit("2024-01-01").cast("timestamp"))
    after = tb.read_annotations(spark, root)
    assert sorted(p.name for p in (tmp_path / "db").iterdir()) == ["annotation_store", "annotations", "region_points"]
    rest = lambda df: rows(df.join(slide, "slide_name", "left_anti"), df.columns[0])
    assert rows(after["annotations"], "id") == rest(t.annotations.select("id", "slide_name"))
    assert rows(after["region_points"], "annotation_id") == rest(points)


def test_listing(spark, tmp_path):
    for name in ("test/a.czi", "Train/deep/b.ome.tif", "c.ims", "d_mask.ims", "e.txt", "x/a.czi"):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text("x")
    out = slide_catalog(fl.list_files(spark, str(tmp_path)), str(tmp_path))
    assert {r.slide_name: (r.slide_path.removeprefix(str(tmp_path)), r.slide_group) for r in out.collect()} == {
        "a": ("/x/a.czi", "train"),
        "b.ome": ("/Train/deep/b.ome.tif", "train"),
        "c": ("/c.ims", "train"),
    }


def test_files_of_slides(spark):
    files = spark.createDataFrame([("a_b_CD8_1_2.png",), ("a_CD8_1_2.png",), ("plain.png",)], "file_name string")
    slides = spark.createDataFrame([("a",), ("a_b",)], "slide_name string")
    assert rows(ex.files_of_slides(files, slides), "slide_name", "file_name") == [
        ("a", "a_CD8_1_2.png"), ("a", "a_b_CD8_1_2.png"), ("a_b", "a_b_CD8_1_2.png")
    ]


def test_many_slides_few_folders(spark, tmp_path):
    """The store has a bounded number of folders; a save keeps the other slides of its bucket."""
    root, n = str(tmp_path / "db"), 2000
    slides = spark.range(n).select(F.format_string("s%d", "id").alias("slide_name"))
    made = slides.select(F.concat(F.lit("a_"), "slide_name").alias("id"), F.lit("cell_marker").alias("type"), F.lit("CD8").alias("biomarker"), "slide_name")
    points = spark.createDataFrame([], tb.REGION_POINTS)
    tb.save_annotations(made, points, slides, root, F.lit("2024-01-01").cast("timestamp"))
    folders = [p.name for p in (tmp_path / "db" / tb.STORE).iterdir() if "=" in p.name]
    assert len(folders) <= tb.BUCKETS < n
    some = slides.where("slide_name LIKE '%7'")
    tb.save_annotations(made.where("slide_name = 's17'"), points, some, root, F.lit("2024-02-02").cast("timestamp"))
    back = rows(tb.read_annotations(spark, root)["annotations"], "slide_name", F.month("modified_at"))
    want = [(f"s{k}", 1) for k in range(n) if k % 10 != 7] + [("s17", 2)]
    assert back == sorted(want, key=repr)
    # A store with a folder per slide is read and saved in that form.
    old = str(tmp_path / "old")
    shape = tb.read_annotations(spark, root)["annotations"].where("slide_name IN ('s1', 's2')")
    shape.withColumn("record", F.lit(tb.ANNOTATION)).write.partitionBy("slide_name").parquet(f"{old}/{tb.STORE}")
    tb.save_annotations(made.limit(0), points, slides.where("slide_name = 's2'"), old, F.lit("2024-02-02").cast("timestamp"))
    assert rows(tb.read_annotations(spark, old)["annotations"], "slide_name") == [("s1",)]
