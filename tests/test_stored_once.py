"""What several steps of a query read is made once."""

import pytest

from lamella.operators import export as ex
from lamella.operators import regions as rn
from lamella.plans import load_all
from lamella.plans.registry import QUERIES

load_all()


@pytest.mark.parametrize(
    "query, module, step",
    [("export_coco", ex, "coco_images"), ("coco_ids", ex, "coco_images"), ("coco_files", ex, "coco_images"), ("connected_components", rn, "component_edges")],
)
def test_made_once(spark, monkeypatch, query, module, step):
    seen, real = [], getattr(module, step)
    monkeypatch.setattr(module, step, lambda rows: seen.append(rows.inputFiles()) or real(rows))
    QUERIES[query](spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and all("durable-" in f for f in seen[0])


def test_overlaps_read_stored_boxes(spark, monkeypatch):
    """The grids in use and the join read boxes that were stored, not the joins that placed them."""
    from lamella.operators import spatial as sp

    seen, real = [], sp.overlap_pairs
    monkeypatch.setattr(sp, "overlap_pairs", lambda left, right, *rest: seen.extend([left.inputFiles(), right.inputFiles()]) or real(left, right, *rest))
    QUERIES["iou_join"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all("durable-" in f for files in seen for f in files)


def test_parsed_boxes_are_stored(spark):
    """Fields of view and markers of an import read the parsed boxes, not the lines, and prefixes that no slide can have are not joined."""
    from lamella.sources import files as fl

    slides = spark.createDataFrame([("a",), ("a_b",), ("a_b_c_d",)], "slide_name string")
    lines = [("a_b_CD8", "a_b_5_7: 1,2,3,4 1,2,3 +01,-2,0000000000003,4 1,2,3,99999999999 x,1,2,3"), ("a_b_c_d_FOXP3", "a_b_c_d_1_2: "), ("c_CD8", "c_1_1: 1,1,1,1")]
    stems = spark.createDataFrame(lines, "stem string, value string")
    found = fl.of_slides(stems, slides, "stem").withColumnRenamed("rest", "biomarker")
    boxes = fl.parse_box_text(found)
    assert sorted(map(tuple, found.select("slide_name", "biomarker").collect())) == [("a", "b_CD8"), ("a", "b_c_d_FOXP3"), ("a_b", "CD8"), ("a_b", "c_d_FOXP3"), ("a_b_c_d", "FOXP3")]
    mine = boxes.where("biomarker IN ('CD8', 'FOXP3')").select("slide_name", "fov_x", "fov_y", "x", "y")
    assert sorted(mine.collect(), key=str) == [("a_b", 5, 7, 7.0, 10.0), ("a_b", 5, 7, 7.0, 8.0), ("a_b_c_d", 1, 2, None, None)]
    corners = spark.createDataFrame([], "slide_name string, fov_x int, fov_y int")
    regions = spark.createDataFrame([], "id string, slide_name string, biomarker string, rings array<array<struct<x:double,y:double>>>")
    rows = fl.load_structured(boxes, corners, regions)
    assert any("durable-" in f for f in rows.inputFiles())


def test_new_store_is_written_once(spark, monkeypatch, tmp_path):
    """Rows are stored on their way only where the store that is overwritten may be read for them."""
    from pyspark.sql import functions as F

    from lamella.sources import tables as tb

    kept, real = [], tb.durable
    monkeypatch.setattr(tb, "durable", lambda df: kept.append(1) or real(df))
    rows = spark.createDataFrame([("m", "cell_marker", "s")], "id string, type string, slide_name string")
    points = spark.createDataFrame([], "annotation_id string, seq int, px double, py double, ring int, slide_name string")
    for saves in (0, 1):
        tb.save_annotations(rows, points, rows.select("slide_name"), str(tmp_path / "root"), F.current_timestamp())
        assert len(kept) == saves
        assert tb.read_annotations(spark, str(tmp_path / "root"))["annotations"].select("id").collect() == [("m",)]


def test_region_documents_are_read_once(spark):
    """The documents of the merged regions are parsed for both of their uses at once."""
    files = QUERIES["saved_merged_regions"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not [f for f in files if f.endswith(".json")]


def test_edges_of_cells_are_shuffled_once(spark):
    """Crowded cells are named by the pass that links the rings of the others."""
    from pyspark.sql import functions as F

    from lamella.operators import meeting as mt

    corners = [(0, 0), (9, 0), (9, 9), (0, 9)]
    ring = F.array(*[F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    regions = spark.range(40).select(F.format_string("r%02d", "id").alias("id"), F.lit("s").alias("slide_name"), F.array(ring).alias("rings"))
    cells = mt.edge_cells(mt.region_edges(regions, ["slide_name"]))
    crowded = cells.groupBy("_cx", "_cy").count()
    for most in (10, 1000):
        found = mt._cell_links(cells, ["slide_name"], most)
        named = {(r._cx, r._cy) for r in found.where("a IS NULL").collect()}
        assert named == {(r._cx, r._cy) for r in crowded.where(F.col("count") > most).collect()}
        assert (found.where("a IS NOT NULL").count() > 0) == (most == 1000)


def test_rows_of_a_crowd_are_not_kept():
    """Of a group that is known to be too large no more rows are held."""
    import pyarrow as pa

    from lamella.operators import fills

    batches = [pa.RecordBatch.from_pydict({"k": [0, 1] if n == 0 else [1] * fills.EDGES + [2] * (n == 5)}) for n in range(6)]
    found = [(table.column(0).to_pylist()[s], table.num_rows) for table, starts in fills.whole_groups(iter(batches), 1, 3) for s in starts]
    assert [k for k, _ in found] == [0, 1, 2] and max(n for _, n in found) < 3 * fills.EDGES


def test_saving_again(spark, monkeypatch, tmp_path):
    """Rows that stay are not stored or shuffled on their way, saved ones may come from the store, and files do not pile up."""
    from pyspark.sql import functions as F

    from lamella.sources import tables as tb

    kept, real = [], tb.durable
    monkeypatch.setattr(tb, "durable", lambda df: kept.append(df.columns) or real(df))
    monkeypatch.setattr(tb, "BUCKETS", 2)
    root = str(tmp_path / "root")
    slides = spark.range(40).select(F.format_string("s%d", "id").alias("slide_name"))
    rows = slides.select(F.concat(F.lit("r"), "slide_name").alias("id"), F.lit("region").alias("type"), F.lit(1.0).alias("x"), "slide_name")
    points = rows.select(F.col("id").alias("annotation_id"), F.lit(0).alias("seq"), F.lit(2.0).alias("px"), F.lit(3.0).alias("py"), F.lit(0).alias("ring"), "slide_name")
    now = F.lit("2024-01-01").cast("timestamp")
    tb.save_annotations(rows, points, slides, root, now)
    one = slides.where("slide_name = 's7'")
    for _ in range(12):
        back = tb.read_annotations(spark, root)
        mine = back["annotations"].where("slide_name = 's7'").withColumn("x", F.col("x") + 1)
        tb.save_annotations(mine, back["region_points"].where("slide_name = 's7'"), one, root, now)
    assert kept == [["slide_name"]] * 12
    back = tb.read_annotations(spark, root)
    assert sorted((r.slide_name, r.x) for r in back["annotations"].collect()) == sorted((f"s{k}", 13.0 if k == 7 else 1.0) for k in range(40))
    assert sorted(r.annotation_id for r in back["region_points"].collect()) == sorted(f"rs{k}" for k in range(40))
    assert max(len(list(b.glob("*.parquet"))) for b in (tmp_path / "root" / tb.STORE).glob("bucket=*")) <= tb.SMALL_FILES + 2
    # Where the saved slides are too many to be sent around, all rows of their buckets are dealt anew.
    monkeypatch.setattr(tb, "is_small", lambda df: False)
    tb.save_annotations(rows.limit(0), points.limit(0), one, root, now)
    assert tb.read_annotations(spark, root)["annotations"].count() == tb.read_annotations(spark, root)["region_points"].count() == 39
