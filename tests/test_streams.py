"""Streams end in the state that the table forms compute."""

import pytest
from pyspark.sql import functions as F

from lamella.sources.derived import Tables
from lamella.streaming import edits, live

SAVE = "slide_name string, save_seq bigint, cell_marker bigint, region bigint, fov bigint"
LOG = "slide_name string, seq bigint, op string, ann_id string, x double, y double, batch string"


def edit(seq, op, ann=None, x=None, batch=None, slide="s"):
    return (slide, seq, op, ann, None if x is None else float(x), None if x is None else float(x), batch)


def state(df):
    return sorted(((r.slide_name, r.ann_id, r.x, r.can_undo, r.can_redo) for r in df.collect()), key=repr)


CASES = {
    "undo on an empty history": ([edit(1, "undo"), edit(2, "redo")], [("s", None, None, False, False)]),
    "undo and redo": ([edit(1, "add", "a", 1), edit(2, "undo"), edit(3, "redo")], [("s", "a", 1.0, True, False)]),
    "a new edit forgets redo": (
        [edit(1, "add", "a", 1), edit(2, "undo"), edit(3, "add", "b", 2), edit(4, "redo")],
        [("s", "b", 2.0, True, False)],
    ),
    "a move without effect makes no step": (
        [edit(1, "add", "a", 1), edit(2, "move", "a", 1), edit(3, "undo")],
        [("s", None, None, False, True)],
    ),
    "unknown ids": ([edit(1, "delete", "q"), edit(2, "move", "q", 3)], [("s", None, None, False, False)]),
    "batch is one step": (
        [edit(1, "add", "a", 1, "b1"), edit(2, "add", "b", 2, "b1"), edit(3, "move", "a", 5), edit(4, "undo"), edit(5, "undo")],
        [("s", None, None, False, True)],
    ),
    "merge and undo": (
        [edit(1, "add", "a", 1), edit(2, "add", "b", 2), edit(3, "delete", "a", batch="m"), edit(4, "delete", "b", batch="m"), edit(5, "add", "c", 3, "m"), edit(6, "undo")],
        [("s", "a", 1.0, True, True), ("s", "b", 2.0, True, True)],
    ),
    "clear": ([edit(1, "add", "a", 1), edit(2, "clear"), edit(3, "undo")], [("s", None, None, False, False)]),
    "move and undo": ([edit(1, "add", "a", 1), edit(2, "move", "a", 9), edit(3, "undo")], [("s", "a", 1.0, True, True)]),
}


@pytest.mark.parametrize("name", CASES)
def test_replay(spark, name):
    log, want = CASES[name]
    assert state(edits.replay_edits(spark.createDataFrame(log, LOG))) == want


def test_replay_stream_is_replay_table(spark, tmp_path):
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    log = Tables(spark, "/root/testdata/sf0.001").edit_log.withColumn(
        "batch", F.when(F.col("seq") % 5 < 2, F.floor(F.col("seq") / 5).cast("string"))
    )
    log = log.where("slide_name < 'slide_3'").select("slide_name", "seq", "op", "ann_id", "x", "y", "batch").cache()
    log.createOrReplaceTempView("edit_rows")
    top = log.agg(F.max("seq")).first()[0]
    for k in range(3):
        part = log.where((F.col("seq") > k * top / 3 - (k == 0)) & (F.col("seq") <= (k + 1) * top / 3))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    out = str(tmp_path / "out")

    def keep(batch, number):
        batch.withColumn("n", F.lit(number)).write.mode("append").parquet(out)

    query = (
        edits.replay_edits_stream(stream)
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(out)
    last = rows.groupBy("slide_name").agg(F.max("n").alias("n"))
    assert rows.select("n").distinct().count() == 3
    assert state(rows.join(last, ["slide_name", "n"])) == state(edits.replay_edits(log))


def test_live_counts(spark, tmp_path):
    saves = [("a", 2, 5, 1, 1), ("a", 1, 9, 9, 9), ("b", 1, 1, 0, 0), ("a", 2, 5, 1, 1), ("b", 3, 0, 0, 0), ("b", 2, 7, 7, 7)]
    df = spark.createDataFrame(saves, SAVE)
    want = sorted(map(tuple, live.live_counts(df).collect()))
    assert want == [("a", 2, 5, 1, 1), ("b", 3, 0, 0, 0)]
    table = str(tmp_path / "table")
    assert live.read_counts(spark, table).collect() == []
    for start in (0, 2, 4, 4):  # The last batch comes twice.
        live.upsert_counts(spark.createDataFrame(saves[start : start + 2], SAVE), table, buckets=4)
    got = live.read_counts(spark, table).select("slide_name", "save_seq", "cell_marker", "region", "fov")
    assert sorted(map(tuple, got.collect())) == want


def test_live_counts_read_touched_buckets_only(spark, tmp_path):
    """A batch reads and writes the buckets of its slides; old folders go once nobody reads them."""
    table = str(tmp_path / "table")
    many = spark.createDataFrame([(f"s{k}", 1, k, 0, 0) for k in range(200)], SAVE)
    assert live.upsert_counts(many, table, 0, "a", 16) == []
    one = spark.createDataFrame([("s7", 2, 70, 1, 1)], SAVE)
    read = live.upsert_counts(one, table, 1, "a", 16)
    assert len(read) == 1 and read[0].startswith("1/bucket=")
    # The same batch again, and an older one, are passed over; another source's is not.
    assert live.upsert_counts(spark.createDataFrame([("s7", 9, 0, 0, 0)], SAVE), table, 1, "a", 16) == []
    assert live.upsert_counts(spark.createDataFrame([("s8", 3, 80, 0, 0)], SAVE), table, 0, "b", 16)
    rows = {r.slide_name: (r.save_seq, r.cell_marker) for r in live.read_counts(spark, table).collect()}
    assert len(rows) == 200 and rows["s7"] == (2, 70) and rows["s8"] == (3, 80) and rows["s9"] == (1, 9)
    for k in range(4):
        live.upsert_counts(one.withColumn("save_seq", F.lit(10 + k).cast("bigint")), table, buckets=16)
    assert len(list((tmp_path / "table" / "manifest").glob("*.json"))) == 2
    # Of the touched bucket only the newest version and the one before it are left.
    bucket = read[0].split("/")[1]
    assert len(list((tmp_path / "table" / "data").glob(f"*/{bucket}/*.parquet"))) == 2
    assert live.read_counts(spark, table).count() == 200


def test_killed_batch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    live.upsert_counts(spark.createDataFrame([("a", 1, 1, 1, 1)], SAVE), table, 0, "s")

    def killed(*args):
        raise RuntimeError("killed before the switch")

    switch = live._switch
    monkeypatch.setattr(live, "_switch", killed)
    later = spark.createDataFrame([("a", 2, 2, 2, 2)], SAVE)
    with pytest.raises(RuntimeError):
        live.upsert_counts(later, table, 1, "s")
    assert [tuple(r) for r in live.read_counts(spark, table).collect()] == [("a", 1, 1, 1, 1)]
    monkeypatch.setattr(live, "_switch", switch)
    live.upsert_counts(later, table, 1, "s")
    assert [tuple(r) for r in live.read_counts(spark, table).collect()] == [("a", 2, 2, 2, 2)]


def test_live_counts_as_streaming_aggregate(spark, tmp_path):
    saves = [("a", 2, 5, 1, 1), ("a", 1, 9, 9, 9), ("b", 1, 1, 0, 0)]
    spark.createDataFrame(saves, SAVE).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SAVE).parquet(str(tmp_path / "in"))
    q = live.live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("live").collect())) == [("a", 2, 5, 1, 1), ("b", 1, 1, 0, 0)]
