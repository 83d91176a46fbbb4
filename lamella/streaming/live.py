"""Annotation counts per slide, kept current from a stream of saves."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamella.session import durable

COUNTS = ("cell_marker", "region", "fov")
BUCKETS = 64


def live_counts(saves: DataFrame) -> DataFrame:
    """Counts of the latest save per slide, of a table or of a stream.

    ``saves`` holds slide_name, save_seq and the three counts. The greatest sequence
    wins, so repeated and late saves change nothing. On a stream this is an aggregation
    with one state row per slide, for update or complete mode.
    """
    return saves.groupBy("slide_name").agg(
        F.max("save_seq").alias("save_seq"), *[F.max_by(c, "save_seq").alias(c) for c in COUNTS]
    )


def _files(spark: SparkSession, path: str):
    """The storage of a path, and a function that makes its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Names of the table's manifests, oldest first."""
    files, make = _files(spark, path)
    place = make(f"{path}/manifest")
    listed = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
    return sorted(n for n in listed if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, name: str | None) -> dict:
    """What a version of the table consists of: a folder per bucket, and the batches it holds."""
    if name is None:
        return {"version": 0, "folders": {}, "batches": {}}
    return json.loads(spark.read.text(f"{path}/manifest/{name}", wholetext=True).first()[0])


def _newest(spark: SparkSession, path: str) -> dict:
    names = _manifests(spark, path)
    return _manifest(spark, path, names[-1] if names else None)


def _read(spark: SparkSession, path: str, folders: Iterable[str], schema: str) -> DataFrame:
    places = [f"{path}/data/{f}" for f in folders]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


TABLE = "slide_name string, save_seq bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of the count table; the table has no rows before its first batch."""
    return _read(spark, path, _newest(spark, path)["folders"].values(), TABLE)


def upsert_counts(
    batch: DataFrame, path: str, batch_id: int | None = None, source: str = "", buckets: int = BUCKETS
) -> list[str]:
    """Merge a batch of saves into the count table below ``path``; returns the folders it read.

    Slides are spread over hash buckets. Only the folders of the touched buckets are read,
    by name, and their new rows go to a folder of the next version. The table moves on when
    that version's manifest is put in place, by a rename; until then, and after a batch that
    was killed, readers see the version before. A batch of a ``source`` that the table
    already holds by its ``batch_id`` is passed over, so one that runs twice changes nothing.
    """
    spark = batch.sparkSession
    now = _newest(spark, path)
    if batch_id is not None and now["batches"].get(source, -1) >= batch_id:
        return []
    bucket = F.pmod(F.xxhash64("slide_name"), F.lit(buckets)).cast("int")
    typed = batch.select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], TABLE).schema])
    fresh = durable(live_counts(typed).withColumn("bucket", bucket))
    # At most as many numbers as there are buckets.
    touched = fresh.agg(F.sort_array(F.collect_set("bucket")).alias("b")).first()["b"]
    folders = [now["folders"][str(b)] for b in touched if str(b) in now["folders"]]
    merged = live_counts(_read(spark, path, folders, TABLE).unionByName(fresh.drop("bucket")))
    version = now["version"] + 1
    merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{version}")
    after = {
        "version": version,
        "folders": now["folders"] | {str(b): f"{version}/bucket={b}" for b in touched},
        "batches": now["batches"] | ({source: batch_id} if batch_id is not None else {}),
    }
    _switch(spark, path, after)
    _clean(spark, path)
    return folders


def _switch(spark: SparkSession, path: str, manifest: dict) -> None:
    files, make = _files(spark, path)
    draft = make(f"{path}/manifest/{manifest['version']:012d}.draft")
    out = files.create(draft, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    files.rename(draft, make(f"{path}/manifest/{manifest['version']:012d}.json"))


def _clean(spark: SparkSession, path: str) -> None:
    """Delete what neither the newest version nor the one before it, which may be read, uses."""
    files, make = _files(spark, path)
    names = _manifests(spark, path)
    used = {f for n in names[-2:] for f in _manifest(spark, path, n)["folders"].values()}
    for name in names[:-2]:
        for folder in set(_manifest(spark, path, name)["folders"].values()) - used:
            files.delete(make(f"{path}/data/{folder}"), True)
        files.delete(make(f"{path}/manifest/{name}"), True)


def start_live_counts(saves: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Keep the count table below ``path`` current from a stream of saves."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        upsert_counts(batch, path, batch_id, checkpoint)

    writer = saves.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
