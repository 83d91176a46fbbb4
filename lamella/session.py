"""Session settings, durable intermediate results and distributed row numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splitting a hot join key is worth an extra shuffle behind it.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Before a run the size of a derived table is a guess from its compressed files, up to a
    # hundred times too small: only the smallest tables are broadcast on it. Larger ones are
    # when their rows have been shuffled and counted.
    "spark.sql.autoBroadcastJoinThreshold": "64k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Shuffled rows of keys and short names shrink about thirtyfold: Spark's own 64 MB of them
    # are 2 GB in a task's maps and sorts. A number of partitions that does not depend on the
    # cluster's default keeps to the size on large tables, too.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    # Stored rows grow as much when they are read: 32 MB of files stay in a task's memory on
    # their way into a shuffle. Small files cost their opening, not the 4 MB of Spark's own
    # setting, so that a task takes many of them and one small table is read by several tasks.
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.files.openCostInBytes": "256k",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators rely on."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate results that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A local master may run without
    the setting and then gets a fresh temporary folder; a cluster may not.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="lamella-")
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from there.

    Later steps do not recompute the lineage, read only the columns they use, start from
    the size that was written instead of an estimate of an estimate, and survive the loss
    of an executor. :func:`release` deletes what was stored.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "durable")
    df.write.parquet(path)
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of at most so many bytes in memory are small: Spark would broadcast them by their
#: counted size, too, but shuffles the other side of the join before it knows.
SMALL = 32 << 20


def is_small(df: DataFrame) -> bool:
    """Whether the rows of a stored ``df`` of strings may be sent to every executor."""
    text = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    size = df.agg(F.sum(sum(text, F.lit(64)).cast("bigint"))).first()[0]
    return (size or 0) <= SMALL


#: Paths of the stored results, by application.
_STORED: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Delete the results that :func:`durable` stored in this application; their number.

    Call it when what was built on them has been written.
    """
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        place = hadoop(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def numbered(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rn"
) -> DataFrame:
    """``row_number()`` per ``keys`` that no single task has to compute for a hot key.

    Rows are range-partitioned by keys and order, so a hot key spans many partitions.
    Each (partition, key) slice is numbered on its own, and the slice sizes, one row per
    slice, give the offset to add. The ranged rows are made durable first: the slice a
    row belongs to is then stored data, the same in both uses and after a lost executor.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order)
    slices = durable(ranged.withColumn("_slice", F.spark_partition_id()))
    by_slice = [*keys, "_slice"]
    inside = Window.partitionBy(*by_slice).orderBy(*order)
    before = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = slices.groupBy(*by_slice).agg(F.count("*").alias("_n")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    local = slices.withColumn("_local", F.row_number().over(inside))
    on = [local[k].eqNullSafe(offsets[k]) for k in by_slice]
    cond = on[0]
    for part in on[1:]:
        cond = cond & part
    joined = local.join(offsets, cond)
    return joined.select(
        *[local[c] for c in df.columns],
        (F.col("_local") + F.col("_offset")).cast("bigint").alias(name),
    )
