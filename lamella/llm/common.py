"""What the text operators share: batches, scratch tables, words, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lamella.session import scratch_path

#: Rows handed to Python at once; a batch of long documents stays within tens of megabytes.
BATCH_ROWS = "512"

#: Every byte that is no ASCII letter, digit or part of a longer UTF-8 sequence becomes a
#: space and A-Z become a-z, so that ``split`` gives the words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the lower-cased text, as UTF-8 bytes.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of letters, digits and non-ASCII characters, as UTF-8 bytes."""
    return utf8(text).translate(WORD_BYTES).split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def tuned(spark: SparkSession) -> SparkSession:
    """Runtime settings of the text operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Splitting a hot join key is worth an extra shuffle behind it.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def map_rows(df: DataFrame, start: Callable[[], Callable], schema: str, carry: int = 0) -> DataFrame:
    """``mapInArrow`` over columns of Python values.

    ``start`` runs once per task and returns a function from the column lists of a batch
    to the column lists of its result, or to None for no rows. Only one batch is in
    memory at a time. The last ``carry`` columns of ``df`` are not handed to the function
    but follow its columns, row by row, as they are.
    """
    wanted = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(wanted)
    given = len(df.columns) - carry
    for field in df.schema.fields[given:]:
        wanted = wanted.add(field)
    whole = _arrow_schema(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            if batch.num_rows:
                made = step(*[c.to_pylist() for c in batch.columns[:given]])
                if made is not None:
                    columns = [pa.array(v, t) for v, t in zip(made, arrow.types, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *batch.columns[given:]], schema=whole)

    return df.mapInArrow(run, wanted)


def _arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The rows survive lost executors, later steps prune its columns, and no lineage or
    plan estimate is carried on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def counted(df: DataFrame, name: str) -> DataFrame:
    """A :func:`stored` result with its number of rows as ``n_rows``, counted as it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count("*").alias("n")), name)
    out.n_rows = seen.get["n"]
    return out


def bounded_rows(df: DataFrame, name: str) -> Iterator[Row]:
    """The rows of a result that is bounded by constants, such as a model's weights.

    It is made where its partitions are and stored; one small task then brings it to the
    driver, where an iterator over the partitions would run a job for each.
    """
    kept = stored(df, name)
    yield from kept.coalesce(1).toLocalIterator()
    discard(kept)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` result that nothing lazy depends on any more."""
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


#: A key with this share of the rows is joined apart, so at most as many keys as its inverse are.
HOT_SHARE = 1 / 2000


def joined_hot(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, of which ``side`` holds one row per value.

    Values that hold more than ``HOT_SHARE`` of all rows, 2,000 at most, are joined by
    broadcast, where their rows lie; the rest is shuffled, with no value that fills a task.
    ``counts`` gives (key, n) where that is known. ``rows`` and ``side`` are read twice and
    should be stored.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") > rows.count() * HOT_SHARE).select(key)
    hot = side.join(F.broadcast(often), key, "left_semi")
    rest = rows.join(F.broadcast(often), key, "left_anti").join(side, key)
    columns = [*rows.columns, *[c for c in side.columns if c != key]]
    return rest.select(*columns).unionByName(rows.join(F.broadcast(hot), key).select(*columns))


def bucket_of(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``: the fold of a row."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of the key: a fixed random choice."""
    return df.orderBy(F.xxhash64(key), F.col(key)).limit(rows)


def labelled_sample(docs: DataFrame, labelled: DataFrame, id_col: str, columns: Sequence[str], rows: int) -> DataFrame:
    """At most ``rows`` rows ``(id, label, columns)`` of the documents that have a label.

    Null ids, null labels and labels of ids without a document do not count. Of an id that
    repeats, the row of the least hash is taken, and found before the shuffle.
    """
    known = labelled.select(id_col, "label").dropna().distinct()
    few = bounded_sample(known.join(docs.select(id_col).distinct(), id_col, "left_semi"), id_col, rows)
    row = F.struct(F.xxhash64(*columns).alias("_hash"), *columns).alias("_row")
    own = docs.select(id_col, row).join(F.broadcast(few), id_col)
    one = own.groupBy(id_col, "label").agg(F.min("_row").alias("_row"))
    return one.select(id_col, "label", *[F.col(f"_row.{c}") for c in columns])


def distinct_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """One row ``(id, label)`` per id, the greatest label where rows disagree; nulls go."""
    rows = labels.select(id_col, F.col(label).cast("int").alias("label"))
    return rows.dropna().groupBy(id_col).agg(F.max("label").alias("label"))
