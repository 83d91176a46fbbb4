"""Files of many rows in a given order, one per key, written in parts and then joined.

Rows are range-partitioned by file and order, so a large file is written by many tasks, each
with its stretch of it, and no task holds more than a batch. Files that begin and end inside
one task, as most of many small ones do, are written once, beside their place, and moved
there. Only the first and the last file of a task can go on in another one: these are written
in parts, and one task per file then copies its parts, in order, into one file and moves it.
Readers see whole files only; an attempt that fails leaves no part under a file's name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import durable

COPIED_AT_ONCE = 1 << 20


def _store(root: str):
    """The storage of a folder, as seen from a task, and the folder's path in it."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def write_ordered(rows: DataFrame, order: Sequence[str], root: str) -> DataFrame:
    """Write the column ``text`` of ``rows`` to the files ``root``/``file``, in ``order``.

    The texts of a file follow each other as they are, without any separator. Returns the
    written files (file, bytes). A file that exists is replaced.
    """
    parts_at = f"_parts-{uuid.uuid4().hex}"
    ranged = rows.repartitionByRange("file", *order).sortWithinPartitions("file", *order).select("file", "text")

    def attempt() -> tuple[int, str]:
        from pyspark import TaskContext

        return TaskContext.get().partitionId(), str(TaskContext.get().taskAttemptId())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        part, name = attempt()
        own = f"{parts_at}/{part}-{name}"
        now, out, size, first, done = None, None, 0, True, []

        def close(last: bool) -> None:
            out.close()
            whole = not (first or last)
            if whole:
                store.move(f"{folder}/{own}-{len(done)}", f"{folder}/{now}")
            done.append((now, part, None if whole else f"{own}-{len(done)}", size))

        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for file, texts in groupby(pairs, lambda p: p[0]):
                if file != now:
                    if out is not None:
                        close(False)
                        first = False
                    else:
                        store.create_dir(f"{folder}/{parts_at}", recursive=True)
                    now, size = file, 0
                    out = store.open_output_stream(f"{folder}/{own}-{len(done)}")
                size += out.write("".join(t for _, t in texts).encode())
        if out is not None:
            close(True)
        types = {"file": pa.string(), "part": pa.int32(), "path": pa.string(), "bytes": pa.int64()}
        columns = zip(*done) if done else ((),) * len(types)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(types.items(), columns, strict=True)})

    parts = durable(ranged.mapInArrow(write, "file string, part int, path string, bytes bigint"))
    listed = parts.where("path IS NOT NULL").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("part", "path"))).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        for batch in batches:
            files, sizes = batch.column(0).to_pylist(), []
            for file, pieces in zip(files, batch.column(1).to_pylist(), strict=True):
                whole = f"{folder}/{pieces[0]}-joined-{attempt()[1]}"
                size = 0
                with store.open_output_stream(whole) as out:
                    for piece in pieces:
                        with store.open_input_stream(f"{folder}/{piece}") as part:
                            while chunk := part.read(COPIED_AT_ONCE):
                                size += out.write(chunk)
                store.move(whole, f"{folder}/{file}")
                sizes.append(size)
            yield pa.RecordBatch.from_pydict({"file": pa.array(files, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    joined = durable(listed.select("file", "parts.path").mapInArrow(join, "file string, bytes bigint"))
    context = rows.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(f"{root}/{parts_at}")
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return parts.where("path IS NULL").select("file", "bytes").unionByName(joined)
