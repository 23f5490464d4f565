"""Helpers that the training-data operators share: scratch tables, checked broadcasts, flat Arrow text."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

#: Words are maximal runs of anything but these; all are one byte in UTF-8, so texts can be cut as bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: A side may be broadcast up to this many bytes, measured before the join.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that one vectorised pass works on; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes of rows with texts that go to Python at once, about. Workers keep what they once held, so that it adds up with all else.
BATCH_BYTES = 4 << 20
#: Bytes that one task reads where its rows only name ranges of files.
TASK_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset (tests), a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = "file://" + tempfile.mkdtemp(prefix="quillmine-")
        atexit.register(shutil.rmtree, path[7:], True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the JVM ends."""
    path = f"{shared_dir(spark)}/quillmine/{uuid.uuid4().hex}-{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def park(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(parked: DataFrame) -> int:
    """About what the rows of parked take in memory: 16 bytes a row, 8 a number, text and nested values by their written length."""
    size = F.lit(16)
    for field in parked.schema:
        plain = isinstance(field.dataType, (NumericType, BooleanType, DatetimeType))
        size = size + (F.lit(8) if plain else F.lit(8) + F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0)))
    return parked.agg(F.sum(size.cast("long"))).first()[0] or 0


def checked_broadcast(parked: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """parked with a broadcast hint if it takes at most limit bytes (measured now); else as it is, for a shuffled join."""
    return F.broadcast(parked) if measured_bytes(parked) <= limit else parked


def task_count(spark: SparkSession, size: int, units: int) -> int:
    """Tasks for units rows that stand for size bytes of files: Spark sees the few bytes of the rows only and would merge
    their partitions into one, so the number is given. No task has more than about TASK_BYTES, and no core is idle."""
    return max(1, -(-size // TASK_BYTES), min(units, spark.sparkContext.defaultParallelism))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once. A plain column that a lambda uses is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [first, last) of about most bytes each, at least one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = min(last, rows)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def word_bounds(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in flat) of all words of all rows, and each row's first word number (n+1 of them). Words never cross rows."""
    inside = ~_SPACE[flat]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = inside[heads]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The given words with one space between neighbours."""
    if not len(starts):
        return b""
    lengths = ends - starts
    keep = np.zeros(len(flat) + 1, np.int8)
    keep[starts] += 1
    keep[ends] -= 1
    body = flat[np.cumsum(keep[:-1], dtype=np.int8) > 0]
    out = np.full(int(lengths.sum()) + len(starts) - 1, 0x20, np.uint8)
    place = np.ones(len(out), bool)
    place[(np.cumsum(lengths) + np.arange(len(starts)))[:-1]] = False
    out[place] = body
    return out.tobytes()


def shared_file(uri: str):
    """(filesystem, path) of a file in the shared folder, for executors: Arrow opens local, HDFS and object-store addresses."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def new_folder(spark: SparkSession, name: str) -> str:
    """scratch(), made by the driver so that executors can write files in it."""
    path = scratch(spark, name)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def _limited(spark: SparkSession, name: str, most: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int):
    """Jobs started within pass at most so many rows at once to Python: for rows of several kilobytes."""
    return _limited(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def light_batches(spark: SparkSession):
    """Jobs started within pass about BATCH_BYTES of rows at once to Python, or a single longer row: for texts of any length."""
    return _limited(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def discard(*tables: DataFrame) -> None:
    """Delete what park() wrote once nothing reads it any more, and let Spark drop the shuffle files of ended jobs."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            remove_folder(df.sparkSession, file.rsplit("/", 1)[0])
    if tables:
        sweep(tables[0].sparkSession)


def sweep(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects what refers to them."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id: Column, text: Column) -> Column:
    """doc_id as a long; rows without one get keys of their own, after all others."""
    own = F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64(text), 2)
    return F.coalesce(doc_id.cast("long"), own)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carrying(*own: str):
    """For a function that returns rows of its first argument: it sees the columns own, and all others as one struct
    named rest, so no name of theirs can meet one of its own. Their order, and what the function adds, are kept."""

    def wrap(stage):
        @wraps(stage)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            mine = [c for c in docs.columns if c in own]
            others = [c for c in docs.columns if c not in own]
            rest = [F.struct(*[F.col(quoted(c)) for c in others]).alias("rest")] if others else []
            out = stage(docs.select(*mine, *rest), *args, **options)
            back = [F.col(c) if c in own else F.col("rest").getField(c).alias(c) for c in docs.columns]
            return out.select(*back, *[c for c in out.columns if c not in (*mine, "rest")])

        return run

    return wrap
