"""What the operators of this subpackage share: written intermediate tables, Arrow stages, text columns."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import scratch_path

#: The words of every contract: runs of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python stage handles at once.
SLICE_BYTES = 4 << 20
#: Spark's bound on the bytes of a batch that it sends to Python; ten thousand texts would be one otherwise.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back: it survives lost executors and cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete the files of saved frames that no later step reads, of large ones as soon as they are used up.

    The collection lets Spark's cleaner drop the shuffle files of the steps that are over as well.
    """
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The whole address of a path, in the session's default store where it names none, as tasks open it without Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    address = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return address if "://" in address else address.replace(":", "://", 1)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_arrow(df: DataFrame, stage: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose workers find this package, also where only the driver's path has it.

    A batch holds about two slices, unless the session sets a size of its own: it is held by the JVM and by Python at once.
    """
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, str(2 * SLICE_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from stage(batches)
        hand_back()
    return df.mapInArrow(whole, schema)


def hand_back() -> None:
    """Return what Arrow and the C library keep of freed memory; a worker waits for the next task, beside stages without Python too."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text column of each holds about ``size`` bytes, or one row that is larger."""
    for batch in batches:
        lengths = batch.column(column)
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(lengths), 0).cast(pa.int64()))
        start, cut = 0, size
        for row, end in enumerate(ends.to_pylist(), 1):
            if end >= cut or row == batch.num_rows:
                yield batch.slice(start, row - start)
                start, cut = row, end + size


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made of the given ones that the frame does not use yet."""
    taken = {c.lower() for c in df.columns}
    made = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        made.append(name)
    return made
