"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, of the session or set on its context; only a local master that has none gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loomstone-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def folder(spark: SparkSession, what: str) -> str:
    """A new path in that folder."""
    return f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """The rows, written to that folder; what comes after doesn't depend on earlier stages."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def filed(df: DataFrame, path: str) -> DataFrame:
    """The rows, written to a path and read from it; unlike a checkpoint's, their plan keeps no constraints, which break unions of many rounds."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, mb: int = 8) -> int:
    """Partitions for `mb` megabytes of a table's size in its files each, one a core at least: what a task holds doesn't grow with the table.  Where no size is known, the session's number."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(100_000, -(-size // (mb << 20))))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table that one task would read, dealt out to all cores for work that takes long for its bytes; a larger table as it is."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    one = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= one else df


def sliced(batch: pa.RecordBatch, column: str, most: int = 1 << 20, rows: int = 1 << 10) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `most` bytes in a text column, `rows` at most; a longer text stands alone."""
    sizes, lo, held = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 0, 0
    for k, size in enumerate(sizes):
        if k > lo and (held + size > most or k - lo >= rows):
            yield batch.slice(lo, k - lo)
            lo, held = k, 0
        held += size
    if lo < batch.num_rows or not batch.num_rows:
        yield batch.slice(lo)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system: Spark keeps workers for later tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # not glibc
                pass

    return wrapped
