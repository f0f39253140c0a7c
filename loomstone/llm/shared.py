"""The folder that driver and executors share, and hashed row ids."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session has none (tests, a single machine), a folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_MADE: dict[str, list[str]] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; cleaned() removes it."""
    path = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark's file systems have it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def made(spark: SparkSession) -> list[str]:
    """What scratch() named for this application and cleaned() hasn't removed: models, recurring lines, archives."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


def cleaned(spark: SparkSession, keep: list[str]) -> None:
    """Deletes what scratch() named for this application, but for `keep`.  For use once results that need it are written: keep what was made before them."""
    for path in made(spark):
        if path not in keep:
            _MADE[spark.sparkContext.applicationId].remove(path)
            removed(spark, path)


def mounted(path: str) -> str:
    """The path as workers open it; files that are memory-mapped need a mounted shared folder."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted on all machines, not {path}")
    return unquote(parts.path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; what comes after doesn't depend on earlier stages."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def text_bytes(name: str) -> Column:
    """A text column for the workers: bytes, null as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")


def fold(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")) % n


def row_key(id: Column, number: Column) -> Column:
    """Text that tells apart rows by id (null is an id of its own) and a whole number; never null, so joins and windows on it share a partitioning."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), id.cast("string")), F.lit("n")), F.lit(":"), number.cast("string"))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with running sums, the own row included, in a total order of its rows.

    Rows are sorted by ranges; sums of the ranges, as many rows as there are
    partitions, are added up first, so no task reads more than a range.  The result
    doesn't depend on where the ranges end.
    """
    ranges = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    each = ranges.groupBy("__p").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("__p", *(F.coalesce(F.sum(f"__{n}").over(upto), F.lit(0)).alias(f"__{n}") for n in sums))
    inside = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.select("*", *(F.sum(c).over(inside).alias(n) for n, c in sums.items())).join(F.broadcast(before), "__p")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(n) + F.col(f"__{n}")).alias(n) for n in sums))
