"""Streams of file changes and memory events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tables
from ..sources import files as source


def file_stream(spark: SparkSession, root: str, includes: tuple[str, ...] = ("*",), excludes: tuple[str, ...] = source.EXCLUDED) -> DataFrame:
    """(path, mtime, hash, kind, content) of files as they come or change."""
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    rows = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("mtime"), "content")
    wanted = source.matches(F.col("path"), includes) & ~source.matches(F.col("path"), excludes)
    return rows.filter(wanted).select("path", "mtime", F.md5("content").alias("hash"), source.kind_of(F.col("path")).alias("kind"), F.decode("content", "UTF-8").alias("content"))


STATE = "path string, mtime timestamp, hash string"


def present(spark: SparkSession, root: str) -> DataFrame:
    """(path): the files that are there now; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def indexed(stream: DataFrame, state: str, checkpoint: str, index: Callable[[DataFrame, int], None], root: str | None = None, forget: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the file state (path, mtime, hash) in snapshots below `state`; `index` gets what is new or has changed, once per batch id.

    root: where the files lie; paths of the state that are no longer there leave it
    with the next batch, and `forget` gets them.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        scan = rows.groupBy("path").agg(F.max_by(F.struct("mtime", "hash", "kind", "content"), "mtime").alias("r")).select("path", "r.*").persist()
        known = tables.load_or_new(spark, state, STATE)
        if root is not None:
            there = present(spark, root)
            if forget is not None:
                forget(known.select("path").join(there, "path", "left_anti"), number)
            known = known.join(there, "path", "left_semi")
        changed = tables.file_changes(known, scan).filter("status in ('new', 'changed')").select("path")
        index(scan.join(changed, "path", "left_semi"), number)
        now = known.join(scan.select("path"), "path", "left_anti").unionByName(scan.select("path", "mtime", "hash"))
        tables.write_snapshot(now, state)
        scan.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_then_published(stream: DataFrame, table: str, topics: str, checkpoint: str) -> StreamingQuery:
    """Each batch of memory events is stored and then published to a folder per session.

    A batch writes below its number, so a batch that runs again replaces its own
    files and no event is stored or published twice.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        rows.write.mode("overwrite").partitionBy("session_id").json(f"{topics}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, stamp: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window with a watermark; an extension for event tables."""
    return stream.withWatermark(stamp, late).groupBy(F.window(stamp, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def every(spark: SparkSession, job: Callable[[int], None], minutes: float = 60.0) -> StreamingQuery:
    """Runs `job` now and then every so many minutes, until the query is stopped: upkeep such as retention or flushing."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda _, number: job(number)).trigger(processingTime=f"{max(1, int(minutes * 60))} seconds").start()


def consolidating(stream: DataFrame, state: str, checkpoint: str, job: Callable[[int, int], None], adds: int = 100) -> StreamingQuery:
    """Counts added rows over batches in snapshots below `state`, and runs `job` once for the full hundreds (`adds`) that a batch completes, with the first one's number and the last one's.

    A batch that runs again counts once.  State is written after the job, so the job of
    a batch that was cut off runs again with the same numbers: what it writes
    below its first number is there once.
    """
    spark = stream.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        held = tables.load_or_new(spark, state, "batch long, total long").orderBy(F.desc("batch")).first()
        if held is not None and held.batch >= number:
            return
        before = held.total if held is not None else 0
        total = before + rows.count()
        if total // adds > before // adds:
            job(before // adds + 1, total // adds)
        tables.write_snapshot(spark.createDataFrame([(number, total)], "batch long, total long"), state)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
