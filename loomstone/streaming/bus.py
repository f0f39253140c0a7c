"""Publishing memory events to session topics and subscribing to them."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import topics

Handler = Callable[[DataFrame, int], None]


def mounted(path: str) -> str:
    """The path as Python processes open it; a topic log needs a folder that is mounted on all machines."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"a topic log needs a mounted folder, not {path}")
    return unquote(parts.path)


def _columns(events: DataFrame) -> DataFrame:
    return events.select(*(F.col(c.split()[0]).cast("string") for c in topics.EVENTS.split(", ")))


def published(events: DataFrame, root: str, writer: str, checkpoint: str) -> StreamingQuery:
    """Publishes a stream of events (columns of EVENTS).  `writer` names the publisher: with its checkpoint it may start again, and each event is in the log once."""
    events.sparkSession.dataSource.register(topics.Topics)
    return _columns(events).writeStream.format("topics").option("path", mounted(root)).option("writer", writer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscription(spark: SparkSession, root: str, session: str | None = None, after: int = 0) -> DataFrame:
    """A stream of the events of a session, or of all, with their positions; from manifest `after` on."""
    spark.dataSource.register(topics.Topics)
    source = spark.readStream.format("topics").option("path", mounted(root)).option("after", str(after))
    return (source if session is None else source.option("session", session)).load()


def replayed(spark: SparkSession, root: str, session: str | None = None, after: int = 0) -> DataFrame:
    """The events so far, as a table."""
    spark.dataSource.register(topics.Topics)
    source = spark.read.format("topics").option("path", mounted(root)).option("after", str(after))
    return (source if session is None else source.option("session", session)).load()


def subscribed(spark: SparkSession, root: str, session: str | None, handlers: dict[str | None, list[Handler]], checkpoint: str, after: int = 0) -> StreamingQuery:
    """Hands each batch's events to the handlers of their type, and to those of None, which get all.

    A handler gets a DataFrame and the batch's number.  The checkpoint is the
    subscriber: started again, it goes on where it was.  A batch whose handler failed, or
    that was cut off, comes again under its number, so what a handler writes below that number
    is there once; a handler that fails ends the query and keeps no other from its events.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows, failed = rows.persist(), []
        try:
            for kind, own in handlers.items():
                for handler in own:
                    try:
                        handler(rows if kind is None else rows.filter(F.col("event_type") == kind), number)
                    except Exception as e:
                        failed.append(e)
        finally:
            rows.unpersist()
        if failed:
            raise failed[0]

    return subscription(spark, root, session, after).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watched(spark: SparkSession, root: str, session: str | None, queue: str, checkpoint: str, after: int = 0) -> StreamingQuery:
    """A watch queue: a session's events in a folder of parquet files, each once, to be read at any pace."""
    return subscription(spark, root, session, after).writeStream.format("parquet").option("path", queue).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def captured(rows: DataFrame, kind: str, source: str) -> DataFrame:
    """Events of an agent's output (session_id, id, content): a `conversation`, a `thought` or an `output`."""
    return rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("id").cast("string").alias("id"), F.lit(kind).alias("event_type"), F.lit(source).alias("source"), F.col("content").cast("string").alias("content"))
