"""Queries that run streams to their end or write and read tables, and their SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables, upkeep
from ..operators.shared import folder
from ..streaming import bus, cascade, changes, expiry
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as a stream."""
    path = f"{d}/conversations.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/conversations.parque[t]")  # a pattern, as the table may be one file
    return rows.select(F.col("conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.col("turn").alias("nth"))


@add("st09_memory_cascade", f"WITH m AS (SELECT session_id, id, content, row_number() OVER (PARTITION BY session_id ORDER BY nth) - 1 AS k, count(*) OVER (PARTITION BY session_id) AS n FROM ({V.MEMORIES})), e AS (SELECT *, k // 2 AS b FROM m WHERE k < n - 2) SELECT session_id, 'short_term' AS layer, array_to_string(list(id ORDER BY k), ',') AS ids, CASE WHEN length(array_to_string(list(content ORDER BY k), chr(10))) > 2000 THEN left(array_to_string(list(content ORDER BY k), chr(10)), 2000) || '...' ELSE array_to_string(list(content ORDER BY k), chr(10)) END AS heads FROM e GROUP BY session_id, b HAVING count(*) = 2")
def st09(s, d):
    at = folder(s, "cascade")
    out = cascade.cascade(turns(s, d), cascade.Limits(working=2, batch=2))
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(cascade.OUT).parquet(f"{at}/rows").select("session_id", "layer", F.array_join("ids", ",").alias("ids"), F.col("content").alias("heads"))


@add("st07_store_then_publish", f"SELECT session_id, count(*) AS n, max(id) AS last FROM ({V.MEMORIES}) GROUP BY session_id")
def st07(s, d):
    at = folder(s, "publish")
    changes.stored_then_published(turns(s, d), f"{at}/table", f"{at}/topics", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/table").groupBy("session_id").agg(F.count("*").alias("n"), F.max("id").alias("last"))


@add("st06_session_topics", f"SELECT id, content FROM ({V.MEMORIES}) WHERE session_id = 4")
def st06(s, d):
    at = folder(s, "topics")
    changes.stored_then_published(turns(s, d), f"{at}/table", f"{at}/topics", f"{at}/state").awaitTermination()
    return s.read.json(f"{at}/topics/batch=*/session_id=4").select("id", "content")


def _events(spark: SparkSession, d: str, part: int) -> DataFrame:
    """Half of the turns as a stream of events, a user's as conversation, others as output."""
    path = f"{d}/conversations.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/conversations.parque[t]").filter(F.col("turn") % 2 == part)
    own = rows.select(F.col("conv_id").alias("session_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("content"), "role")
    return bus.captured(own, "output", "agent").withColumn("event_type", F.when(F.split_part("id", F.lit(":"), F.lit(2)).cast("int") % 2 == 0, "conversation").otherwise("output"))


def _log(spark: SparkSession, d: str, part: int, at: str) -> None:
    bus.published(_events(spark, d, part), f"{at}/log", f"publisher {part}", f"{at}/publisher-{part}").awaitTermination()


@add("st06_subscriptions", f"SELECT subscriber, id, content FROM ({V.MEMORIES}), (VALUES ('early'), ('late')) s(subscriber) WHERE session_id = 4")
def st06_subscriptions(s, d):
    """Two subscribers of a session: one is there before the second half is published and starts again after it, one comes late."""
    at = folder(s, "bus")

    def listen(who: str) -> None:
        handler = lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/seen/subscriber={who}/batch={n}")
        bus.subscribed(s, f"{at}/log", "4", {None: [handler]}, f"{at}/{who}").awaitTermination()

    _log(s, d, 0, at)
    listen("early")
    _log(s, d, 1, at)
    for who in ("early", "late", "early", "late"):
        listen(who)
    return s.read.parquet(f"{at}/seen").select("subscriber", "id", "content")


@add("rm25_watch_queue", f"SELECT session_id::VARCHAR AS session_id, CASE WHEN nth % 2 = 0 THEN 'conversation' ELSE 'output' END AS event_type, count(*) AS n, min(content) AS least FROM ({V.MEMORIES}) GROUP BY ALL")
def rm25_watch(s, d):
    """What a watcher of all sessions finds in its queue, by session and type."""
    at = folder(s, "watch")
    for part in (0, 1):
        _log(s, d, part, at)
        bus.watched(s, f"{at}/log", None, f"{at}/queue", f"{at}/watcher").awaitTermination()
    return s.read.parquet(f"{at}/queue").groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.min("content").alias("least"))


@add(
    "st12_expiry_timers",
    """WITH c AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN 120 ELSE 300 END AS most, event_type = 'purchase' AS auto, CASE WHEN event_id % 3 = 0 THEN user_id % 600 END AS wait FROM events WHERE event_type IN ('error', 'purchase')),
 w AS (SELECT epoch_us(max(ts + to_seconds(coalesce(wait, 0)))) - 600000000 AS mark FROM c)
 SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS session_id, CASE WHEN wait <= most THEN 'rejected' WHEN auto THEN 'approved' ELSE 'expired' END AS status, CASE WHEN wait <= most THEN 'ann' ELSE 'system' END AS who, epoch_us(ts) + least(coalesce(wait, most), most) * 1000000 AS micros
 FROM c, w WHERE wait IS NOT NULL OR epoch_us(ts) + most * 1000000 < mark""",
)
def st12_timers(s, d):
    """Errors and purchases wait for people; every third is resolved after user_id % 600 seconds, purchases approve themselves after 120, what is left expires after 300."""
    at = folder(s, "interventions")
    e = V.table(s, d, "events").filter("event_type in ('error', 'purchase')").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("user_id") % 600).alias("wait"), (F.col("event_id") % 3 == 0).alias("seen"), F.when(F.col("event_type") == "purchase", 120.0).alias("auto_approve_after"))
    none = F.lit(None).cast("string")
    made = e.select("id", "session_id", F.lit("created").alias("what"), "at", none.alias("status"), none.alias("by"), "auto_approve_after")
    done = e.filter("seen").select("id", "session_id", F.lit("resolved").alias("what"), (F.col("at") + F.make_interval(secs=F.col("wait"))).alias("at"), F.lit("rejected").alias("status"), F.lit("ann").alias("by"), F.lit(None).cast("double").alias("auto_approve_after"))
    made.union(done).write.parquet(f"{at}/events")
    out = expiry.outcomes(s.readStream.schema(expiry.EVENT).parquet(f"{at}/events"), "10 minutes")
    out.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(expiry.OUT).parquet(f"{at}/rows").select("id", "session_id", "status", F.col("by").alias("who"), F.unix_micros("at").alias("micros"))


@add("snk05_snapshot", f"SELECT id, memory_type FROM ({V.ENTRIES}) WHERE id % 2 = 0")
def snk05(s, d):
    at = folder(s, "snapshot")
    e = V.entries(s, d).select("id", "memory_type")
    tables.write_snapshot(e, at, ["memory_type"])
    tables.write_snapshot(tables.read_snapshot(s, at).filter("id % 2 = 0"), at, ["memory_type"])
    return tables.read_snapshot(s, at)


@add("snk06_concurrent_updates", f"SELECT id, memory_type, CAST(CASE WHEN memory_type IN ('error', 'view', 'click') THEN 1 ELSE 0 END AS INT) AS touched FROM ({V.ENTRIES})")
def snk06_concurrent(s, d):
    """Three writers at once, each with rows of its own to change in one table."""
    at = folder(s, "updates")
    tables.write_snapshot(V.entries(s, d).select("id", "memory_type", F.lit(0).alias("touched")), at)
    change = lambda kind: lambda t: t.withColumn("touched", F.when(F.col("memory_type") == kind, F.col("touched") + 1).otherwise(F.col("touched")))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda kind: tables.updated(s, at, change(kind)), ("error", "view", "click")))
    return tables.read_snapshot(s, at)


@add("snk01_append_partitioned", f"SELECT id, memory_type FROM ({V.ENTRIES}) WHERE memory_type = 'error'")
def snk01(s, d):
    at = folder(s, "memories")
    e = V.entries(s, d).select("id", "memory_type")
    for part in (e.filter("id % 2 = 0"), e.filter("id % 2 = 1")):
        part.write.mode("append").partitionBy("memory_type").parquet(at)
    return s.read.parquet(at).filter(tables.condition_on("memory_type", "error"))


@add("cq09_sync_replaces_chunks", f"SELECT path, count(*) AS n, max(version) AS version FROM (SELECT path, deletions, CASE WHEN deletions >= 6 THEN 2 ELSE 1 END AS version, max(deletions) OVER (PARTITION BY path) AS most FROM ({V.FILES})) WHERE (most >= 6 AND deletions >= 6) OR (most < 6 AND most <> 2) GROUP BY path")
def cq09(s, d):
    f = V.commit_files(s, d)
    most = f.groupBy("path").agg(F.max("deletions").alias("most"))
    old = f.select("path", "deletions", F.lit(1).alias("version"))
    fresh = f.filter("deletions >= 6").select("path", "deletions", F.lit(2).alias("version"))
    return tables.replaced(old, fresh, most.filter("most = 2").select("path")).groupBy("path").agg(F.count("*").alias("n"), F.max("version").alias("version"))


@add("cq08_file_history", f"WITH f AS ({V.FILES}), c AS ({V.COMMITS}) SELECT f.path, c.hash, c.message FROM f JOIN c ON c.hash = f.hash WHERE f.path LIKE 'src/m3/%' QUALIFY row_number() OVER (PARTITION BY f.path ORDER BY c.stamp DESC, c.hash) <= 2")
def cq08(s, d):
    from pyspark.sql import Window

    own = V.commit_files(s, d).filter(F.startswith("path", F.lit("src/m3/"))).select("hash", "path").join(V.commits(s, d), "hash")
    last = Window.partitionBy("path").orderBy(F.desc("stamp"), "hash")
    return own.withColumn("k", F.row_number().over(last)).filter("k <= 2").select("path", "hash", "message")


@add("st10_maintenance", f"SELECT id, memory_type FROM ({V.ENTRIES}) WHERE created_at > TIMESTAMP '2024-02-13 00:00:00' - INTERVAL 30 DAY OR importance > 0.7")
def st10(s, d):
    """One run of the hourly job."""
    at = folder(s, "maintenance")
    tables.write_snapshot(V.entries(s, d), at)
    upkeep.maintained(s, at, "created_at", "importance", F.lit("2024-02-13 00:00:00").cast("timestamp"))
    return tables.read_snapshot(s, at).select("id", "memory_type")


@add("st11_consolidation_trigger", "SELECT unnest(range(1, count(*) // 100 + 1)) AS hundreds FROM events")
def st11(s, d):
    """The numbers of adds, in hundreds, for which consolidation has run: a batch's run writes those it has completed."""
    at = folder(s, "adds")
    rows = V.table(s, d, "events").select("event_id")
    rows.repartition(37).write.parquet(f"{at}/rows")
    stream = s.readStream.schema("event_id long").option("maxFilesPerTrigger", 3).parquet(f"{at}/rows")
    run = lambda k, last: s.range(k, last + 1).withColumnRenamed("id", "hundreds").write.mode("overwrite").parquet(f"{at}/runs/run={k}")
    changes.consolidating(stream, f"{at}/state", f"{at}/checkpoint", run).awaitTermination()
    return s.read.schema("hundreds long").parquet(f"{at}/runs/*")
