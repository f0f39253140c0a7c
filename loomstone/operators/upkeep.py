"""Small operators of memory upkeep, projects, plans and interventions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph, tables

# Default policies.
POLICIES = {
    "destructive_ops": [{"field": "operation_type", "operator": "equals", "value": "delete"}, {"field": "operation_type", "operator": "equals", "value": "drop"}],
    "expensive_ops": [{"field": "estimated_cost", "operator": "greater_than", "value": 100}],
    "error_escalation": [{"field": "error_count", "operator": "greater_than", "value": 3}],
}


def accessed(memories: DataFrame, log: DataFrame, id: str = "id", stamp: str = "ts") -> DataFrame:
    """memories with accesses and last_accessed from an access log."""
    hits = log.groupBy(id).agg(F.count("*").alias("accesses"), F.max(stamp).alias("last_accessed"))
    return memories.join(hits, id, "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))


def needs_retrieval(history: Column, confidence: Column, entropy: Column, threshold: float = 0.7) -> Column:
    least = float(1 - Decimal(str(threshold)))  # in doubles 1 - 0.7 is more than 0.3
    return F.when(history.isNotNull(), history < threshold).otherwise((confidence < least) | (entropy > 1.5))


def success_rate(good: Column, all_: Column) -> Column:
    return F.when(all_ == 0, 0.5).otherwise(good / all_)


def early_stopped(metrics: DataFrame, run: str, step: str, loss: str, patience: int = 2) -> DataFrame:
    """The steps of each run up to the one that is `patience` in a row without a new minimum."""
    w = Window.partitionBy(run).orderBy(step)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(loss) < before)
    island = F.sum(F.when(F.col("better"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = metrics.withColumn("better", better).withColumn("island", island)
    out = out.withColumn("bad", F.row_number().over(Window.partitionBy(run, "island").orderBy(step)) - 1)
    stop = F.max((F.col("bad") >= patience).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("stopped", F.coalesce(stop, F.lit(0))).filter("stopped = 0").drop("better", "island", "bad", "stopped")


def cancelled(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Tasks that depend, directly or not, on a failed one."""
    failed = tasks.filter("state = 'failed'").select("task")
    return graph.dependents(failed, deps).join(failed, "task", "left_anti")


def merged_windows(rows: DataFrame, group: str, window: str, least: int = 4, fewest: int = 10) -> DataFrame:
    """merge: whether a row's window is to be merged: it has `least` rows, and its group `fewest`."""
    in_window, in_group = F.count("*").over(Window.partitionBy(group, window)), F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("merge", (in_window >= least) & (in_group >= fewest))


def time_left(created: Column, as_of: Column, seconds: int = 300) -> Column:
    """Seconds until an intervention expires, 0 at least."""
    passed = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 1e6
    return F.greatest(F.lit(0.0), seconds - passed)


def enriched(rows: DataFrame, project: str) -> DataFrame:
    """Rows for the global store: source "global:project:source"."""
    return rows.withColumn("project_name", F.lit(project)).withColumn("source", F.concat(F.lit(f"global:{project}:"), "source"))


def recent_text(memories: DataFrame, working: int = 5, previous: int = 3, short: int = 50, group: str = "session_id", order: str = "nth", id: str = "id", content: str = "content") -> DataFrame:
    """(group, text): the last `working` rows, the newest first, then `previous` of the `short` rows before them, those that say "recent" first, cut to 300 characters."""
    age = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    own = memories.withColumn("age", age).filter(F.col("age") <= working + short).withColumn("now", F.col("age") <= working)
    said = F.size(F.array_intersect(T.plain_words(F.col(content)), T.strings(["recent"])))
    at = F.row_number().over(Window.partitionBy(group, "now").orderBy(F.when(F.col("now"), F.col("age")).otherwise(-said), id))
    line = F.when(F.col("now"), F.concat(F.lit("[Current] "), content)).otherwise(F.concat(F.lit("[Previous] "), F.left(content, F.lit(300)), F.lit("...")))
    rows = own.withColumn("at", at).filter(F.col("now") | (F.col("at") <= previous)).select(group, (~F.col("now")).alias("later"), "at", line.alias("line"))
    lines = lambda later: F.transform(F.array_sort(F.collect_list(F.when(F.col("later") == later, F.struct("at", "line")))), lambda x: x["line"])
    joined = F.concat(lines(F.lit(False)), F.array(F.lit("\n--- Recent History ---\n")), lines(F.lit(True)))
    return rows.groupBy(group).agg(F.array_join(joined, "\n\n").alias("text"))


def tier_sizes(n: Column, working: int = 10, batch: int = 5, short: int = 50, share: float = 0.3) -> dict[str, Column]:
    """Rows of each tier after n items: what falls out of working memory waits for a whole batch; short-term memory sends its oldest share on whenever it is full."""
    out = F.greatest(n - working, F.lit(0)).cast("long")
    batches = F.floor(out / batch)
    moved = int(short * share)
    long = F.when(batches >= short, (F.floor((batches - short) / moved) + 1) * moved).otherwise(0).cast("long")
    return {"working": F.least(n, F.lit(working)).cast("long"), "waiting": out % batch, "short_term": (batches - long).cast("long"), "long_term": long}


def maintained(spark: SparkSession, root: str, created: str, importance: str, now: Column, days: int = 30, least: float = 0.7) -> str:
    """A new snapshot of the table below `root` without what is older than `days` and not important."""
    keep = (F.col(created) > now - F.make_interval(days=F.lit(days))) | (F.col(importance) > least)
    return tables.write_snapshot(tables.read_snapshot(spark, root).filter(keep), root)


def captured(rows: DataFrame, kind: str, source: str, context: str | None = None) -> DataFrame:
    """Rows (content) of an agent's output as memories of a kind: source, memory_type, and the context of a thought."""
    return rows.withColumns({"source": F.lit(source), "memory_type": F.lit(kind), "context": F.lit(context).cast("string")})
