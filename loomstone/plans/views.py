"""The engine's logical tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import parts

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns: id, content, session_id, memory_type, nth."""
    return table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("content"), F.col("conv_id").alias("session_id"), F.col("role").alias("memory_type"), F.col("turn").alias("nth"))


MEMORIES = "SELECT conv_id || ':' || turn AS id, text AS content, conv_id AS session_id, role AS memory_type, turn AS nth FROM conversations"


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as stored memories: id, session_id, memory_type, created_at, importance, accesses."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), F.col("event_type").alias("memory_type"), F.col("ts").alias("created_at"), (F.col("value") / 100).alias("importance"), (F.col("user_id") % 7).alias("accesses"), F.col("props").alias("content"))


ENTRIES = "SELECT event_id AS id, user_id AS session_id, event_type AS memory_type, ts AS created_at, value / 100 AS importance, user_id % 7 AS accesses, props AS content FROM events"


def commits(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits: hash, author, stamp, message."""
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat(F.col("c_name"), F.lit(" <"), F.lower("c_mktsegment"), F.lit("@mail>")).alias("author"))
    return table(spark, d, "orders").join(who, "o_custkey").select(F.col("o_orderkey").alias("hash"), "author", F.col("o_orderdate").alias("stamp"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"))


COMMITS = "SELECT o_orderkey AS hash, c_name || ' <' || lower(c_mktsegment) || '@mail>' AS author, o_orderdate AS stamp, o_orderpriority || ' ' || o_orderstatus AS message FROM orders JOIN customer ON o_custkey = c_custkey"


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    """Line items as changed files: hash, path, insertions, deletions."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.concat(F.lit("src/m"), F.col("l_suppkey"), F.lit("/f"), F.col("l_partkey"), F.lit(".py")).alias("path"), F.col("l_quantity").cast("int").alias("insertions"), F.col("l_linenumber").alias("deletions"))


FILES = "SELECT l_orderkey AS hash, 'src/m' || l_suppkey || '/f' || l_partkey || '.py' AS path, CAST(l_quantity AS INT) AS insertions, l_linenumber AS deletions FROM lineitem"


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: id, name, symbol_type, language, path."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.lower("p_type").alias("symbol_type"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_size"), F.element_at(F.array(*map(F.lit, (".py", ".ts", ".rs", ".txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("path"))


SYMBOLS = "SELECT p_partkey AS id, replace(p_name, ' ', '.') AS name, lower(p_type) AS symbol_type, 'src/' || p_brand || '/' || p_size || (['.py', '.ts', '.rs', '.txt'])[CAST(p_partkey % 4 + 1 AS INT)] AS path FROM part"


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as tasks: task, role, state."""
    state = F.when(F.col("s_suppkey") < 4, "completed").when(F.col("s_suppkey") % 5 == 4, "failed").otherwise("pending")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("task"), F.concat(F.lit("role"), F.col("s_nationkey") % 3).alias("role"), state.alias("state"))


TASKS = "SELECT s_suppkey AS task, 'role' || (s_nationkey % 3) AS role, CASE WHEN s_suppkey < 4 THEN 'completed' WHEN s_suppkey % 5 = 4 THEN 'failed' ELSE 'pending' END AS state FROM supplier"


def deps(spark: SparkSession, d: str) -> DataFrame:
    """A task depends on its half, and on its third and its fifth where they are whole."""
    t = tasks(spark, d).filter("task > 0").select("task")
    part = lambda k: t.filter(F.col("task") % k == 0).select("task", F.floor(F.col("task") / k).cast("long").alias("dep"))
    return t.select("task", F.floor(F.col("task") / 2).cast("long").alias("dep")).union(part(3)).union(part(5)).distinct()


DEPS = "SELECT DISTINCT task, dep FROM (SELECT s_suppkey AS task, s_suppkey // 2 AS dep FROM supplier WHERE s_suppkey > 0 UNION ALL SELECT s_suppkey, s_suppkey // 3 FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 0 UNION ALL SELECT s_suppkey, s_suppkey // 5 FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey > 0)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("item_id"))


RUNS = "SELECT l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS item_id FROM lineitem"


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """Half of the items of an order, graded, and one that is never retrieved."""
    lines = table(spark, d, "lineitem").filter("l_suppkey % 2 = 0").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item_id"), F.round(F.col("l_discount") * 10, 2).alias("relevance"))
    own = lines.repartition(parts(lines, 1), "query_id", "item_id").groupBy("query_id", "item_id").agg(F.max("relevance").alias("relevance"))
    return own.union(table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(-1).cast("long"), F.lit(0.7)))


QRELS = "SELECT l_orderkey AS query_id, l_partkey AS item_id, max(round(l_discount * 10, 2)) AS relevance FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY ALL UNION ALL SELECT o_orderkey, -1, 0.7 FROM orders"
