"""Files and session documents as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"py": "python", "js": "javascript", "ts": "javascript", "md": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml"}
EXCLUDED = ("*/.git/*", "*/__pycache__/*", "*/node_modules/*", "*/.venv/*", "*/dist/*", "*/build/*")


def glob_regex(pattern: str) -> str:
    """A glob as a regex over whole paths: * within or across folders, ? one character."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def matches(path: Column, patterns: tuple[str, ...]) -> Column:
    return F.rlike(path, F.lit("|".join(map(glob_regex, patterns)))) if patterns else F.lit(False)


def kind_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), suffix), F.lit("text"))


def files(spark: SparkSession, root: str, pattern: str = "*", excludes: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, mtime, hash, kind, content) of all files below root; the glob is pushed down to the listing."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rows = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("mtime"), "content")
    return rows.filter(~matches(F.col("path"), excludes)).select("path", "mtime", F.md5("content").alias("hash"), kind_of(F.col("path")).alias("kind"), F.decode("content", "UTF-8").alias("content"))


SESSION = "session_id string, decisions array<string>, project string, working_directory string, timestamp string, _bad string"


def sessions(spark: SparkSession, root: str) -> DataFrame:
    """Session documents (one JSON object per file); files that aren't JSON are left out."""
    raw = spark.read.schema(SESSION).option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(root)
    return raw.filter("_bad is null and session_id is not null").drop("_bad")


def decisions(sessions: DataFrame) -> DataFrame:
    """(session_id, nth, content): a decision is an object with `content`, or a bare string."""
    one = sessions.select("session_id", F.posexplode("decisions").alias("nth", "d"))
    return one.select("session_id", "nth", F.when(F.startswith(F.trim("d"), F.lit("{")), F.coalesce(F.get_json_object("d", "$.content"), F.lit(""))).otherwise(F.col("d")).alias("content"))


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, item_id, relevance) of a data set {queries: [{query, expected: [{id, relevance}]}]}; relevance 1 if absent."""
    raw = spark.read.schema("queries array<struct<query:string,expected:array<struct<id:string,relevance:double>>>>").option("multiLine", "true").json(path)
    q = raw.select(F.posexplode("queries").alias("query_id", "q")).select("query_id", "q.query", F.explode("q.expected").alias("e"))
    return q.select("query_id", "query", F.col("e.id").alias("item_id"), F.coalesce("e.relevance", F.lit(1.0)).alias("relevance"))
