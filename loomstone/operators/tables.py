"""Table maintenance without updates in place: a change makes new rows, a write makes a new snapshot."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def deleted(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among `ids`."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins: for each key the row of the highest version, the new rows' in a tie."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__nth", F.row_number().over(last)).filter("__nth = 1").drop("__nth", "__new")


def file_changes(known: DataFrame, scan: DataFrame) -> DataFrame:
    """Rows (path, status): new, changed (newer and of another hash), same, deleted.  Both have path, mtime, hash."""
    k, s = known.alias("k"), scan.alias("s")
    status = F.when(F.col("k.path").isNull(), "new").when(F.col("s.path").isNull(), "deleted").when((F.col("s.mtime") > F.col("k.mtime")) & (F.col("s.hash") != F.col("k.hash")), "changed").otherwise("same")
    return k.join(s, F.col("k.path") == F.col("s.path"), "full").select(F.coalesce("k.path", "s.path").alias("path"), status.alias("status"))


def replaced(chunks: DataFrame, fresh: DataFrame, gone: DataFrame, path: str = "path") -> DataFrame:
    """Chunks in which the paths of `fresh` are replaced and those of `gone` are missing."""
    out = fresh.select(path).union(gone.select(path)).distinct()
    return chunks.join(out, path, "left_anti").unionByName(fresh)


class Conflict(RuntimeError):
    """Another writer's snapshot came between what was read and what is written."""


class NoSnapshot(FileNotFoundError):
    """Nothing was written below a root yet."""


def _files(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers below root, which ascend."""
    fs, path = _files(spark, root)
    if not fs.exists(path(root)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path(root))]
    return sorted(int(n.removeprefix("current-")) for n in names if n.startswith("current-"))


def version(spark: SparkSession, root: str) -> int:
    """Number of the last snapshot below root, 0 before the first."""
    return max(_versions(spark, root.rstrip("/")), default=0)


def write_snapshot(rows: DataFrame, root: str, partition_by: list[str] | None = None, base: int | None = None) -> str:
    """Writes a new snapshot below root and then a pointer to it with the next number; readers see the old or the new one whole.

    Nothing is deleted or replaced, so at no time is there no pointer.  base: the
    version that the rows were made of; if another has come since, nothing changes
    and Conflict is raised.  Without it the rows replace whatever is there.  Of two
    writers that take the same number one fails.  forget_snapshots() removes old ones.
    """
    root = root.rstrip("/")
    spark, name = rows.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    rows.write.partitionBy(*(partition_by or [])).parquet(f"{root}/{name}")
    fs, path = _files(spark, root)
    last = version(spark, root)
    if base is not None and last != base:
        fs.delete(path(f"{root}/{name}"), True)
        raise Conflict(f"{root} is at version {last}, not {base}")
    at = path(f"{root}/current-{last + 1:012d}")
    held = path(f"{root}/.{uuid.uuid4().hex}")
    out = fs.create(held, True)
    out.write(bytearray(json.dumps({"snapshot": name}).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(held, at):
        fs.delete(held, False)
        fs.delete(path(f"{root}/{name}"), True)
        raise Conflict(f"{at.toString()} was written meanwhile")
    return f"{root}/{name}"


def updated(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], partition_by: list[str] | None = None, tries: int = 8) -> str:
    """Reads the last snapshot, writes what `change` makes of it as the next, and does both again if another writer came first, so no writer's change is lost; Conflict after so many tries."""
    for k in range(tries):
        base = version(spark, root)
        try:
            return write_snapshot(change(read_snapshot(spark, root, base)), root, partition_by, base)
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("at least one try is needed")


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The last snapshot below root, or that of a number; NoSnapshot before the first."""
    root = root.rstrip("/")
    number = version(spark, root) if number is None else number
    if not number:
        raise NoSnapshot(root)
    line = spark.read.text(f"{root}/current-{number:012d}").first()[0]
    return spark.read.parquet(f"{root}/{json.loads(line)['snapshot']}")


def load_or_new(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The last snapshot, or an empty table of this schema."""
    try:
        return read_snapshot(spark, root)
    except NoSnapshot:
        return spark.createDataFrame([], schema)


def forget_snapshots(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the last `keep` snapshots, pointers first; a reader of an older one fails."""
    root = root.rstrip("/")
    fs, path = _files(spark, root)
    for n in _versions(spark, root)[:-keep]:
        at = f"{root}/current-{n:012d}"
        name = json.loads(spark.read.text(at).first()[0])["snapshot"]
        fs.delete(path(at), False)
        fs.delete(path(f"{root}/{name}"), True)


def as_json(state: DataFrame) -> DataFrame:
    """(json): a state table as one JSON object per row; from_json() with its schema brings it back."""
    return state.select(F.to_json(F.struct(*state.columns)).alias("json"))


def of_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")


def condition_on(column: str, value) -> Column:
    """Equality with a literal, never built from text."""
    return F.col(column) == F.lit(value)
