"""MinHash signatures stored by bands: new texts find the known ones that are like them without a scan.

Below its folder a store has `sets` (print, words: each distinct set of shingles once),
`members` (print, id) and `bands` (band, key, print).  Texts with equal sets share one
print, so a band that very many copies would fill holds them once.  A new text looks
its 16 bands of 8 slots up, a join on (band, key) that Spark can split where a key
is hot, and what it meets is compared whole.  A pair with a Jaccard similarity s
meets with a probability of 1 - (1 - s ** 8) ** 16: 0.95 at 0.8, 0.9999 at 0.9.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .shared import held

BANDS, ROWS = 16, 8


def _sets(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, print, words) of texts that have words."""
    own = rows.filter(F.col(text).isNotNull()).select(F.col(id).alias("id"), X.shingles(F.col(text)).alias("words")).filter(F.size("words") > 0)
    return own.withColumn("print", F.sha2(F.array_join(F.array_sort("words"), "\n").cast("binary"), 256))


def band_keys(words: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """An array of (band, key) of a set of shingles."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.md5(F.array_join(F.slice(s, b * rows + 1, rows), "").cast("binary")).alias("key")))
    return cut(X.minhash(words, bands * rows))


def add(rows: DataFrame, path: str, id: str = "id", text: str = "content") -> str:
    """Adds texts to the store below `path`, as a batch; sets that are known already only get members.  Signatures are made once for each new set."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    own = held(_sets(rows, id, text))
    fresh = own.groupBy("print").agg(F.first("words").alias("words"))
    if (known := _read(spark, path, "sets")) is not None:
        fresh = fresh.join(known.select("print"), "print", "left_anti")
    fresh = held(fresh)
    banded = fresh.select("print", F.explode(band_keys(F.col("words"))).alias("b")).select("b.band", "b.key", "print")
    banded.hint("rebalance", "band").sortWithinPartitions("band", "key").write.parquet(f"{path}/bands/batch={name}")
    fresh.write.parquet(f"{path}/sets/batch={name}")
    own.select("print", "id").write.parquet(f"{path}/members/batch={name}")
    return path


def _read(spark: SparkSession, path: str, what: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{what}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(f"{path}/{what}").drop("batch")


def probed(spark: SparkSession, path: str, rows: DataFrame, least: float = 0.8, id: str = "id", text: str = "content") -> DataFrame:
    """(id, other, jaccard, copies): known sets of shingles at least `least` like each text's, by their smallest id, and how many texts have that set."""
    own = held(_sets(rows, id, text))
    asked = held(own.groupBy("print").agg(F.first("words").alias("mine")))
    keys = asked.select(F.col("print").alias("asked"), F.explode(band_keys(F.col("mine"))).alias("b")).select("asked", "b.band", "b.key")
    met = keys.join(_read(spark, path, "bands"), ["band", "key"]).select("asked", "print").distinct()
    like = met.join(asked.withColumnRenamed("print", "asked"), "asked").join(_read(spark, path, "sets"), "print").withColumn("jaccard", X.jaccard(F.col("mine"), F.col("words"))).filter(F.col("jaccard") >= least)
    groups = _read(spark, path, "members").groupBy("print").agg(F.min("id").alias("other"), F.count("*").alias("copies"))
    found = like.select("asked", "print", "jaccard").join(groups, "print")
    return own.select("id", F.col("print").alias("asked")).join(found, "asked").select("id", "other", "jaccard", "copies")
