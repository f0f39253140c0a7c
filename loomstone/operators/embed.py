"""Texts to vectors.  Sparse rows (id, bucket, value) keep the work in hash aggregates; dense arrays are built on demand."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T
from ..functions.words import EMBED_STOP
from .shared import lean, sliced, spread

IDENTIFIER = re.compile("[a-z_][a-z0-9_]*")


def _unit(rows: DataFrame, value: Column) -> DataFrame:
    """Rows (id, bucket, value) scaled to length 1 per id; an id has at most one row per bucket."""
    own = Window.partitionBy("id")
    return rows.groupBy("id", "bucket").agg(F.sum(value).alias("v")).withColumn("n", F.sqrt(F.sum(F.col("v") * F.col("v")).over(own))).filter("v <> 0").select("id", "bucket", (F.col("v") / F.col("n")).alias("value"))


def hashed_tf(docs: DataFrame, id: str, text: str, dim: int = 384, remembered: int = 1 << 16) -> DataFrame:
    """Term frequencies hashed into `dim` buckets; texts without tokens have no rows (the zero vector).

    A text's buckets depend on that text alone, so nothing is shuffled: texts are read
    in Arrow batches, and md5 is taken once for each of the last `remembered` tokens.
    The number of a text's tokens divides out in the unit vector.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.lower(F.col(text)), F.lit("")).alias("text"))
    rows, stop = spread(rows), frozenset(EMBED_STOP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = lru_cache(remembered)(lambda token: int.from_bytes(hashlib.md5(token.encode()).digest()) % dim)
        for b in (part for batch in batches for part in sliced(batch, "text")):
            at, buckets, values = [], [np.zeros(0, np.int64)], [np.zeros(0)]
            for k, t in enumerate(b.column("text").to_pylist()):
                counts = Counter(IDENTIFIER.findall(t))
                own = [(bucket(x), n) for x, n in counts.items() if len(x) > 1 and x not in stop]
                if own:
                    v = np.bincount([x for x, _ in own], [n for _, n in own], dim)
                    buckets.append(np.flatnonzero(v))
                    values.append(v[buckets[-1]] / np.sqrt((v * v).sum()))
                    at += [k] * len(buckets[-1])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), pa.array(np.concatenate(buckets)), pa.array(np.concatenate(values))], ["id", "bucket", "value"])

    return rows.mapInArrow(lean(run), K.StructType([rows.schema["id"], K.StructField("bucket", K.LongType()), K.StructField("value", K.DoubleType())]))


def hashed_grams(docs: DataFrame, id: str, text: str, dim: int = 384, low: int = 1, high: int = 2) -> DataFrame:
    """Signed character n-grams hashed into `dim` buckets."""
    grams = docs.select(F.col(id).alias("id"), F.explode(T.char_grams(F.col(text), low, high)).alias("g")).groupBy("id", "g").agg(F.count("*").alias("c"))
    return _unit(grams.withColumn("bucket", T.bucket(F.col("g"), dim)), F.col("c") * T.sign(F.col("g")))


def dense(sparse: DataFrame, dim: int = 384) -> DataFrame:
    """Rows (id, vector) from (id, bucket, value)."""
    at = F.map_from_entries(F.collect_list(F.struct("bucket", "value")))
    return sparse.groupBy("id").agg(at.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0)).cast("float")).alias("vector"))


EMBEDDERS = {"tfidf": hashed_tf, "hash": hashed_grams}


def embedder(method: str = "tfidf"):
    """An embedder by name; unknown names fall back to hashed_tf."""
    return EMBEDDERS.get(method, hashed_tf)
