"""Bounded samples of labelled rows, the same at every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, text_bytes


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most per_class labelled ids of class 0 and of class 1, in the order of a seeded hash, with their texts; and the rows of each class in `labels`.

    Columns doc_id, y, text (bytes).  Labels other than 0 and 1, null ids and
    repeated equal rows are left out; an id with both labels counts for both, and of
    documents that share an id the least text counts.  At most 2 * per_class ids are
    broadcast, and no more rows come back; only their texts are shuffled.
    """
    rows = labels.select("doc_id", F.col(f"`{label}`").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null").distinct()
    held = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    by = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    ids = rows.filter("y = 0").orderBy(by, "doc_id").limit(per_class).union(rows.filter("y = 1").orderBy(by, "doc_id").limit(per_class))
    found = docs.select("doc_id", text_bytes(text).alias("text")).join(F.broadcast(ids), "doc_id")
    return checkpointed(found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))), {k: held.get(k, 0) for k in (0, 1)}
