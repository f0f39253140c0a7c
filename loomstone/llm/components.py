"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def _large(e: DataFrame) -> DataFrame:
    """Every node hangs its larger neighbours on the least of its neighbours and itself.

    The least ones are written first: the join then reads two tables, and Spark can
    split the edges of a node that very many have.
    """
    both = e.union(e.select("b", "a"))
    least = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node hangs its smaller neighbours and itself on the least of them; edges have a < b."""
    least = checkpointed(e.groupBy("b").agg(F.min("a").alias("m")))
    moved = e.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a != b")
    return moved.union(least.select("m", "b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Rows (node, root): each node of an edge but the roots, with the smallest node of its component.

    edges: columns a and b of one ordered type, not null; loops and repeated or
    reversed edges are allowed.  A round hangs nodes on smaller ones by sums over
    edges and joins; rounds grow with the logarithm of the longest chain.  Edges
    are written to the shared folder each round; the driver sees two numbers.
    """
    e = checkpointed(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = now
        e = checkpointed(_small(_large(e)))
