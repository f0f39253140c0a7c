"""Ranking quality.  runs: (query_id, rank, item_id), ranks from 1; qrels: (query_id, item_id, relevance)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts
from .windows import numbered

KS = (1, 3, 5, 10)


def _parts(*tables: DataFrame) -> int:
    """Partitions for some hundred thousand rows each: what a task sorts or counts doesn't grow with the table."""
    return max(parts(d, 1) for d in tables)


def judged(runs: DataFrame, qrels: DataFrame, threshold: float = 0.5, by_query: bool = False) -> DataFrame:
    """runs with rel (0 where unknown) and hit; by_query: dealt out by query_id, for what is computed of each query."""
    n, key = _parts(runs, qrels), ["query_id", "item_id"]
    j = runs.repartition(n, *key).join(qrels.repartition(n, *key), key, "left").select("query_id", "rank", "item_id", F.coalesce("relevance", F.lit(0.0)).alias("rel"), (F.coalesce("relevance", F.lit(0.0)) >= threshold).alias("hit"))
    return j.repartition(n, "query_id") if by_query else j


def relevant(qrels: DataFrame, threshold: float = 0.5) -> DataFrame:
    return qrels.groupBy("query_id").agg(F.count_if(F.col("relevance") >= threshold).alias("relevant"))


def at_k(runs: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = KS, threshold: float = 0.5) -> DataFrame:
    """Rows (query_id, k, recall, precision, f1, dcg, ndcg) of every query of qrels.

    precision divides by what was retrieved up to k, not by k; nothing retrieved,
    or nothing relevant, gives 0.  Repeated items count once in recall.  All ks are
    counted in one row of a query, and are rows of their own at the end only.
    """
    n, top = _parts(runs, qrels), max(ks)
    once = Window.partitionBy("query_id", "item_id").orderBy(F.desc("hit"), "rank")
    j = judged(runs.filter(F.col("rank") <= top), qrels, threshold).select("query_id", "rank", "rel", "hit", (F.col("hit") & (F.row_number().over(once) == 1)).alias("new"))
    upto = lambda place, k, x: F.when(F.col(place) <= k, x)
    got = j.repartition(n, "query_id").groupBy("query_id").agg(*(c for k in ks for c in (
        F.count_if(F.col("new") & (F.col("rank") <= k)).alias(f"found{k}"),
        F.avg(upto("rank", k, F.col("hit").cast("double"))).alias(f"precision{k}"),
        F.sum(upto("rank", k, F.col("rel") / F.log2(F.col("rank") + 1))).alias(f"dcg{k}"),
    )))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance"), "item_id")
    best = qrels.repartition(n, "query_id").withColumn("r", F.row_number().over(order)).groupBy("query_id").agg(F.count_if(F.col("relevance") >= threshold).alias("relevant"), *(F.sum(upto("r", k, F.col("relevance") / F.log2(F.col("r") + 1))).alias(f"idcg{k}") for k in ks))
    each = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{c}{k}").alias(c) for c in ("found", "precision", "dcg", "idcg"))) for k in ks))
    rows = best.join(got, "query_id", "left").select("query_id", "relevant", F.inline(each))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    recall = zero(F.when(F.col("relevant") > 0, F.col("found") / F.col("relevant")))
    p = zero(F.col("precision"))
    out = rows.select("query_id", "k", recall.alias("recall"), F.when(F.col("relevant") > 0, p).otherwise(0.0).alias("precision"), zero(F.col("dcg")).alias("dcg"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"))
    return out.withColumn("f1", zero(F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))))


def whole_list(runs: DataFrame, qrels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows (query_id, mrr, ap): reciprocal rank of the first hit; average precision over all relevant items."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = judged(runs, qrels, threshold, by_query=True).withColumn("hits", F.sum(F.col("hit").cast("int")).over(order))
    got = j.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit"), F.col("hits") / F.col("rank"))).alias("s"))
    return relevant(qrels.repartition(_parts(runs, qrels), "query_id"), threshold).join(got, "query_id", "left").select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.when(F.col("relevant") > 0, F.col("s") / F.col("relevant")), F.lit(0.0)).alias("ap"))


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Mean of every metric column over queries."""
    names = [c for c in metrics.columns if c not in ("query_id", *by)]
    return metrics.groupBy(*by).agg(*(F.avg(c).alias(c) for c in names))


def latency(samples: DataFrame, group: str, value: str) -> DataFrame:
    """p50, p95 and p99 by index into the sorted values (p99: the greatest of under 100), mean, least and greatest.  Samples are numbered over all groups, so no group is one task or one list."""
    ranked = numbered(samples.filter(F.col(value).isNotNull()).select(group, value), "nth", F.col(group), F.col(value))
    whole = ranked.groupBy(group).agg(F.count("*").alias("runs"), F.min("nth").alias("start"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    at = lambda p: F.max(F.when(F.col("nth") - F.col("start") == F.floor(F.col("runs") * p), F.col(value)))
    picked = ranked.join(whole.select(group, "start", "runs"), group).groupBy(group).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return whole.join(picked, group).select(group, "runs", "p50", "p95", F.when(F.col("runs") >= 100, F.col("p99")).otherwise(F.col("greatest")).alias("p99"), "mean", "least", "greatest")
