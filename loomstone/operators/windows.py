"""Ordered computations: prefixes, tiers, batches, windows of time, segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held


def newest(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group: a working memory of capacity n."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return rows.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= n).drop("__nth")


def first_n(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("__nth", F.row_number().over(w)).filter(F.col("__nth") <= n).drop("__nth")


def batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """batch: whole batches of `size` rows in order; an incomplete last one has complete = false."""
    w = Window.partitionBy(group).orderBy(order)
    out = rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))
    return out.withColumn("complete", F.count("*").over(Window.partitionBy(group, "batch")) == size)


def oldest_share(rows: DataFrame, group: str, order: str, ratio: float) -> DataFrame:
    """flush: whether a row is among the floor(n * ratio) oldest of its group."""
    w = Window.partitionBy(group)
    return rows.withColumn("flush", F.row_number().over(w.orderBy(order)) <= F.floor(F.count("*").over(w) * ratio))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds a number from 1 in a total order: rows are sorted by ranges, and the sizes of the ranges before, as many rows as there are partitions, are added."""
    ranges = held(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    upto = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("__p").agg(F.count("*").alias("n")).select("__p", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return ranges.withColumn("__nth", nth).join(F.broadcast(before), "__p").withColumn(name, F.col("__nth") + F.col("__before")).drop("__p", "__nth", "__before")


def until_known(rows: DataFrame, known: str, *order: str, descending: tuple[str, ...] = ()) -> DataFrame:
    """Rows before the first known one in the order of these columns: its place is one aggregate, and the others are compared with it."""
    if not order:
        raise ValueError("an order is needed")
    best = [F.col(c) for c in order]
    first = rows.filter(F.col(known)).orderBy(*(F.desc(c) if c in descending else F.asc(c) for c in order)).limit(1).select(*(c.alias(f"__{n}") for c, n in zip(best, order)))
    before, same = F.lit(False), F.lit(True)
    for c in order:
        mine, its = F.col(c), F.col(f"__{c}")
        before = before | (same & ((mine > its) if c in descending else (mine < its)))
        same = same & (mine == its)
    return rows.join(F.broadcast(first), how="left", on=F.lit(True)).filter(F.col(f"__{order[0]}").isNull() | before).drop(*(f"__{c}" for c in order))


def within_budget(rows: DataFrame, group: str, size: Column, budget: int, *order: Column) -> DataFrame:
    """The longest prefix of each group whose sizes sum up to `budget` at most; upto: the running sum."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(size).over(w)).filter(F.col("upto") <= budget)


def anchored_windows(rows: DataFrame, group: str, stamp: str, id: str, hours: float) -> DataFrame:
    """window: 0, 1, ... per group; a window opens at a row more than `hours` after the first row of the one before.

    Where a window opens depends on the one before, so a group's sorted rows are
    walked in one stream of Arrow batches; of a group only the open window is held.
    """
    span = int(hours * 3600 * 1_000_000)
    own = rows.select(F.col(group).alias("g"), F.unix_micros(F.col(stamp).cast("timestamp")).alias("t"), F.col(id).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, window = object(), 0, 0
        for b in batches:
            out = []
            for g, t in zip(b.column("g").to_pylist(), b.column("t").to_pylist()):
                if g != now:
                    now, start, window = g, t, 0
                elif t is not None and (start is None or t - start > span):
                    start, window = t, window + (start is not None)
                out.append(window)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("id"), pa.array(out, pa.int32())], [group, id, "window"])

    kinds = T.StructType([T.StructField(group, rows.schema[group].dataType), T.StructField(id, rows.schema[id].dataType), T.StructField("window", T.IntegerType())])
    return own.repartition("g").sortWithinPartitions("g", "t", "id").mapInArrow(run, kinds)


def consolidated(rows: DataFrame, keys: list[str], content: str, importance: str, kind: str, id: str, order: str, least: int = 4) -> DataFrame:
    """Groups of at least `least` rows merged: count, greatest importance, the kind of the most important, ids, the first five contents cut to 200."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(order, id))
    one = F.struct(F.col(order).alias("o"), F.col(id).alias("id"))
    first = F.when(F.col("__nth") <= 5, F.struct("__nth", F.left(F.col(content), F.lit(200)).alias("c")))
    got = rows.withColumn("__nth", nth).groupBy(*keys).agg(F.count("*").alias("merged_count"), F.max(importance).alias("importance"), F.max_by(kind, F.struct(F.col(importance), -F.col(id))).alias("kind"), F.array_sort(F.collect_list(one)).alias("all"), F.array_sort(F.collect_list(first)).alias("first"))
    lines = F.transform("first", lambda x: F.concat(F.lit("- "), x["c"]))
    text = F.concat(F.lit("Consolidated memory ("), F.col("merged_count").cast("string"), F.lit(" items):\n"), F.array_join(lines, "\n"))
    return got.filter(F.col("merged_count") >= least).select(*keys, "merged_count", "importance", "kind", F.transform("all", lambda x: x["id"]).alias("ids"), text.alias("content"))


def segments(rows: DataFrame, id: str, tokens: str, size: int, overlap: int, padding: int = 0) -> DataFrame:
    """Rows (id, segment, start_pos, end_pos, tokens): overlapping segments, the last ones padded to `size`."""
    n, step = F.size(tokens), size - overlap
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    out = rows.select(id, F.col(tokens).alias("t"), n.alias("n"), F.posexplode(starts).alias("segment", "start_pos"))
    own = F.slice(F.col("t"), F.col("start_pos") + 1, F.lit(size))
    return out.select(id, "segment", "start_pos", F.least(F.col("start_pos") + size, F.col("n")).alias("end_pos"), F.concat(own, F.array_repeat(F.lit(padding).cast(dict(rows.dtypes)[tokens][6:-1]), size - F.size(own))).alias("tokens"))


def joined_segments(segments: DataFrame, id: str, overlap: int) -> DataFrame:
    """The tokens of segments in order without what each repeats of the one before, and without padding."""
    own = F.slice("tokens", F.when(F.col("segment") > 0, overlap + 1).otherwise(1), F.greatest(F.col("end_pos") - F.col("start_pos") - F.when(F.col("segment") > 0, overlap).otherwise(0), F.lit(0)))
    rows = segments.select(id, F.struct("segment", own.alias("t")).alias("s"))
    return rows.groupBy(id).agg(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"])).alias("tokens"))


def segment_count(length: Column, size: int, overlap: int) -> Column:
    return F.floor((length + (size - overlap - 1)) / (size - overlap))


def flops_ratio(length: Column, size: int, overlap: int) -> Column:
    """Cost of full attention over that of segments; 1 for nothing."""
    own = segment_count(length, size, overlap) * (size * size)
    return F.when(own > 0, length.cast("double") * length / own).otherwise(1.0)


def injected(segments: DataFrame, id: str, memory: int) -> DataFrame:
    """Adds input: a segment's tokens after the last `memory` tokens of what came before it, which its predecessors carried on."""
    w = Window.partitionBy(id).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("end_pos") - F.col("start_pos")  # without padding
    ends = F.slice("tokens", F.greatest(size - memory + 1, F.lit(1)), F.least(size, F.lit(memory)))
    carried = F.flatten(F.collect_list(ends).over(w.rowsBetween(-memory, -1)))  # a segment has a token at least
    last = F.slice(carried, F.greatest(F.size(carried) - memory + 1, F.lit(1)), F.lit(memory))
    return segments.withColumn("input", F.concat(last, F.col("tokens")))


def curriculum(rows: DataFrame, length: str, stages: int = 5, first: int = 512, segment: int = 512, most: int = 2048, rates: tuple[float, float] = (1e-4, 1e-5)) -> DataFrame:
    """(stage, length, segment, rate, n): lengths that grow from `first` to the longest row's by one factor, segments that double every other stage, a rate that falls evenly; n rows are first trained on in that stage.

    Rows find their stage by the lengths, which are a literal array: one pass for the longest, one for the counts.
    """
    longest = max(first, rows.agg(F.max(length)).first()[0] or 0)
    steps = max(1, stages - 1)
    lengths = [int(first * (longest / first) ** (i / steps) + 1e-6) for i in range(stages)]
    at = F.size(F.filter(F.array(*map(F.lit, lengths)), lambda x: x < F.col(length)))
    counts = rows.filter(F.col(length).isNotNull()).groupBy(at.cast("long").alias("stage")).agg(F.count("*").alias("n"))
    plan = rows.sparkSession.range(stages).select(F.col("id").alias("stage"), F.element_at(F.array(*map(F.lit, lengths)), (F.col("id") + 1).cast("int")).cast("long").alias("length"))
    i = F.col("stage")
    plan = plan.withColumns({"segment": F.least(segment * F.pow(F.lit(2), F.floor(i / 2)).cast("int"), F.lit(most)), "rate": F.round(rates[0] * (1 - i / steps) + rates[1] * (i / steps), 9)})
    return plan.join(F.broadcast(counts), "stage", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def ema(rows: DataFrame, group: str, value: str, *order: Column, keep: float = 0.7) -> DataFrame:
    """(group, ema): exponential moving average from 0 of each group's values in a total order; null values are left out.

    n values x turn an average a into keep ** n * a + (1 - keep) * sum(keep ** (values after x) * x).
    Such maps compose, so rows are sorted by ranges of (group, order), each range of a group
    makes one map, and a group is composed of as many as it has ranges: one that
    holds most rows is the work of many tasks.
    """
    own = rows.filter(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__x"), *(c.alias(f"__o{k}") for k, c in enumerate(order)))
    by = [F.col(f"__o{k}") for k in range(len(order))]
    ranges = own.repartitionByRange(F.col("__g"), *by).withColumn("__p", F.spark_partition_id())
    last = Window.partitionBy("__p", "__g").orderBy(*(c.desc() for c in by))
    each = ranges.withColumn("__after", F.row_number().over(last) - 1).groupBy("__g", "__p").agg(F.count("*").alias("__n"), F.sum((1 - keep) * F.pow(F.lit(keep), F.col("__after")) * F.col("__x")).alias("__b"))
    later = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("__later", later).groupBy(F.col("__g").alias(group)).agg(F.sum(F.pow(F.lit(keep), F.col("__later")) * F.col("__b")).alias("ema"))
