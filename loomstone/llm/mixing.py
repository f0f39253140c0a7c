"""Mixing sources to target weights by capped water-filling.  DataFrame functions only.

Targets: every source gets its weight's share of the whole, but no more than
`epochs` times its size; what a capped source can't take is dealt out again by
weight until no source is above its cap.  Sizes are summed per source first, so
a hot source is one row by then; a round of water-filling is one aggregate over
that table and brings a few numbers to the driver.

Repetitions: a source with target r times its size is taken floor(r) times
whole; the rest is the beginning of a seeded order of its documents up to the
target, and the one further document that comes nearest to what is missing.  The order's running sums come from two
levels, blocks of a hash of the document and sums within a block, so a hot
source is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, row_key, running

SPACES = "\t\n\u000b\f\r"


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    parts = F.split(F.translate(text.cast("string"), SPACES, " " * len(SPACES)), " ")
    return F.coalesce(F.size(F.filter(parts, lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def by_cycle(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Adds w: the weights of `cycle` in turn, in order of the source by code point, null last.  A row per source."""
    numbered = running(sources, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)})
    return numbered.withColumn("w", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("nth") - 1, F.lit(len(cycle))) + 1).cast("int")).cast("double")).drop("nth")


def water_filled(sources: DataFrame, epochs: float) -> DataFrame:
    """sources (source, source_size, w) with target.

    The level is what is left per unit of weight once the sources that it would put
    above their cap are clamped.  Clamping goes in the order of cap over weight, and
    each clamped source raises the level, so running sums of caps and weights in that
    order give the level before each source, and the first source whose cap lies
    above its level ends the clamping: one sort instead of a job a round.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    whole, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    at = running(sources.withColumns({"cap": cap, "ratio": cap / F.col("w")}), [F.col("ratio"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "weights": F.col("w")})
    level = (F.lit(float(whole)) - F.col("caps") + F.col("cap")) / (F.lit(float(weight)) - F.col("weights") + F.col("w"))
    open_ = at.withColumn("level", level).filter(F.col("ratio") > F.col("level"))
    found = open_.agg(F.min(F.struct("ratio", "level"))).first()[0]
    target = cap if found is None else F.least(cap, F.lit(float(found["level"])) * F.col("w"))
    return sources.withColumn("target", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target))


def mixed(docs: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: float = 3.0, seed: int = 7, id: str = "doc_id", text: str = "text", source: str = "source", per_block: int = 4096) -> DataFrame:
    """A row per row of docs: id, source, size (words), source_size, target, copies, taken (copies * size).

    Null sources form one source; a source without words has target 0 and gives nothing.  Null texts
    have size 0.  Rows that are equal in id, text and source are interchangeable; every
    other tie of the seeded order is broken by id and size.  Reruns agree.  No
    document is taken more than ceil(epochs) times; documents without words weigh
    nothing: they are taken as often as their source is whole, and once more where
    the order has them before the cut.  h: the seeded hash of id, text and source.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"), seeded(seed, id, text, source).alias("h"))
    rows = checkpointed(rows)
    sizes = checkpointed(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goals = water_filled(by_cycle(sizes, cycle), epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / per_block)).cast("long"))
    goals = checkpointed(goals)
    few = goals.count() <= 10_000
    # blocks are consecutive parts of the order by h
    block = F.least(F.floor((F.col("h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("blocks")), F.col("blocks") - 1).cast("long")
    placed = per_source(rows, goals.select("source", "blocks"), few).select("id", "source", "size", "h", block.alias("block"))
    inside = placed.groupBy("source", "block").agg(F.sum("size").alias("inside"))
    before = inside.select("source", "block", F.coalesce(F.sum("inside").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "block").orderBy("h", "id", "size"))
    run = F.sum("size").over(Window.partitionBy("source", "block").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    at = placed.withColumns({"run": run, "nth": nth}).alias("x")
    b = before.alias("b")
    at = at.join(b, F.col("x.source").eqNullSafe(F.col("b.source")) & (F.col("x.block") == F.col("b.block"))).select("x.*", (F.col("run") + F.col("before")).alias("upto"))
    at = checkpointed(at.drop("run"))
    # whole documents up to the cut, then the one that comes nearest to what is missing
    first = (F.col("rest") > 0) & (F.col("upto") <= F.col("rest"))
    rest = goals.select("source", "source_size", "target", "whole", "rest")
    got = per_source(at, rest, few).groupBy("source").agg(F.coalesce(F.sum(F.when(first, F.col("size"))), F.lit(0)).alias("got"))
    rest = checkpointed(rest.alias("r").join(got.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source"))).select("r.*", (F.col("rest") - F.col("got")).alias("gap")))
    off = F.abs(F.col("gap") - F.col("size"))
    last = per_source(at, rest, few).filter(~first & (off < F.abs(F.col("gap")))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "block", "nth")).alias("last"))
    rest = rest.alias("r").join(last.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left").select("r.*", "last")
    chosen = F.coalesce((F.col("block") == F.col("last.block")) & (F.col("nth") == F.col("last.nth")), F.lit(False))
    copies = F.col("whole") + F.when(first | chosen, 1).otherwise(0)
    return per_source(at, rest, few).select(F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "h")


def seeded(seed: int, id: str, text: str, source: str) -> Column:
    """A null takes part as text that no id and no source is likely to be: hashes skip nulls."""
    return F.xxhash64(F.lit(seed), *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0null")) for c in (id, text, source)))


def per_source(rows: DataFrame, values: DataFrame, few: bool) -> DataFrame:
    """rows with the values of their source; the table of sources is broadcast if it has few rows."""
    v = (F.broadcast(values) if few else values).withColumnRenamed("source", "__source")
    return rows.join(v, rows.source.eqNullSafe(v["__source"])).drop("__source")


def repeated(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, **how) -> DataFrame:
    """docs, a row for every time that the mix takes it, with copy (1, 2, ...), in place of a column so named.

    Rows with equal id, text and source share what the mix takes of them.  A text crosses the
    network once.
    """
    mix = mixed(docs, id=id, text=text, source=source, seed=seed, **how).filter("copies > 0")
    key = lambda h: row_key(F.col(f"`{id}`"), h)
    # a source takes a document as often as it is whole, or once more: two numbers and how many rows have the larger one
    most = mix.groupBy(key(F.col("h")).alias("__k"), "copies").count().groupBy("__k").agg(F.max(F.struct("copies", "count")).alias("m"), F.min("copies").alias("__less"), F.sum("count").alias("__n"))
    taken = most.select("__k", F.col("m.copies").alias("__most"), F.col("m.count").alias("__many"), "__less", "__n")
    nth = F.row_number().over(Window.partitionBy("__k").orderBy(F.lit(0)))
    out = docs.withColumn("__k", key(seeded(seed, id, text, source))).withColumn("__nth", nth).join(taken, "__k").filter(F.col("__nth") <= F.col("__n"))
    copies = F.when(F.col("__nth") <= F.col("__many"), F.col("__most")).otherwise(F.col("__less"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*(F.col(f"`{c}`") for c in docs.columns if c != "copy"), "copy")
