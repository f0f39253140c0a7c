"""Near-duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint's bits are cut into short segments; sorting the bits of each
segment leaves only how many are set (a unary count), so the number of places
in which two sorted words differ is the Manhattan distance of their bit counts.
It never exceeds the Hamming distance.  The segments form groups; at a distance
of `radius` at most, all but `radius` groups have equal counts, so fingerprints
meet in a grid cell for some choice of the other groups.  Inside a cell the
Manhattan distance is tested first and the Hamming distance after it.  The more
fingerprints there are, the more groups and the smaller cells (fitting).

Equal fingerprints are one node.  A cell with more than `most` nodes is cut into
blocks, and every pair of blocks is a task of its own: nothing is capped.  From
a cell only a spanning forest of its links goes on, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ..operators.shared import spread
from .components import connected
from .shared import checkpointed, row_key, text_bytes
from .tokens import U64, combine, lean, runs

RADIUS = 4
SHINGLE = 4
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of the shingles' XXH64; no words: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    total = np.zeros(64, np.int64)
    m = n - shingle + 1
    for lo in range(0, m, 1 << 16):
        hi = min(m, lo + (1 << 16))
        h = np.fromiter([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[lo:hi].tolist(), (ends[lo + shingle - 1 : hi + shingle - 1] - 1).tolist())], U64, hi - lo)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > m, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and fp (long, the fingerprint's 64 bits) of every row; null texts are empty."""
    rows = spread(docs.select(*(F.col(f"`{c}`") for c in keep), text_bytes(text).alias("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column("__text")), U64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(lean(run), T.StructType([*(f for f in rows.schema.fields if f.name in keep), T.StructField("fp", T.LongType())]))


def embedded(fp: np.ndarray, width: int) -> np.ndarray:
    """Each segment of `width` bits with its set bits moved to its low end."""
    out = np.zeros(len(fp), U64)
    for lo in range(0, 64, width):
        size = min(width, 64 - lo)
        count = np.bitwise_count(fp >> U64(lo) & U64((1 << size) - 1)).astype(U64)
        out |= ((U64(1) << count) - U64(1)) << U64(lo)
    return out


def masks(width: int, groups: int, radius: int) -> list[int]:
    """Bits of every choice of groups - radius groups of segments."""
    if groups <= radius:
        raise ValueError("there must be more groups than the radius")
    segments = [range(lo, min(64, lo + width)) for lo in range(0, 64, width)]
    bits = [sum(1 << b for s in segments[k * len(segments) // groups : (k + 1) * len(segments) // groups] for b in s) for k in range(groups)]
    return [sum(c) for c in combinations(bits, groups - radius)]


def cells(choices: list[int], width: int):
    """For mapInArrow: a row (cell, fp) for every fingerprint and choice of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(U64)
            e = embedded(fp, width)
            cell = np.concatenate([combine(e & U64(m), np.full(len(e), k + 1, U64)) for k, m in enumerate(choices)])
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(np.tile(fp, len(choices)).view(np.int64))], ["cell", "fp"])

    return run


def forest(group: np.ndarray, fp: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked within the runs of equal `group`."""
    n = len(fp)
    starts = runs(group)
    end = np.repeat(np.append(starts[1:], n), np.diff(starts, append=n))
    e = embedded(fp, width)
    top = np.arange(n)
    at, d = np.arange(n), 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        a = at[np.bitwise_count(e[at] ^ e[at + d]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + d]) <= radius]
        x, y = top[a], top[a + d]
        while (x != y).any():
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top != top[top]).any():
                top = top[top]
            x, y = top[x], top[y]
        d += 1
    hung = np.flatnonzero(top != np.arange(n))
    return fp[top[hung]], fp[hung]


def linked(width: int, radius: int):
    """For mapInArrow over rows (cell, i, j, fp) sorted by the first three."""

    def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
        cell, i, j, fp = columns
        group = combine(combine(cell.view(U64), i.astype(U64)), j.astype(U64))
        a, b = forest(group, fp.view(U64), width, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            if not len(columns[0]):
                continue
            last = int(runs(*columns[:3])[-1])
            if last:
                yield edges([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held is not None and len(held[0]):
            yield edges(held)

    return run


#: Compared pairs that cost as much as a row of the grid: 15 ns each against some 3 to 7 microseconds of shuffling and sorting, and 80 bytes of disk.
PAIRS_A_ROW = 200


def chance_pairs(n: int, groups: int, radius: int = RADIUS, width: int = 2) -> float:
    """Pairs of n evenly spread fingerprints that are compared: their segments outside `radius` groups have equal counts, for each choice of groups."""
    equal = sum((math.comb(width, k) / 2**width) ** 2 for k in range(width + 1))
    return math.comb(groups, radius) * n * n / 2 * equal ** (-(-64 // width) * (groups - radius) / groups)


def fitting(n: int, radius: int = RADIUS, width: int = 2) -> int:
    """The number of groups for n fingerprints at which rows of the grid and compared pairs together cost least."""
    return min(range(radius + 2, -(-64 // width) + 1), key=lambda g: math.comb(g, radius) * n + chance_pairs(n, g, radius, width) / PAIRS_A_ROW)


def links(nodes: DataFrame, radius: int = RADIUS, width: int = 2, groups: int | None = None, most: int = 8192) -> DataFrame:
    """Edges (a, b) that connect every pair of distinct fp at `radius` or fewer differing bits, directly or through others so linked.  groups: else fitting the number of nodes."""
    groups = groups or fitting(nodes.count(), radius, width)
    cell = nodes.select("fp").mapInArrow(lean(cells(masks(width, groups, radius), width)), "cell long, fp long")
    cell = checkpointed(cell)
    large = checkpointed(cell.groupBy("cell").count().filter(F.col("count") > most).select("cell", F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda d: F.struct(F.least(block, d).alias("i"), F.greatest(block, d).alias("j")))
    dealt = (
        cell.join(large, "cell", "left")
        .select("cell", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)).alias("p"))
        .select("cell", "p.i", "p.j", "fp")
    )
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(lean(linked(width, radius)), "a long, b long")


def near_duplicates(prints: DataFrame, id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Rows of prints (`id`, fp and others) with component_id, the smallest id that links reach, the own one included, and root, the least fp so reached.

    Empty texts have fingerprint 0 and are linked like any other.  Rows with equal
    fingerprints, repeated rows included, share a component.  Null ids are larger
    than any other; a component of null ids alone has a null id.
    """
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(id).alias("__least")))
    roots = connected(links(nodes.select("fp"), radius))
    # tables that are joined are written first, so that Spark can split what very many rows have: a root, a fingerprint
    nodes = checkpointed(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "__least", F.coalesce("root", "fp").alias("root")))
    least = checkpointed(nodes.groupBy("root").agg(F.min("__least").alias("component_id")))
    return prints.join(checkpointed(nodes.join(least, "root").select("fp", "component_id", "root")), "fp")


def one_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component, unchanged: of the smallest id, of its texts the one with the least hash."""
    hashed = docs.withColumn("__h", F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))
    prints = checkpointed(fingerprints(hashed, (id, "__h"), text))
    pick = F.min(F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("__h").alias("h"))).alias("p")
    picked = near_duplicates(prints, id).groupBy("root").agg(pick).select(row_key(F.col("p.id"), F.col("p.h")).alias("__k")).distinct()
    out = hashed.withColumn("__k", row_key(F.col(f"`{id}`"), F.col("__h"))).join(picked, "__k", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__k").orderBy("__h"))  # rows that repeat whole
    return out.withColumn("__nth", nth).filter("__nth = 1").select(*(F.col(f"`{c}`") for c in docs.columns))


def hexed(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
