"""One document of each group of copies: SimHash and MinHash bands, then the exact similarity of five-word shingles.

Two texts are copies if the sets of their runs of SHINGLE words have a Jaccard
similarity of SIMILAR or more; a shorter text is one run.  Candidates are linked by
their SimHash fingerprints (simhash.near_duplicates, as op7 links them), or share a
band, for most texts at SIMILAR differ in more bits than SimHash can tell: ROWS equal least hashes of BANDS * ROWS: a pair at similarity 0.8 shares
none with a probability of (1 - 0.8 ** 4) ** 24, about 3 in a million, closer
pairs more rarely.  Every candidate is verified on whole sets.

Equal texts are one node.  Sets of texts that share a band with another lie in the
shared folder, where the workers map them.  Cells are cut into blocks as in simhash.links, and from a
cell only a spanning forest of its verified links goes on, never all pairs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from . import tokens as tk
from .lm import mapped_bytes
from .components import connected
from .decontam import shingled
from .shared import checkpointed, mounted, row_key, scratch, text_bytes

U64 = tk.U64
SHINGLE = 5
SIMILAR = (4, 5)  # as a fraction, so that the check is exact
BANDS, ROWS = 24, 4
_KEYS = tk.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U64))
FLIPS, FACTORS = _KEYS[: BANDS * ROWS], _KEYS[BANDS * ROWS :] | U64(1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of words of a binary column in the order of its rows, where each row's begin, and the rows that have words."""
    w = tk.words(column, lower=True)
    h, n = w.hashes(), w.counts
    long = shingled(h, SHINGLE)
    at = np.flatnonzero(w.row[: len(long)] == w.row[len(h) - len(long) :]) if len(long) else np.zeros(0, np.int64)
    row, s = w.row[at], long[at]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.array([shingled(h[w.first[r] : w.first[r + 1]], int(n[r]))[0] for r in short], U64)
        row, s = np.concatenate([row, short]), np.concatenate([s, tk.combine(own, n[short].astype(U64))])
        by = np.argsort(row, kind="stable")
        row, s = row[by], s[by]
    starts = tk.runs(row)
    return s, starts, row[starts]


def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (cell, node) for each band of each text with words."""
    for batch in batches:
        for part in tk.slices(batch, "__text"):
            s, starts, rows = shingles(part.column("__text"))
            if not len(rows):
                continue
            node = part.column("__node").to_numpy()[rows]
            cells = []
            for b in range(BANDS):
                cell = np.full(len(rows), b + 1, U64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    cell = tk.combine(cell, np.minimum.reduceat((s ^ FLIPS[k]) * FACTORS[k], starts))
                cells.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.tile(node, BANDS))], ["cell", "node"])


def stored(path: str):
    """For mapInArrow over texts: writes their sets; a row (node, file, start, size) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at = uuid.uuid4().hex, 0  # a task that runs twice leaves a file that no row names
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                s, starts, rows = shingles(part.column("__text"))
                if not len(rows):
                    continue
                of = np.repeat(np.arange(len(rows)), np.diff(starts, append=len(s)))
                by = np.lexsort((s, of))
                by = by[tk.runs(of[by], s[by])]
                size = np.bincount(of[by], minlength=len(rows))
                with open(f"{path}/{name}", "ab") as f:
                    s[by].tofile(f)
                yield pa.RecordBatch.from_arrays([part.column("__node").take(pa.array(rows)), pa.array([name] * len(rows)), pa.array(at + np.cumsum(size) - size), pa.array(size)], ["node", "file", "start", "size"])
                at += len(by)

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Values that two ascending arrays without repetitions share."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of similar sets that connect all that similar pairs connect."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable").tolist()
    top, out = list(range(len(sets))), []

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    p, q = SIMILAR
    for d in range(1, len(order)):
        if len(out) == len(order) - 1:
            break
        for x, y in zip(order, order[d:]):
            m, n = len(sets[x]), len(sets[y])
            if q * m >= p * n and (a := root(x)) != (b := root(y)) and (p + q) * common(sets[x], sets[y]) >= p * (m + n):
                top[max(a, b)] = min(a, b)
                out.append((x, y))
    return out


#: Files of sets that a worker keeps mapped.
MOST_FILES = 512


def verified(path: str):
    """For mapInArrow over rows (cell, i, j, node, file, start, size) sorted by the first three: edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, np.ndarray] = {}

        def own(row: tuple) -> np.ndarray:
            *_, name, start, size = row
            if name not in files:
                if len(files) >= MOST_FILES:  # what a group still needs stays mapped
                    files.clear()
                files[name] = mapped_bytes(f"{path}/{name}").view(U64)
            return files[name][start : start + size]

        def edges(group: list[tuple]) -> pa.RecordBatch:
            rows = list({r[3]: r for r in group}.values())
            found = forest([own(r) for r in rows]) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([rows[x][3] for x, _ in found], pa.int64()), pa.array([rows[y][3] for _, y in found], pa.int64())], ["a", "b"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    yield edges(group)
                    group = []
                group.append(row)
        if group:
            yield edges(group)

    return run


def by_simhash(texts: DataFrame) -> DataFrame:
    """(cell, node): a cell for each component of fingerprints that SimHash links; texts without words have no set and go below."""
    prints = checkpointed(simhash.fingerprints(texts, ("__node",), "__text").distinct())
    return simhash.near_duplicates(prints, "__node").select(F.xxhash64(F.lit("simhash"), "root").alias("cell"), F.col("__node").alias("node"))


def links(texts: DataFrame, most: int = 512) -> DataFrame:
    """Edges (a, b) that connect every pair of candidates that are copies.  texts: __node (long), __text (bytes); equal nodes have equal words."""
    cell = checkpointed(texts.mapInArrow(tk.lean(banded), "cell long, node long").union(by_simhash(texts)).distinct())
    met = cell.groupBy("cell").count().filter("count > 1").select("cell", F.ceil(F.col("count") / most).cast("int").alias("blocks"))
    cell = checkpointed(cell.join(met, "cell"))
    path = mounted(scratch(texts.sparkSession, "copies"))
    os.makedirs(path)
    # equal texts are one row of each task before they are dealt out
    own = texts.dropDuplicates(["__node"]).join(cell.select(F.col("node").alias("__node")).distinct(), "__node", "left_semi")
    sets = checkpointed(own.mapInArrow(tk.lean(stored(path)), "node long, file string, start long, size long"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda d: F.struct(F.least(block, d).alias("i"), F.greatest(block, d).alias("j")))
    dealt = cell.select("cell", "node", F.explode(pairs).alias("p")).join(sets, "node").select("cell", "p.i", "p.j", "node", "file", "start", "size")
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(tk.lean(verified(path)), "a long, b long")


def one_each(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component of copies, unchanged: of the smallest id, of its texts the one with the least hash.

    Words are `[^\\x20\\x09-\\x0D]+` of the text lower-cased A-Z; texts without words
    are copies of one another.  Null ids are larger than any other.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hashed = docs.withColumn("__h", F.xxhash64(whole)).withColumn("__node", F.when(whole.rlike(r"[^\x20\x09-\x0D]"), F.col("__h")).otherwise(F.xxhash64(F.lit(""))))
    tree = connected(links(hashed.select("__node", text_bytes(text).alias("__text"))))
    order = F.struct(F.col(f"`{id}`").isNull().alias("none"), F.col(f"`{id}`").alias("id"), F.col("__h").alias("h"))
    nodes = hashed.groupBy("__node").agg(F.min(order).alias("o")).join(tree, F.col("__node") == F.col("node"), "left")
    picked = nodes.groupBy(F.coalesce("root", "__node")).agg(F.min("o").alias("p")).select(row_key(F.col("p.id"), F.col("p.h")).alias("__k")).distinct()
    out = hashed.withColumn("__k", row_key(F.col(f"`{id}`"), F.col("__h"))).join(picked, "__k", "left_semi")
    nth = F.row_number().over(Window.partitionBy("__k").orderBy("__h"))  # rows that repeat whole
    return out.withColumn("__nth", nth).filter("__nth = 1").select(*(F.col(f"`{c}`") for c in docs.columns))
