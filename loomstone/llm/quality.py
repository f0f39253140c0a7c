"""Quality rules: base rules on words and lines, and an isolation forest on rule statistics.

Statistics of whole texts come from whole-array operations over bytes; a text is
read once and nothing is shuffled.  The forest isolates points by random splits;
documents with short mean paths are anomalous.  It is grown on a bounded,
documented sample of labelled rows, and its threshold is the one that finds most
rows of label 0 while it rejects at most `most_lost` of those of label 1.  Every
document is scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import spread
from . import tokens as tk
from .sample import labelled
from .shared import text_bytes

LINE = tk._table("\n")
SYMBOLS = tk._table("#*$%&|<>")
UPPER = tk._table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTER = UPPER | tk._table("abcdefghijklmnopqrstuvwxyz")
STRANGE = tk._table("".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"))
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of set bytes of each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS of each text, and the forest's features.

    n_dup_lines: lines with a word that equal an earlier line of the text, byte
    for byte.  n_repeat_words: words that lie in a window of five words found
    twice or more in the text.  A null or empty text has zeros.
    """
    w = tk.words(column)
    n, words = len(column), w.counts
    h = w.hashes()
    lead = (w.buf & 0xC0) != 0x80
    chars = per_row(lead & ~tk.SPACE[w.buf], w.bounds)
    symbols = per_row(SYMBOLS[w.buf], w.bounds)

    starts, ends = tk.spans(w.buf, w.bounds, LINE)
    full = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[full], ends[full]
    row = np.searchsorted(w.bounds, starts, "right") - 1
    key = tk.combine(row.astype(tk.U64), tk.hash_spans(w.buf, starts, ends))
    by = np.argsort(key, kind="stable")
    lines = np.bincount(row, minlength=n)
    dup_lines = lines - np.bincount(row[by[tk.runs(key[by])]], minlength=n)

    repeats, unique = np.zeros(n, np.int64), np.zeros(n, np.int64)
    same = np.zeros(n, np.int64)
    if len(h):
        key = tk.combine(w.row.astype(tk.U64), h)
        by = np.argsort(key)
        unique = np.bincount(w.row[by[tk.runs(key[by])]], minlength=n)
        same = np.bincount(w.row[1:][(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])], minlength=n)
    if len(h) >= WINDOW:
        m = len(h) - WINDOW + 1
        at = np.flatnonzero(w.row[:m] == w.row[WINDOW - 1 :])
        key = w.row[at].astype(tk.U64)
        for k in range(WINDOW):
            key = tk.combine(key, h[at + k])
        by = np.argsort(key)
        first = tk.runs(key[by])
        size = np.diff(first, append=len(by))
        twice = at[by[np.repeat(size > 1, size)]]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + WINDOW, -1)
        repeats = np.bincount(w.row[np.cumsum(cover[:-1]) > 0], minlength=n)

    counts = np.stack([words, chars, symbols, dup_lines, repeats], axis=1).astype(np.int64)
    some, letters = np.maximum(words, 1), np.maximum(per_row(LETTER[w.buf], w.bounds), 1)
    features = np.stack(
        [
            np.minimum(symbols / some, 1.0), np.minimum(per_row(STRANGE[w.buf], w.bounds) / some, 1.5), per_row(UPPER[w.buf], w.bounds) / letters,
            dup_lines / np.maximum(lines, 1), repeats / some, same / some,
            np.minimum(chars / some, 30), unique / some ** 0.8,
        ],
        axis=1,
    )
    return counts, features


def depth_of(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays [tree, node]: feature (-1: leaf), split, left child (the right one follows), path length of leaves; norm; threshold: scores from it on are anomalous."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = 2.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / norm): near 1 for points that few splits isolate."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, s, left, path in zip(self.feature, self.split, self.left, self.path):
            node = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                at = node[live]
                live = live[f[at] >= 0]
                at = node[live]
                node[live] = left[at] + (x[live, f[at]] >= s[at])
            total += path[node]
        return 2.0 ** (-total / (len(self.feature) * self.norm)) if len(self.feature) else np.zeros(len(x))


def grow(x: np.ndarray, trees: int = 100, points: int = 256, seed: int = 17) -> Forest:
    """Each tree isolates a random subset of at most `points` rows by random splits, to a depth of log2(points)."""
    rng = np.random.default_rng(seed)
    points = min(points, len(x))
    if points < 2:
        empty = np.zeros((0, 1))
        return Forest(empty.astype(int), empty, empty.astype(int), empty, 1.0)
    deepest = math.ceil(math.log2(points))
    width = 2 ** (deepest + 1)
    feature, split = np.full((trees, width), -1), np.zeros((trees, width))
    left, path = np.zeros((trees, width), int), np.zeros((trees, width))
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), points, replace=False)], 0)], 1
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            open_ = np.flatnonzero(high > low)
            if depth == deepest or not len(open_):
                path[t, node] = depth + depth_of(len(own))
                continue
            f = int(rng.choice(open_))
            s = float(rng.uniform(low[f], high[f]))
            s = s if s > low[f] else float(high[f])
            feature[t, node], split[t, node], left[t, node] = f, s, used
            right = own[:, f] >= s
            todo += [(used, own[~right], depth + 1), (used + 1, own[right], depth + 1)]
            used += 2
    return Forest(feature, split, left, path, float(depth_of(points)))


def calibrated(forest: Forest, x: np.ndarray, y: np.ndarray, most_lost: float) -> Forest:
    """The lowest threshold at which at most `most_lost` of the rows of label 1 are anomalous; without such rows nothing is."""
    s = forest.scores(x)
    good = np.sort(s[y == 1])[::-1]
    threshold = 2.0
    if len(good) and len(forest.feature):
        threshold = float(np.nextafter(good[min(len(good) - 1, int(most_lost * len(good)))], 2.0))
    return Forest(forest.feature, forest.split, forest.left, forest.path, forest.norm, threshold)


def failing(counts: np.ndarray) -> np.ndarray:
    """Base rules: under 10 words, or over 20 of 100 words in repeated windows."""
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


def with_background(x: np.ndarray, every: np.ndarray, share: float, seed: int) -> np.ndarray:
    """x, and a share of points spread evenly over the ranges that `every` has.

    Rows of label 1 hardly vary in most statistics, and a constant one is never
    split; the background gives every statistic its splits.
    """
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    return np.concatenate([x, rng.uniform(every.min(0), every.max(0), (math.ceil(share * len(x)), x.shape[1]))])


def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, "text"):
            counts, x = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("y"), part.column("grown"), pa.array(failing(counts)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "grown", "failed", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, trees: int = 100, points: int = 256, most_lost: float = 0.002, share: float = 0.05, seed: int = 17) -> Forest:
    """A forest grown on half of the sampled rows of label 1 (of all, if there are none) and a background, calibrated on the other half, as far as they pass the base rules.

    A half without rows is stood in for by the whole.  per_class: at most so many labelled documents of either label are read for it;
    their statistics, a few numbers each, are what the driver gets.  Without any
    such row the forest is empty and finds nothing anomalous.
    """
    rows, _ = labelled(docs, labels, "quality", per_class, seed)
    half = F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")).bitwiseAND(1) == 0
    got = rows.select("y", "text", half.alias("grown")).mapInArrow(tk.lean(features_of), "y int, grown boolean, failed boolean, x array<double>").filter("not failed").collect()
    got.sort(key=lambda r: (r.y, r.grown, r.x))
    if not got:
        return grow(np.zeros((0, 1)))
    x, y, grown = np.array([r.x for r in got]), np.array([r.y for r in got], int), np.array([r.grown for r in got])
    good = y == 1 if (y == 1).any() else np.ones(len(y), bool)
    own = good & grown if (good & grown).any() else good
    rest = ~grown if (~grown & (y == 1)).any() else np.ones(len(y), bool)
    return calibrated(grow(with_background(x[own], x[grown] if grown.any() else x, share, seed), trees, points, seed), x[rest], y[rest], most_lost)


def judged(docs: DataFrame, forest: Forest, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row per row of docs: `keep`, the five counts, base_failed, anomaly (0 to 1), kept.

    base_failed: under 10 words, or over 20 of 100 words in repeated windows; null
    and empty texts fail.  kept: neither base_failed nor anomalous.  Repeated rows
    are judged alike; other columns are not read.
    """
    rows = spread(docs.select(*(F.col(f"`{c}`") for c in keep), text_bytes(text).alias("__text")))
    names = [*keep, *COUNTS, "base_failed", "anomaly", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                counts, x = statistics(part.column("__text"))
                failed = failing(counts)
                s = forest.scores(x)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(s), pa.array(~failed & (s < forest.threshold))], names)

    kinds = [T.LongType()] * 5 + [T.BooleanType(), T.DoubleType(), T.BooleanType()]
    out = T.StructType([*(f for f in rows.schema.fields if f.name in keep), *(T.StructField(n, k) for n, k in zip(names[len(keep) :], kinds))])
    return rows.mapInArrow(tk.lean(run), out)
