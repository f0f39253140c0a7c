"""Benchmark decontamination: SimHash of item-sized windows, Hamming index, exact check.

A window of as many words as an item has is compared by SimHash (64 bits, the
majority over its words' hashes).  Fingerprints are cut into BLOCKS blocks; two
within RADIUS differ by RADIUS // BLOCKS bits at most in some block, so the windows
whose value in some block is near the item's hold every one within RADIUS.  What
is found is verified by the weighted Jaccard similarity of five-word shingles
(least counts over greatest counts), the windows with the most shingles of the
item first, until no further one can be better.

Windows without any shingle of the item have similarity 0, so only windows
that hold one are fingerprinted: nothing that the check would accept is lost.
Running sums over the words' bits, some 65,000 words at a time, make a window two
look-ups; the places of the item's shingles are kept, not the windows, so neither a
long text nor one that repeats an item costs more memory than its words.

The index is written to the shared folder in files of some BLOCK_BYTES of items'
text, sorted arrays that the workers map into memory: what a worker holds and what
is broadcast don't grow with the benchmark.  Documents are read once and never
shuffled.
"""

from __future__ import annotations

import os
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.shared import spread
from . import tokens as tk
from .lm import Sections, section
from .shared import checkpointed, mounted, running, scratch, text_bytes

U64 = tk.U64
SHINGLE = 5
SIMILAR = 0.8
RADIUS = 16
BLOCKS = 8
BLOCK_BYTES = 8 << 20
SIEVE = 1 << 22
SPAN = 1 << 16  # words that are fingerprinted at once


def shingled(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), U64)
    for i in range(k):
        out = tk.combine(out, h[i : i + len(out)])
    return out


def signs(h: np.ndarray) -> np.ndarray:
    """Rows of +1 and -1 for the bits of hashes."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def printed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(U64).ravel()


#: Arrays of a file: words of all items, where an item's begin, fingerprints; shingle hashes with their items; a sieve of them; sizes of shingles; the pickled ids.
KINDS = ((np.uint64, 1), (np.int64, 1), (np.uint64, 1), (np.uint64, 1), (np.int64, 1), (np.int32, 1), (np.uint8, 1), (np.int64, 1), (np.uint8, 1))


def near_values(radius: int, blocks: int) -> np.ndarray:
    """Whether two values of a block are near enough for fingerprints within the radius."""
    values = np.arange(1 << 64 // blocks)
    return np.bitwise_count(values[:, None] ^ values[None, :]) <= radius // blocks


NEAR = near_values(RADIUS, BLOCKS)


def indexed(ids: list, texts: list[bytes]) -> list[np.ndarray]:
    """The arrays of KINDS for these items; items without words are never met."""
    w = tk.words(pa.array(texts, pa.binary()), tk.NOT_ALNUM, lower=True)
    have = np.flatnonzero(w.counts)
    ids, h = [ids[k] for k in have.tolist()], w.hashes()
    first = np.append(w.first[have], len(h))
    prints, keys, of = np.zeros(len(have), U64), [np.zeros(0, U64)], [np.zeros(0, np.int32)]
    for k, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        prints[k] = printed(signs(h[a:b]).sum(axis=0, keepdims=True))[0]
        keys.append(np.unique(sized(h[a:b], min(SHINGLE, b - a))))
        of.append(np.full(len(keys[-1]), k, np.int32))
    keys, of = np.concatenate(keys), np.concatenate(of)
    by = np.argsort(keys, kind="stable")
    starts = tk.runs(keys[by])
    sieve = np.zeros(SIEVE, np.uint8)
    sieve[keys & U64(SIEVE - 1)] = 1
    return [h, first, prints, keys[by][starts], np.append(starts, len(by)), of[by], sieve, np.unique(np.minimum(np.diff(first), SHINGLE)), np.frombuffer(pickle.dumps(ids), np.uint8)]


class Items:
    """A file's items: the arrays of `indexed`."""

    def __init__(self, arrays: list[np.ndarray]):
        self.h, self.first, self.prints, self.keys, self.starts, self.of, self.sieve, self.sizes, self.pickled = arrays

    def words(self, k: int) -> np.ndarray:
        return self.h[self.first[k] : self.first[k + 1]]

    @property
    def ids(self) -> list:
        return pickle.loads(self.pickled.tobytes())


def sized(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the shingles of so many words, apart from those of other sizes."""
    out = shingled(h, size)
    return tk.combine(out, np.full(len(out), size, U64))


def weighted(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    least = sum(min(n, y[s]) for s, n in x.items())
    return least / max(1, len(a) + len(b) - least)


def union(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers in ranges from low to high, both of which ascend."""
    low = np.maximum(low, np.append(0, high[:-1] + 1))
    size = np.maximum(high - low + 1, 0)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def prints_of(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n words that begin at `starts`, which ascend."""
    out, lo = np.empty(len(starts), U64), 0
    while lo < len(starts):
        low = int(starts[lo])
        hi = int(np.searchsorted(starts, low + SPAN, "right"))
        high = min(len(h), int(starts[hi - 1]) + n)
        sums = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(signs(h[low:high]), axis=0, dtype=np.int32, out=sums[1:])
        out[lo:hi] = printed(sums[np.minimum(starts[lo:hi] + n, high) - low] - sums[starts[lo:hi] - low])
        lo = hi
    return out


def best_of(words: np.ndarray, print_: np.uint64, h: np.ndarray, at: np.ndarray, radius: int = RADIUS) -> tuple[float, int] | None:
    """Similarity and first word of the window of a text's words h that is most like an item, if it is like enough.  at: places of the item's shingles in the text, which ascend."""
    n, size = len(words), min(SHINGLE, len(words))
    where = union(np.maximum(at - n + size, 0), np.minimum(at, max(0, len(h) - n)))
    prints = prints_of(h, where, n)
    near, width = np.zeros(len(where), bool), U64(64 // BLOCKS)
    for b in range(BLOCKS):
        value = lambda x: (x >> U64(b) * width & (U64(1) << width) - U64(1)).astype(np.int64)  # noqa: B023, E731
        near |= NEAR[int(value(print_))][value(prints)]
    where = where[near & (np.bitwise_count(prints ^ print_) <= radius)]
    # no window can be more like the item than its number of the item's shingles allows
    mine, held = n - size + 1, np.minimum(n, len(h)) - size + 1
    both = np.minimum(np.searchsorted(at, where + n - size, "right") - np.searchsorted(at, where, "left"), mine)
    most = both / np.maximum(mine + held - both, 1)
    best, own = None, shingled(words, size)
    for k in np.lexsort((where, -most)).tolist():
        if most[k] < SIMILAR or best and (most[k], -where[k]) <= (best[0], -best[1]):
            if most[k] < SIMILAR or most[k] < best[0]:
                break
            continue
        s = weighted(shingled(h[where[k] : where[k] + n], size), own)
        if s >= SIMILAR and (best is None or (s, -where[k]) > (best[0], -best[1])):
            best = s, int(where[k])
    return best


def searched(items: Items, w: tk.Words, h: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(row, item, similarity, first word) of all texts of a column with these words and hashes."""
    rows, at, key = [], [], []
    for size in items.sizes.tolist():
        s = sized(h, size)
        p = np.flatnonzero(items.sieve[s & U64(SIEVE - 1)])
        p = p[w.row[p] == w.row[p + size - 1]]
        k = np.minimum(np.searchsorted(items.keys, s[p]), max(0, len(items.keys) - 1))
        hit = items.keys[k] == s[p] if len(p) else np.zeros(0, bool)
        at.append(p[hit])
        key.append(k[hit])
    at, key = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *key])
    each = items.starts[key + 1] - items.starts[key]
    item = items.of[np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + np.repeat(items.starts[key], each)]
    at = np.repeat(at, each)
    rows = w.row[at]
    by = np.lexsort((at, item, rows))
    rows, item, at = rows[by], item[by], at[by]
    cuts = tk.runs(rows, item).tolist()
    out = []
    for lo, hi in zip(cuts, [*cuts[1:], len(rows)]):
        r, k = int(rows[lo]), int(item[lo])
        if best := best_of(items.words(k), items.prints[k], h[w.first[r] : w.first[r + 1]], at[lo:hi] - w.first[r]):
            out.append((r, k, *best))
    return out


def written(items: DataFrame, id: str, text: str, most: int = BLOCK_BYTES) -> tuple[str, int]:
    """Writes indexes of the items, of at most about `most` bytes of text each (a longer item stands alone); the folder and their number.  The driver holds one at a time."""
    rows = items.select(F.col(f"`{id}`").alias("id"), text_bytes(text).alias("text")).distinct().withColumn("h", F.xxhash64("text"))
    size = F.octet_length("text") + 64
    order = [F.col("id").asc_nulls_last(), F.col("h"), F.col("text")]
    cut = checkpointed(running(rows, order, {"upto": size}).withColumn("g", F.floor((F.col("upto") - size) / F.lit(most))))
    path, n = mounted(scratch(items.sparkSession, "items")), 0
    os.makedirs(path)
    for g in [r.g for r in cut.select("g").distinct().orderBy("g").collect()]:
        own = cut.filter(F.col("g") == g).select("id", "text").collect()
        own.sort(key=lambda r: (r.id is None, r.id, bytes(r.text)))
        out = Sections(path, 0, n, 1)
        out.put(0, indexed([r.id for r in own], [bytes(r.text) for r in own]))
        out.close()
        n += 1
    return path, n


def opened(path: str, file: int) -> Items | None:
    """Items of a file; None if no item of it has words."""
    arrays = section(path, 0, file, 0, KINDS)
    return Items(arrays) if arrays else None


def found(path: str, files: int, column: pa.Array) -> Iterator[tuple[Items, list[tuple[int, int, float, int]]]]:
    """What the texts of a column hold of each file's items."""
    w = tk.words(column, tk.NOT_ALNUM, lower=True)
    h = w.hashes()
    for file in range(files):
        if items := opened(path, file):
            yield items, searched(items, w, h)


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (id, item, similarity, first_word): each item that a document holds, with its best window (the first in a tie).

    Texts are lower-cased A-Z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.
    Items of fewer than five words have their whole sequence as shingle; a text
    shorter than an item is one window.  Null and empty texts and items hold and
    match nothing.  Repeated documents are reported each, repeated items once.
    """
    rows = docs.select(F.col(f"`{id}`").alias("__id"), text_bytes(text).alias("__text"))
    kinds = T.StructType([T.StructField("__id", docs.schema[id].dataType), T.StructField("__item", items.schema[item].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType())])
    item_kind = to_arrow_type(items.schema[item].dataType)
    path, files = written(items, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                for group, got in found(path, files, part.column("__text")):
                    if got:
                        ids, take = group.ids, pa.array([r for r, *_ in got], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column("__id").take(take), pa.array([ids[k] for _, k, _, _ in got], item_kind), pa.array([s for *_, s, _ in got], pa.float64()), pa.array([w for *_, w in got], pa.int64())], ["__id", "__item", "similarity", "first_word"])

    return spread(rows).mapInArrow(tk.lean(run), kinds).withColumnsRenamed({"__id": id, "__item": item})


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no item, unchanged, with all their columns."""
    path, files = written(items, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text):
                keep = np.ones(part.num_rows, bool)
                for _, got in found(path, files, tk.as_bytes(part.column(text))):
                    keep[[r for r, *_ in got]] = False
                yield part.filter(pa.array(keep))

    return spread(docs).mapInArrow(tk.lean(run), docs.schema)
