"""Interpolated modified Kneser-Ney n-gram models, counted in Spark.

Vocabulary: a first pass counts words by their 64-bit hash and numbers them, the
frequent ones first, so that a number takes few bytes; the sorted hashes with
counts and numbers lie in the shared folder.

Counting: a second pass looks its words up, counts n-grams of numbers in bounded
chunks and deals the counts out by a slice of the context's hash, so an n-gram's
context is always complete in one shard and frequent n-grams are summed before
the shuffle.  A task merges the shards of one file in turn, appends their sorted
arrays to the file (temporary name, then rename, so a lost or repeated task does
no harm), and passes the distinct n-grams on as continuation counts of the next
lower order.  Only a few numbers per file reach the driver.

Arrays: keys lie in buckets of about ten by their leading bits, and the next 32
are kept; counts are one byte, with a table of the larger ones.  A key that was
never counted is taken for one that was with a probability of some 3 in a billion.

Scoring: workers map the files into memory, without holding descriptors, and look
sorted keys up; nothing is broadcast but paths and discounts.

Texts are lower-cased A-Z; tokens are the words `[^\\x20\\x09-\\x0D]+` and one
end per text.  Null texts are empty.  Padding before the first word counts as
words for contexts.  A context that was never seen backs off fully; words that
were never seen share one place in the uniform distribution below the words.
"""

from __future__ import annotations

import json
import math
import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import spread
from . import tokens as tk
from .shared import mounted, scratch, text_bytes

U64 = np.uint64
#: Fixed hashes of the end of a text and of the padding before it.
END, PAD = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
#: Numbers of the padding and of words that were never counted.
NO_WORD, UNKNOWN = U64(0), U64((1 << 63) - 1)
SLICE_BITS = 20
FILE_BITS = 12
CHUNK = 1 << 21
SHARD_BYTES = 8 << 20
BLOCK = "shard int, file int, payload binary"


@dataclass(frozen=True)
class Vocabulary:
    """path: folder of the files; bits, file_bits: log2 of the numbers of shards and files; tokens, types: counted tokens and distinct ones."""

    path: str
    bits: int
    file_bits: int
    tokens: int
    types: int


@dataclass(frozen=True)
class Model:
    """path: folder of the files; bits, file_bits: log2 of the numbers of shards and files; discounts: of each level from 1, for counts 1, 2 and 3 or more; totals: sums of the levels' counts; seen: level 1's N1, N2, N3+."""

    path: str
    order: int
    bits: int
    file_bits: int
    discounts: tuple
    vocabulary: Vocabulary
    totals: tuple
    seen: tuple

    @property
    def tokens(self) -> int:
        return self.vocabulary.tokens

    @property
    def types(self) -> int:
        return self.vocabulary.types


# --- files of sorted arrays, a section for each shard


class Sections:
    """Writes a file of sections: the arrays of a shard one after the other; the index of places comes with it."""

    def __init__(self, path: str, level: int, file: int, shards: int):
        self.at, self.index = f"{path}/{level}-{file}", np.zeros((shards, 2 * 12), np.int64)
        self.held = f"{self.at}.{os.getpid()}-{os.urandom(6).hex()}"
        self.out = open(self.held, "wb")

    def put(self, shard: int, arrays: list[np.ndarray]) -> None:
        for k, x in enumerate(arrays):
            self.out.write(bytes(-self.out.tell() % 8))
            self.index[shard, 2 * k : 2 * k + 2] = self.out.tell(), len(x)
            self.out.write(np.ascontiguousarray(x).data)

    def close(self) -> None:
        self.out.close()
        with open(f"{self.held}.index", "wb") as f:
            np.save(f, self.index)
        os.replace(f"{self.held}.index", f"{self.at}.index")
        os.replace(self.held, self.at)


_MAPS: dict[tuple, tuple | None] = {}


def mapped_bytes(path: str) -> np.ndarray:
    """A file's bytes, mapped; no descriptor stays open where Python can do without one."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            return np.zeros(0, np.uint8)
        try:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False)
        except TypeError:  # before Python 3.13
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return np.frombuffer(held, np.uint8)


def section(path: str, level: int, file: int, shard: int, kinds: tuple) -> list[np.ndarray] | None:
    """The arrays of a shard; None if nothing was counted there.  Files of the last few folders stay mapped."""
    if (path, level, file) not in _MAPS:
        if len({p for p, *_ in _MAPS}) > 8:  # a worker that goes on to other models lets go of old ones
            _MAPS.clear()
        at = f"{path}/{level}-{file}"
        _MAPS[path, level, file] = (mapped_bytes(at), np.load(f"{at}.index")) if os.path.exists(at) else None
    got = _MAPS[path, level, file]
    if got is None or not got[1][shard, 1]:
        return None
    out = []
    for k, (kind, width) in enumerate(kinds):
        at, n = got[1][shard, 2 * k : 2 * k + 2]
        x = np.frombuffer(got[0], kind, n * width, at) if n else np.zeros(0, kind)
        out.append(x.reshape(n, width) if width > 1 else x)
    return out


#: Arrays of a section: where buckets of keys begin, keys, counts with the places and values of large ones; the same of contexts.
KEYS = ((np.uint32, 1), (np.uint32, 1))
COUNTS = ((np.uint8, 1), (np.uint32, 1), (np.int64, 1))
SUMS = ((np.uint8, 1), (np.uint32, 1), (np.int64, 4))
ENTRY = (*KEYS, *COUNTS)
NGRAMS = (*ENTRY, *KEYS, *SUMS)
#: Of words: hashes, counts as above, ranks.
WORDS = ((np.uint64, 1), *COUNTS, (np.uint32, 1))


def bucketed(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Of ascending keys, which agree in the first `bits`: the next bits, about log2 of a tenth of the keys, give a bucket; the next 32 are kept."""
    rest = keys << U64(bits)
    k = max(0, len(keys).bit_length() - 4)
    buckets = (rest >> U64(64 - k)).astype(np.int64) if k else np.zeros(len(keys), np.int64)
    first = np.zeros((1 << k) + 1, np.uint32)
    np.cumsum(np.bincount(buckets, minlength=1 << k), out=first[1:])
    return [first, ((rest << U64(k)) >> U64(32)).astype(np.uint32)]


def places(first: np.ndarray, kept: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Where the keys stand; -1 for those that don't.  A binary search in all buckets at once."""
    rest = keys << U64(bits)
    k = (len(first) - 1).bit_length() - 1
    bucket = (rest >> U64(64 - k)).astype(np.int64) if k else np.zeros(len(keys), np.int64)
    own = ((rest << U64(k)) >> U64(32)).astype(np.uint32)
    low, end = first[bucket].astype(np.int32), first[bucket + 1].astype(np.int32)
    for step in (1 << j for j in range(int((end - low).max(initial=0)).bit_length() - 1, -1, -1)):
        further = low + np.int32(step)
        further -= np.int32(step) * ((further > end) | (kept.take(further - 1, mode="clip") >= own))
        low = further
    return np.where((low < end) & (kept.take(low, mode="clip") == own), low, -1)


def fewer(counts: np.ndarray) -> list[np.ndarray]:
    """Counts as bytes; places and values of those above 254, whose bytes are 255."""
    large = np.flatnonzero(counts > 254)
    small = counts.astype(np.uint8)
    small[large] = 255
    return [small, large.astype(np.uint32), counts[large].astype(np.int64)]


def values_at(at: np.ndarray, small: np.ndarray, where: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    hit = np.flatnonzero(out == 255)
    out[hit] = large[np.searchsorted(where, at[hit])]
    return out


def _codes() -> np.ndarray:
    """Sum of all counts and numbers of counts 1, 2 and 3 or more, by code: few small counts, then few with one of 3 to 8."""
    code = np.arange(160)
    n1, n2 = np.where(code < 64, code & 15, code - 64 & 7), np.where(code < 64, code >> 4, code - 64 >> 3 & 1)
    rest = np.where(code < 64, 0, 3 + (code - 64 >> 4))
    return np.stack([n1 + 2 * n2 + rest, n1, n2, rest > 0], axis=1)


CODES = _codes()


def coded(sums: np.ndarray) -> list[np.ndarray]:
    """Rows like those of CODES as bytes; places and values of other rows, whose bytes are 255."""
    total, n1, n2, n3 = sums.T
    rest = total - n1 - 2 * n2
    low, one = (n1 < 16) & (n2 < 4) & (n3 == 0), (n1 < 8) & (n2 < 2) & (n3 == 1) & (rest < 9)
    code = np.where(low, n1 + 16 * n2, np.where(one, 64 + n1 + 8 * n2 + 16 * (rest - 3), 255)).astype(np.uint8)
    large = np.flatnonzero(code == 255)
    return [code, large.astype(np.uint32), sums[large].astype(np.int64)]


def sums_at(at: np.ndarray, code: np.ndarray, where: np.ndarray, large: np.ndarray) -> np.ndarray:
    own = code[at]
    out = CODES[np.minimum(own, len(CODES) - 1)]
    hit = np.flatnonzero(own == 255)
    out[hit] = large[np.searchsorted(where, at[hit])]
    return out


def by_shard(keys: np.ndarray, bits: int, file_bits: int) -> Iterator[tuple[int, int, int, int]]:
    """(file, shard in the file, low, high) of the runs of keys whose shards ascend."""
    shards = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = tk.runs(shards)
    inner = bits - file_bits
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
        yield int(shards[lo]) >> inner, int(shards[lo]) & ((1 << inner) - 1), lo, hi


def looked_up(m: Model, level: int, keys: np.ndarray, sums: bool = False) -> np.ndarray:
    """Counts of the keys, whose shards ascend; zeros where a key is absent.  sums: of contexts, the sum and the numbers of counts 1, 2 and 3 or more."""
    out = np.zeros((len(keys), 4) if sums else len(keys), np.int64)
    for file, shard, lo, hi in by_shard(keys, m.bits, m.file_bits):
        if (have := section(m.path, level, file, shard, NGRAMS if level > 1 else ENTRY)) is None:
            continue
        first, kept, *values = have[5:] if sums else have[:5]
        at = places(first, kept, keys[lo:hi], m.bits)
        hit = np.flatnonzero(at >= 0)
        out[lo + hit] = (sums_at if sums else values_at)(at[hit], *values)
    return out


def found(m: Model, level: int, sought: np.ndarray, sums: bool = False) -> np.ndarray:
    """As looked_up, of keys in any order."""
    by = np.argsort(sought)
    out = np.empty((len(sought), 4) if sums else len(sought), np.int64)
    out[by] = looked_up(m, level, sought[by], sums)
    return out


def numbered(v: Vocabulary, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of words by hash; UNKNOWN and 0 for those that were never counted, NO_WORD for the padding."""
    by = np.argsort(hashes)
    ordered = hashes[by]
    starts = tk.runs(ordered)
    one = ordered[starts]
    ids, counts = np.full(len(one), UNKNOWN), np.zeros(len(one), np.int64)
    for file, shard, lo, hi in by_shard(one, v.bits, v.file_bits):
        if (have := section(v.path, 0, file, shard, WORDS)) is not None:
            keys, *values, rank = have
            at = np.minimum(np.searchsorted(keys, one[lo:hi]), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == one[lo:hi])
            counts[lo + hit] = n = values_at(at[hit], *values)
            ids[lo + hit] = (first_numbers(v.path)[file, sizes(n)] + rank[at[hit]]).astype(U64)
    ids[one == PAD] = NO_WORD
    each = np.diff(starts, append=len(by))
    out = np.empty(len(by), U64), np.empty(len(by), np.int64)
    out[0][by], out[1][by] = np.repeat(ids, each), np.repeat(counts, each)
    return out


def sizes(counts: np.ndarray) -> np.ndarray:
    """Bits of the counts less one."""
    return np.frexp(counts.astype(float))[1] - 1


def first_numbers(path: str) -> np.ndarray:
    if (path, "first") not in _MAPS:
        _MAPS[path, "first"] = np.load(f"{path}/first.npy")
    return _MAPS[path, "first"]


# --- streams of tokens


def stream(w: tk.Words, hashes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of padding, words and end of each row in turn; positions of the tokens; their rows."""
    pad, n = order - 1, len(w.counts)
    out = np.full(len(hashes) + n * (pad + 1), PAD, U64)
    at = np.arange(len(hashes)) + w.row * (pad + 1) + pad
    out[at] = hashes
    ends = w.first[1:] + np.arange(1, n + 1) * (pad + 1) - 1
    out[ends] = END
    real = np.ones(len(out), bool)
    for k in range(pad):
        real[w.first[:-1] + np.arange(n) * (pad + 1) + k] = False
    return out, np.flatnonzero(real), np.repeat(np.arange(n), w.counts + 1)


def contexts(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the last 1, 2, ... of all columns, the words before another, the nearest last."""
    out: list[np.ndarray] = []
    for before in columns[::-1]:
        out.append(tk.combine(before, out[-1]) if out else tk.mix(before + U64(1)))
    return out


def keys_of(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams: the context's slice first, so that a range of keys holds whole contexts."""
    low = 64 - SLICE_BITS
    return (context >> U64(low) << U64(low)) | (tk.combine(context, word) >> U64(SLICE_BITS))


def ngram_keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray | None]:
    """Keys of n-grams whose words are the columns, and of their contexts."""
    if len(columns) == 1:
        return tk.mix(columns[0] + U64(1)), None
    context = contexts(columns[:-1])[-1]
    return keys_of(context, columns[-1]), context


# --- counting


def packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Columns by byte plane, compressed: numbers of frequent words have zeros in most planes, and the first column ascends and is kept as differences."""
    by = np.argsort(columns[0])
    first, *others = (c[by] for c in columns)
    planes, width = [], []
    for x in [np.diff(first, prepend=U64(0)), *others, counts[by].astype(U64)]:
        k = max(1, (int(x.max()).bit_length() + 7) // 8)
        width.append(k)
        planes.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes())
    raw = b"".join(planes)
    head = np.array([len(counts), len(raw), len(columns), *width], np.int64).tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(payload: bytes) -> list[np.ndarray]:
    """The columns, then the counts."""
    n, size, columns = np.frombuffer(payload, np.int64, 3).tolist()
    width = np.frombuffer(payload, np.int64, columns + 1, 24).tolist()
    x, at, out = np.frombuffer(pa.decompress(payload[8 * (4 + columns) :], size, codec="zstd", asbytes=True), np.uint8), 0, []
    for k in width:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :k] = x[at : at + k * n].reshape(k, n).T
        out.append(wide.view(U64).ravel())
        at += k * n
    return [np.cumsum(out[0], dtype=U64), *out[1:]]


def dealt(columns: list[np.ndarray], counts: np.ndarray | None, bits: int, file_bits: int, keys: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of BLOCK: equal columns summed, cut by the leading bits of their keys."""
    if not len(columns[0]):
        return
    keys = ngram_keys(columns)[0] if keys is None else keys
    by = np.argsort(keys)
    keys = keys[by]
    starts = tk.runs(keys)
    counts = np.diff(starts, append=len(by)).astype(U64) if counts is None else np.add.reduceat(counts[by], starts)
    columns, keys = [c[by[starts]] for c in columns], keys[starts]
    inner = bits - file_bits
    for file, shard, lo, hi in by_shard(keys, bits, file_bits):
        yield (file << inner) + shard, file, packed([c[lo:hi] for c in columns], counts[lo:hi])


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 3, kinds)], ["shard", "file", "payload"])


def word_counter(bits: int, file_bits: int, separators: np.ndarray):
    """For mapInArrow: counts of the hashes of words and ends, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column("text"), separators, lower=True)
                one, counts = np.unique(np.append(w.hashes(), np.full(part.num_rows, END)), return_counts=True)
                held.append((one, counts.astype(U64)))
                n += len(one)
                if n >= CHUNK:
                    yield as_batch([*dealt([np.concatenate([k for k, _ in held])], np.concatenate([c for _, c in held]), bits, file_bits, np.concatenate([k for k, _ in held]))])
                    held, n = [], 0
        if held:
            yield as_batch([*dealt([np.concatenate([k for k, _ in held])], np.concatenate([c for _, c in held]), bits, file_bits, np.concatenate([k for k, _ in held]))])

    return run


def counter(order: int, bits: int, file_bits: int, vocabulary: Vocabulary, separators: np.ndarray):
    """For mapInArrow: n-gram counts of the texts, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in tk.slices(batch, "text"):
                w = tk.words(part.column("text"), separators, lower=True)
                s, at, _ = stream(w, w.hashes(), order)
                s = numbered(vocabulary, s)[0]
                for lo in range(0, len(at), CHUNK):
                    here = at[lo : lo + CHUNK]
                    held.append([s[here - k] for k in range(order - 1, -1, -1)])
                    n += len(here)
                    if n >= CHUNK:
                        yield as_batch([*dealt([np.concatenate(c) for c in zip(*held)], None, bits, file_bits)])
                        held, n = [], 0
        if held:
            yield as_batch([*dealt([np.concatenate(c) for c in zip(*held)], None, bits, file_bits)])

    return run


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(shard, file, payloads) of rows sorted by shard; rows of statistics (shard -1) one by one."""
    now, held = None, []
    for b in batches:
        for shard, file, payload in zip(*(c.to_pylist() for c in b.columns)):
            if held and (shard != now[0] or shard < 0):
                yield *now, held
                held = []
            now = shard, file
            held.append(payload)
    if held:
        yield *now, held


def summed(payloads: list[bytes], keys_from) -> tuple[np.ndarray, np.ndarray | None, list[np.ndarray], np.ndarray]:
    """Keys (ascending), contexts, columns and counts of a shard's blocks."""
    *columns, counts = [np.concatenate(c) for c in zip(*(unpacked(p) for p in payloads))]
    keys, context = keys_from(columns)
    by = np.argsort(keys)
    keys = keys[by]
    starts = tk.runs(keys)
    first = by[starts]
    return keys[starts], None if context is None else context[first], [c[first] for c in columns], np.add.reduceat(counts[by], starts)


def word_merger(path: str, inner: int):
    """For mapInArrow over rows sorted by shard: writes hashes, counts and ranks among the file's words of a size; a row (file, words by size, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, of, tokens = None, np.zeros(64, np.int64), 0
        for shard, file, payloads in shards(batches):
            keys, _, _, counts = summed(payloads, lambda c: (c[0], None))
            out = out or Sections(path, 0, file, 1 << inner)
            size = sizes(counts)
            by = np.argsort(size, kind="stable")
            starts = tk.runs(size[by])
            rank = np.empty(len(keys), np.int64)
            rank[by] = np.arange(len(by)) - np.repeat(starts, np.diff(starts, append=len(by))) + of[size[by]]
            of += np.bincount(size, minlength=64)
            tokens += int(counts.sum())
            out.put(shard & ((1 << inner) - 1), [keys, *fewer(counts), rank.astype(np.uint32)])
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([of.tolist()], pa.list_(pa.int64())), pa.array([tokens])], ["file", "sizes", "tokens"])

    return run


def merger(path: str, level: int, bits: int, file_bits: int):
    """For mapInArrow over rows sorted by shard: writes the shards' arrays; rows of the next level's counts, and one of statistics (shard -1)."""
    inner = bits - file_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, total, of, told = None, 0, 0, np.zeros(4, np.int64), []
        for shard, file, payloads in shards(batches):
            if shard < 0:
                told.append((-1, 0, payloads[0]))
                continue
            keys, context, columns, counts = summed(payloads, ngram_keys)
            del payloads
            out = out or Sections(path, level, file, 1 << inner)
            arrays = [*bucketed(keys, bits), *fewer(counts)]
            del keys
            n, total = n + len(counts), total + int(counts.sum())
            of += np.bincount(np.minimum(counts, 5).astype(int), minlength=6)[1:5]
            if context is not None:
                by = np.argsort(context)
                context, c = context[by], counts[by].astype(np.int64)
                first = tk.runs(context)
                kept = np.stack([np.add.reduceat(x.astype(np.int64), first) for x in (c, c == 1, c == 2, c > 2)], axis=1)
                arrays += [*bucketed(context[first], bits), *coded(kept)]
                del context, c, by, kept
                if rows := [*dealt(columns[1:], np.ones(len(counts), U64), bits, file_bits)]:
                    yield as_batch(rows)
            out.put(shard & ((1 << inner) - 1), arrays)
        if out:
            out.close()
            told.append((-1, 0, json.dumps({"level": level, "n": n, "sum": total, "of": of.tolist()}).encode()))
        if told:
            yield as_batch(told)

    return run


def by_file(rows: DataFrame, file_bits: int) -> DataFrame:
    return rows.repartitionById(1 << file_bits, F.col("file")).sortWithinPartitions("shard")


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney's discounts from the numbers of counts 1 to 4; where they are too few: half the count, at most 1.5."""
    n1, n2, n3, n4 = of
    if not (n1 and n2):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05 * (k + 1)), 0.95 * (k + 1)) for k, d in enumerate(found))


def cut(texts: DataFrame, shard_bytes: int) -> tuple[int, int]:
    """log2 of the numbers of shards and of files, by the bytes of text."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SLICE_BITS, max(0, math.ceil(math.log2(max(1, size / shard_bytes)))))
    return bits, min(bits, FILE_BITS)


def vocabulary(train: DataFrame, text: str = "text", separators: np.ndarray = tk.SPACE, shard_bytes: int = SHARD_BYTES) -> Vocabulary:
    """The words of all rows of `train`, counted and numbered."""
    texts = spread(train.select(text_bytes(text).alias("text")))
    bits, file_bits = cut(texts, shard_bytes)
    path = mounted(scratch(train.sparkSession, "words"))
    os.makedirs(path)
    rows = by_file(texts.mapInArrow(tk.lean(word_counter(bits, file_bits, separators)), BLOCK), file_bits)
    told = rows.mapInArrow(tk.lean(word_merger(path, bits - file_bits)), "file int, sizes array<long>, tokens long").collect()  # a row per file, 4,096 at most
    of = np.zeros((1 << file_bits, 64), np.int64)
    for r in told:
        of[r.file] = r["sizes"]
    flat = of.T[::-1].ravel()  # by size, the largest first, then by file
    first = (1 + np.cumsum(flat) - flat).reshape(64, -1)[::-1].T
    with open(held := f"{path}/first.npy.{os.getpid()}", "wb") as f:
        np.save(f, np.ascontiguousarray(first))
    os.replace(held, f"{path}/first.npy")
    return Vocabulary(path, bits, file_bits, sum(r["tokens"] for r in told), int(of.sum()))


def fit(train: DataFrame, order: int = 3, text: str = "text", separators: np.ndarray = tk.SPACE, shard_bytes: int = SHARD_BYTES, words: Vocabulary | None = None) -> Model:
    """A model of the texts of all rows of `train`, whose arrays lie in the shared folder.

    Other columns of `train` are not read.  No rows, or only empty texts: a valid
    model that knows the end of a text at most.  The number of shards follows the
    bytes of text.  words: a vocabulary that has all words of `train`; without one
    its own is counted.
    """
    words = words or vocabulary(train, text, separators, shard_bytes)
    texts = spread(train.select(text_bytes(text).alias("text")))
    bits, file_bits = (words.bits, words.file_bits)
    path = mounted(scratch(train.sparkSession, "lm"))
    os.makedirs(path)
    rows = texts.mapInArrow(tk.lean(counter(order, bits, file_bits, words, separators)), BLOCK)
    for level in range(order, 0, -1):
        rows = by_file(rows, file_bits).mapInArrow(tk.lean(merger(path, level, bits, file_bits)), BLOCK)
    told = [json.loads(bytes(r.payload)) for r in rows.select("payload").collect()]
    level = lambda k: [t for t in told if t["level"] == k]
    of = lambda k: [sum(t["of"][i] for t in level(k)) for i in range(4)]
    n1, n2, *_ = of(1)
    types = sum(t["n"] for t in level(1))
    return Model(path, order, bits, file_bits, tuple(discounts(of(k)) for k in range(1, order + 1)), words, tuple(sum(t["sum"] for t in level(k)) for k in range(1, order + 1)), (n1, n2, types - n1 - n2))


# --- scoring


def probabilities(m: Model, s: np.ndarray, at: np.ndarray, order: int | None = None, base: np.ndarray | None = None) -> np.ndarray:
    """Of the tokens at these positions of a stream of numbers.  order: the highest level that is read, else all; base: the distribution below the words at each position, else uniform."""
    own = found(m, 1, ngram_keys([s[at]])[0])
    d = np.array([0.0, *m.discounts[0]])
    base = 1 / (m.types + 1) if base is None else base
    p = (np.maximum(own - d[np.minimum(own, 3)], 0) + np.dot(d[1:], m.seen) * base) / m.totals[0] if m.totals[0] else np.zeros(len(at)) + base
    for k in range(2, (order or m.order) + 1):
        keys, context = ngram_keys([s[at - j] for j in range(k - 1, -1, -1)])
        d = np.array([0.0, *m.discounts[k - 1]])
        by = np.argsort(keys)  # shards of contexts ascend with it
        sums = looked_up(m, k, context[by], sums=True)
        seen = np.flatnonzero(sums[:, 0])
        some, sums = by[seen], sums[seen]
        c = looked_up(m, k, keys[some])
        p[some] = (np.maximum(c - d[np.minimum(c, 3)], 0) + sums[:, 1:] @ d[1:] * p[some]) / sums[:, 0]
    return p


def scorer(m: Model, columns: list[str], separators: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text", 4 << 20):
                w = tk.words(part.column("__text"), separators, lower=True)
                n = part.num_rows
                s, at, row = stream(w, w.hashes(), m.order)
                s, counts = numbered(m.vocabulary, s)
                known, base, score = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                for lo in range(0, len(at), CHUNK >> 1):
                    here, r = at[lo : lo + (CHUNK >> 1)], row[lo : lo + (CHUNK >> 1)]
                    c = counts[here]
                    known += np.bincount(r[c > 0], minlength=n)
                    base += np.bincount(r, np.log10((c + 1) / (m.tokens + m.types + 1)), n)
                    score += np.bincount(r, np.log10(probabilities(m, s, here)), n)
                out = [part.column(c) for c in columns] + [pa.array(x) for x in (w.counts + 1, known, base, score, 10 ** (-score / (w.counts + 1)))]
                yield pa.RecordBatch.from_arrays(out, [*columns, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", separators: np.ndarray = tk.SPACE) -> DataFrame:
    """A row per row of docs: the columns `keep`, n_tokens, n_known, base_score (add-one words), score (log10 probability under the model), perplexity.

    Null and empty texts have the end alone.  Repeated rows each get a row; other
    columns are not read, whatever their names.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep), text_bytes(text).alias("__text"))
    out = T.StructType([*(f for f in kept.schema.fields if f.name in keep), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")), *(T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity"))])
    return spread(kept).mapInArrow(tk.lean(scorer(model, [*keep], separators)), out)
