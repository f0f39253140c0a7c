"""Words of Arrow text columns as numpy arrays.

All texts of a slice of a batch lie in one byte buffer; words, lines and their
64-bit hashes are found with whole-array operations, so Python never runs a
loop per word.  Columns are handed over as *binary*: the bytes of the UTF-8
text, never decoded.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_SPAN = 1 << 20  # bytes that are hashed at once


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


#: Separators of `[^\x20\x09-\x0D]+`.
SPACE = _table(" \t\n\v\f\r")
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: all ASCII but digits and a-z.
NOT_ALNUM = _table("".join(map(chr, range(128))))
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two 64-bit hashes."""
    return mix(a * U64(0xD6E8FEB86659FD93) + b)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))
_POW = _IPOW = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, _SPAN + 1)
        out = []
        for base in (_P, _P_INV):
            x = np.full(size, base, U64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U64))
        _POW, _IPOW = out
    return _POW, _IPOW


_LONG = 512  # bytes from which on a span is hashed by running sums
_FIRST = (U64(1) << (U64(8) * np.arange(8, dtype=U64))) - U64(1)
_FIRST = np.append(_FIRST, ~U64(0))  # masks of the first 0 to 8 bytes of a number


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end]; starts and ends ascend, spans don't overlap.

    Eight bytes at a time of all spans at once; few are longer, and the longest are
    hashed by running sums instead.
    """
    size = ends - starts
    held = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buf) + 1, "<u8", held, strides=(1,))  # the eight bytes from each place on
    out = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) + size.astype(U64) * U64(_P))
    rest, at = np.flatnonzero((size > 8) & (size < _LONG)), 8
    while len(rest):
        more = eight[starts[rest] + at] & _FIRST[np.minimum(size[rest] - at, 8)]
        out[rest] = combine(out[rest], more)
        at += 8
        rest = rest[size[rest] > at]
    if len(long := np.flatnonzero(size >= _LONG)):
        out[long] = _long_hashes(buf, starts[long], ends[long])
    return out


def _long_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        seg = buf[base : int(ends[j - 1])]
        power, inverse = _powers(len(seg) + 1)
        sums = np.zeros(len(seg) + 1, U64)
        np.cumsum(_BYTE[seg] * power[: len(seg)], dtype=U64, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


@dataclass
class Words:
    """Words of consecutive rows.  buf: bytes (lower-cased if asked for); bounds: rows' byte bounds; starts, ends: the words' bytes; row: their row; first: index of each row's first word, and the number of words."""

    buf: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buf, self.starts, self.ends)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary Arrow column, and the rows' bounds in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, bounds - bounds[0]


def spans(buf: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without a separator; a row's bounds end a run."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~separators[buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def words(column: pa.Array, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    buf, bounds = raw(column)
    if lower:
        buf = LOWER[buf]
    starts, ends = spans(buf, bounds, separators)
    first = np.searchsorted(starts, bounds)
    return Words(buf, bounds, starts, ends, np.repeat(np.arange(len(column)), np.diff(first)), first)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch with about `most` bytes in the text or binary column; a longer text stands alone."""
    _, bounds = raw(as_bytes(batch.column(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def runs(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values in columns that are sorted alike."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def release() -> None:
    """Gives freed memory back to the system: Spark keeps workers for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that leaves no freed memory in its worker."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def as_bytes(column: pa.Array) -> pa.Array:
    """A text column as its bytes, without a copy; null as empty."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).fill_null(b"")
