"""Line dedup with a log-template tree of fixed depth.

A message is a line, or a sentence of `sentence` words or more inside a line of
several.  Its path in the tree is its number of words and its first `depth` words;
words with a digit are variable fields and equal one another.  A leaf's
templates are the rest of the message, whole or, for lines of `general` words or
more, with one of `parts` equal stretches (an even number) open, so lines that vary in one stretch
(in short lines: in one word) share a template.  Each template is a 64-bit key
from sums over positions, found without a loop over messages.

A passage is a run of `passage` words or more anywhere in a text, over lines and
parts of sentences, that stands in two documents.  Of the runs of `gram` words in
each window of `passage` words the one with the least hash is the window's anchor,
equal wherever the window stands; a run is what adjoining windows with one anchor
span.  All documents but the one with the smallest id lose the words of the window.

Two passes count, a third one cuts.  The first counts whole messages, and what a
recurring open template or passage must share: either half of a line (an open
stretch lies in one half, so the other is whole), anchors and runs.  The second
counts open templates of lines with a recurring half, and windows with a recurring
anchor, unless an earlier document has the whole run: that one counts them.  They
are few, since most text is new or copied whole.

A template recurs if enough documents have it, the more the shorter it is
(`needed`).  All documents but the one with the smallest id lose its messages.

Counting is a sum per key with partial sums before the shuffle; texts are never
shuffled.  Recurring keys and their first ids become sorted arrays in the shared
folder, which the next pass maps into memory.
"""

from __future__ import annotations

import math
import os
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import spread
from . import tokens as tk
from .lm import by_shard, section, Sections
from .shared import checkpointed, mounted, scratch, text_bytes

U64 = tk.U64
LINE = tk._table("\n")
DIGIT = tk._table("0123456789")
STOP = tk._table(".!?")
FIELD = U64(0xA0761D6478BD642F)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Rules:
    """depth: leading words that are never open; parts: stretches of which one may be open; general: words of a line from which on one may; sentence: words of a sentence in a line from which on it is a message; needed: words of a message from which on so many documents must have it, the longest first; passage, gram: words of a window, and of its anchor.

    Lower `needed` takes more of what recurs by chance: at (8, 3) and (1, 10) a heading
    stays in up to nine documents, a sentence of a few words in two.
    """

    depth: int = 1
    parts: int = 4
    general: int = 4
    sentence: int = 8
    needed: tuple = ((50, 2), (8, 3), (1, 10))
    passage: int = 50
    gram: int = 10

    def documents(self, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n), np.int32)
        for words, documents in reversed(self.needed):
            out[n >= words] = documents
        return out


class Messages:
    """Messages of a column.  Of lines: row, line (number in the text), n (words), whole (key), halves [line, 2], and keys of open templates on demand; of sentences: of (their line), start and end (bytes in the line), key, size (words)."""

    def __init__(self, column: pa.Array, rules: Rules):
        w = tk.words(column, lower=True)
        self.words, self.rules, self.exact = w, rules, w.hashes()
        breaks = np.flatnonzero(LINE[w.buf])
        before = np.searchsorted(breaks, w.starts)
        self.first = first = tk.runs(w.row, before)
        self.last = last = np.append(first[1:], len(w.row)) if len(first) else first
        self.n = n = last - first
        self.row, before = w.row[first], before[first]
        self.line = before - np.searchsorted(breaks, w.bounds[self.row])
        self.starts = np.maximum(w.bounds[self.row], np.append(breaks, 0)[before - 1] + 1) if len(breaks) else w.bounds[self.row]
        self.starts[before == 0] = w.bounds[self.row][before == 0]

        h = self.exact
        if len(digits := np.flatnonzero(DIGIT[w.buf])):
            h = h.copy()
            h[np.searchsorted(w.starts, digits, "right") - 1] = FIELD
        self.sums, self.inverse = summed(h)
        self.sum = self.sums[last] - self.sums[first]
        middle = first + np.minimum(rules.depth + np.maximum(n - rules.depth, 0) // 2, n)
        self.label = n.astype(U64) * U64(rules.parts + 3)
        self.whole = tk.combine(self.label, self.sum * self.inverse[first])
        sides = self.sums[middle] - self.sums[first], self.sums[last] - self.sums[middle]
        self.halves = np.stack([tk.combine(self.label + U64(rules.parts + 1 + k), x * self.inverse[first]) for k, x in enumerate(sides)], axis=1)

        opens = np.zeros(len(h) + 1, bool)
        opens[1:-1] = STOP[w.buf[w.ends[:-1] - 1]] if len(h) else False
        opens[first] = True
        head = np.flatnonzero(opens[:-1])
        tail = np.append(head[1:], len(h))
        of = np.searchsorted(first, head, "right") - 1
        own = (tail - head >= rules.sentence) & (tail - head < n[of])
        head, tail, self.of = head[own], tail[own], of[own]
        self.size = tail - head
        self.start, self.end = w.starts[head] - self.starts[self.of], (w.ends[tail - 1] if len(tail) else tail) - self.starts[self.of]
        self.key = tk.combine(self.size.astype(U64) * U64(rules.parts + 3), (self.sums[tail] - self.sums[head]) * self.inverse[head])

    def templates(self, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines and keys of their templates with an open stretch in one half where the other half is in `seen` [line, 2]."""
        r, lines, keys = self.rules, [], []
        rest = np.maximum(self.n - r.depth, 0)
        for k in range(r.parts):
            at = np.flatnonzero((self.n >= r.general) & seen[:, 0 if 2 * k >= r.parts else 1])
            a, b = ((self.first + r.depth + rest * j // r.parts)[at] for j in (k, k + 1))
            at, a, b = at[a < b], a[a < b], b[a < b]
            lines.append(at)
            keys.append(tk.combine(self.label[at] + U64(k + 1), (self.sum[at] - (self.sums[b] - self.sums[a])) * self.inverse[self.first[at]]))
        return np.concatenate(lines), np.concatenate(keys)

    def parts(self, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line, first word and end of the runs of words in `gone` within lines."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        at = np.flatnonzero(gone)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (line[at[1:]] != line[at[:-1]])
        head = np.flatnonzero(new)
        return line[at[head]], at[head], at[np.append(head[1:], len(at)) - 1] + 1 if len(at) else at


class Windows:
    """Windows of words within a row, in runs of windows of a row that have one anchor.  start: first words of the windows; head: each run's first window; anchor, run: keys of a run's anchor and of all its words; row: its row."""

    def __init__(self, words: tk.Words, exact: np.ndarray, rules: Rules):
        self.rules, row, passage = rules, words.row, rules.passage
        self.start = np.flatnonzero(row[: max(0, len(row) - passage + 1)] == row[passage - 1 :])
        self.head, self.anchor, self.run = np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
        if len(self.start):
            self.sums, self.inverse = summed(exact)
            least = self.grams(np.arange(len(exact) - rules.gram + 1), rules.gram)
            wide, size = passage - rules.gram + 1, 1
            while 2 * size <= wide:
                least, size = np.minimum(least[:-size], least[size:]), 2 * size
            least = np.minimum(least[: len(least) - (wide - size)], least[wide - size :])[self.start]
            self.head = tk.runs(row[self.start], least)
            size = np.diff(self.head, append=len(self.start))
            self.anchor = tk.combine(least[self.head], np.full(len(self.head), rules.gram, U64))
            self.run = tk.combine(self.grams(self.start[self.head], size + passage - 1), size.astype(U64) + U64(passage))
        self.row = row[self.start[self.head]]

    def grams(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Hashes of the runs of so many words that begin at these."""
        return tk.mix((self.sums[at + size] - self.sums[at]) * self.inverse[at])

    def of(self, runs: np.ndarray) -> np.ndarray:
        """First words of the windows of runs that are set."""
        return self.start[np.repeat(runs, np.diff(self.head, append=len(self.start)))]

    def keys(self, at: np.ndarray) -> np.ndarray:
        return tk.combine(self.grams(at, self.rules.passage), np.full(len(at), self.rules.passage, U64)) if len(at) else np.zeros(0, U64)

    def told(self, shared: Recurring, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of runs that an earlier document has whole, and of those whose windows must be counted one by one: the anchor recurs, and no earlier document has the run."""
        whole = firsts(shared, self.run) < ids[self.row]
        return self.of(whole), self.of(~whole & (firsts(shared, self.anchor) < LAST))


def summed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hashes times powers by position, and the inverse powers: a run's difference of sums times the inverse at its start depends on its words alone."""
    power, inverse = tk._powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * power[: len(h)], dtype=U64, out=sums[1:])
    return sums, inverse


def once(row: np.ndarray, key: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys of a row once."""
    by = np.lexsort((key, row))
    by = by[tk.runs(row[by], key[by])]
    return row[by], key[by], needed[by]


def keyed(ids: np.ndarray, *found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    row, key, needed = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(needed.astype(np.int32))], ["key", "id", "needed"])


def seen(rules: Rules):
    """For mapInArrow: a row (key, id, needed) for each whole message, half of a line and anchor of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                ids = part.column("__id").to_numpy(zero_copy_only=False)
                m = Messages(part.column("__text"), rules)
                w = Windows(m.words, m.exact, rules)  # a repeated run does no harm: it needs two ids
                needed = rules.documents(m.n)
                some = m.n >= rules.general
                row, halves = m.row[some], m.halves[some]
                messages = once(np.concatenate([m.row, row, row, m.row[m.of]]), np.concatenate([m.whole, halves[:, 0], halves[:, 1], m.key]), np.concatenate([needed, needed[some], needed[some], rules.documents(m.size)]))
                two = np.full(len(w.row), 2)
                yield keyed(ids, messages, (w.row, w.anchor, two), (w.row, w.run, two))

    return run


def shared_windows(shared: Recurring, rules: Rules):
    """For mapInArrow: a row (key, id, needed) for each open template of lines with a recurring half, and each window whose anchor recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                ids = part.column("__id").to_numpy(zero_copy_only=False)
                m = Messages(part.column("__text"), rules)
                line, key = m.templates(firsts(shared, m.halves) < LAST)
                w = Windows(m.words, m.exact, rules)
                start = w.told(shared, ids)[1]
                yield keyed(ids, once(m.row[line], key, rules.documents(m.n[line])), (m.words.row[start], w.keys(start), np.full(len(start), 2)))

    return run


RECURRING = ((np.uint64, 1), (np.int64, 1))


def kept_arrays(path: str, inner: int):
    """For mapInArrow over a file's rows (file, shard, key, first) sorted by shard: writes the shards' keys and first ids, sorted by unsigned key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, n = None, [], 0

        def put() -> None:
            file, shard, key, first = (np.concatenate(c) for c in zip(*held))
            nonlocal out, n
            out = out or Sections(path, 0, int(file[0]), 1 << inner)
            key = key.view(U64)
            by = np.argsort(key)
            out.put(int(shard[0]) & ((1 << inner) - 1), [key[by], first[by]])
            n += len(key)

        for b in batches:
            columns = [c.to_numpy() for c in b.columns]
            cuts = tk.runs(columns[1]).tolist()
            for lo, hi in zip(cuts, [*cuts[1:], b.num_rows]):
                if held and held[0][1][0] != columns[1][lo]:
                    put()
                    held = []
                held.append([c[lo:hi] for c in columns])
        if held:
            put()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    return run


@dataclass(frozen=True)
class Recurring:
    """path: folder of the sorted arrays of keys with their first ids; bits, file_bits: log2 of the numbers of shards and files."""

    path: str
    bits: int
    file_bits: int


def recurring(keys: DataFrame, per_shard: int = 1 << 20) -> Recurring:
    """The keys that recur of rows (key, id, needed)."""
    found = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.max("needed").alias("needed"))
    found = checkpointed(found.filter((F.col("n") >= F.col("needed")) & (F.col("first") != F.col("last"))).select("key", "first"))
    bits = max(0, math.ceil(math.log2(max(1, found.count() / per_shard))))
    file_bits = min(bits, 12)
    path = mounted(scratch(keys.sparkSession, "lines"))
    os.makedirs(path)
    high = lambda b: F.shiftrightunsigned("key", 64 - b).cast("int") if b else F.lit(0)
    rows = found.select(high(file_bits).alias("file"), high(bits).alias("shard"), "key", "first")
    rows.repartitionById(1 << file_bits, F.col("file")).sortWithinPartitions("shard").mapInArrow(tk.lean(kept_arrays(path, bits - file_bits)), "n long").collect()  # a row per file
    return Recurring(path, bits, file_bits)


def firsts(r: Recurring, keys: np.ndarray) -> np.ndarray:
    """First ids of recurring keys; LAST for those that don't recur."""
    by = np.argsort(keys, axis=None)
    ordered = keys.ravel()[by]
    out = np.full(len(ordered), LAST)
    for file, shard, lo, hi in by_shard(ordered, r.bits, r.file_bits):
        if (have := section(r.path, 0, file, shard, RECURRING)) is not None:
            at = np.minimum(np.searchsorted(have[0], ordered[lo:hi]), len(have[0]) - 1)
            hit = np.flatnonzero(have[0][at] == ordered[lo:hi])
            out[by[lo + hit]] = have[1][at[hit]]
    return out.reshape(keys.shape)


def without(text: str, lines: set[int], cuts: dict[int, list[tuple[int, int]]]) -> str:
    """The text without whole lines, and without bytes of others, each with a blank beside them."""
    out = []
    for k, line in enumerate(text.split("\n")):
        if k in lines:
            continue
        if k in cuts:
            data, at, kept = line.encode(), 0, []
            for a, b in sorted(cuts[k]):
                kept.append(data[at:a])
                at = max(at, b + (data[b : b + 1] == b" "))
            line = b"".join([*kept, data[at:]]).decode().rstrip(" ") if at >= len(data) else b"".join([*kept, data[at:]]).decode()
        out.append(line)
    return "\n".join(out)


def numbered(id: str, kind: T.DataType) -> Column:
    """A row's id as a long, null last; ids that aren't whole numbers stand in the order of their hash."""
    whole = isinstance(kind, T.IntegralType)
    return F.coalesce(F.col(f"`{id}`").cast("long") if whole else F.when(F.col(f"`{id}`").isNotNull(), F.xxhash64(F.col(f"`{id}`"))), F.lit(LAST))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """docs with dropped messages gone from `text`, and n_lines, n_dropped (lines with words), n_cut (sentences, and parts of passages in a line) added, in place of columns so named.

    Rows with equal ids are one document.  Null ids come after all others, are one
    document and never lose messages to one another.  Ids that aren't whole numbers
    are ordered by a hash.  Null and empty texts stay as they are; lines without
    words always stay.  Templates that stand in one id alone never recur.
    """
    number = numbered(id, docs.schema[id].dataType)
    own = spread(docs).select(number.alias("__id"), text_bytes(text).alias("__text"))
    kind = "key long, id long, needed int"
    parted = own.groupBy("__id").count().filter("count > 1").limit(1).count() > 0

    def counted(keys: DataFrame) -> Recurring:
        return recurring(keys.groupBy("key", "id").agg(F.max("needed").alias("needed")) if parted else keys)

    shared = counted(own.mapInArrow(tk.lean(seen(rules)), kind))
    whole = counted(own.mapInArrow(tk.lean(shared_windows(shared, rules)), kind))
    added = ("n_lines", "n_dropped", "n_cut")
    keep = [c for c in docs.columns if c not in added]
    rows = spread(docs).select(*(F.col(f"`{c}`") for c in keep), number.alias("__id"))

    def repeated(m: Messages, ids: np.ndarray) -> np.ndarray:
        """Words in windows that an earlier document has."""
        w = Windows(m.words, m.exact, rules)
        gone, start = w.told(shared, ids)
        start = np.concatenate([gone, start[firsts(whole, w.keys(start)) < ids[m.words.row[start]]]])
        n = len(m.words.row) + 1
        edge = np.bincount(start, minlength=n) - np.bincount(start + rules.passage, minlength=n)
        return np.cumsum(edge[:-1]) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text):
                ids = part.column("__id").to_numpy(zero_copy_only=False)
                m = Messages(tk.as_bytes(part.column(text)), rules)
                line, key = m.templates(firsts(shared, m.halves) < LAST)
                gone = firsts(shared, m.whole) < ids[m.row]
                gone[line[firsts(whole, key) < ids[m.row[line]]]] = True
                line, a, b = m.parts(repeated(m, ids))
                full = b - a == m.n[line]
                gone[line[full]] = True
                cut = ~full & ~gone[line]
                line, a, b = line[cut], a[cut], b[cut]
                sentence = np.flatnonzero(firsts(shared, m.key) < ids[m.row[m.of]])
                texts, n = part.column(text), part.num_rows
                if gone.any() or len(line) or len(sentence):
                    drop, cuts = defaultdict(set), defaultdict(lambda: defaultdict(list))
                    for r, k in zip(m.row[gone].tolist(), m.line[gone].tolist()):
                        drop[r].add(k)
                    within = sentence[~gone[m.of[sentence]]]
                    of = np.concatenate([m.of[within], line])
                    low = np.concatenate([m.start[within], m.words.starts[a] - m.starts[line]])
                    high = np.concatenate([m.end[within], m.words.ends[b - 1] - m.starts[line]])
                    for r, k, x, y in zip(m.row[of].tolist(), m.line[of].tolist(), low.tolist(), high.tolist()):
                        cuts[r][k].append((x, y))
                    values = texts.to_pylist()
                    for r in drop.keys() | cuts.keys():
                        values[r] = without(values[r], drop[r], cuts[r])
                    texts = pa.array(values, texts.type)
                each = lambda x: np.bincount(x, minlength=n)  # noqa: B023, E731
                counts = each(m.row), each(m.row[gone]), each(m.row[m.of[sentence]]) + each(m.row[line])
                yield pa.RecordBatch.from_arrays([*(part.column(c) if c != text else texts for c in keep), *map(pa.array, counts)], [*keep, *added])

    out = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in added)])
    return rows.mapInArrow(tk.lean(run), out)
