"""Personal data: fixed patterns, and identifiers that contexts learned from them reveal.

Base spans are found by the fixed patterns of KINDS.  They are the seeds:

1. A first pass finds base spans and identifier-like places (something around an @ or
   an "(at)", dotted or coloned numbers, 7 to 19 digits) with their contexts: the one
   and two tokens before and after them.
2. A context that SUPPORT different seeds of a kind stand beside is a pattern.  A second
   pass counts all places in the corpus where its tokens stand.
3. Patterns and instances score each other in turn: a pattern's confidence in a kind is
   the share of its places that hold known instances, weighted by their scores; an
   unknown instance's score is the chance that one of its patterns is right,
   1 - prod(1 - confidence).  New instances make further patterns.
4. A place beside a confident pattern whose instance scores high enough is a span of the
   pattern's kind.

Scores are sums over a table of distinct (context, instance) edges with their
numbers, so copies of a text weigh no more than one in a pattern's support, and
contexts that could never be confident, whatever stands there, are left out
before any round.  Offsets are code points.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import spread
from . import tokens as tk
from .lm import mapped_bytes
from .shared import checkpointed, mounted, scratch, text_bytes

U64 = tk.U64
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SUPPORT, CONFIDENT, ACCEPTED, ROUNDS = 3, 0.5, 0.8, 3
FILE_KEYS, MOST_FILES = 1 << 20, 4096
#: Kinds that an identifier-like place may be: by class (0 with an @, 1 dotted, 2 digits) and number of digits.
DIGITS = {CARD: (12, 19), PHONE: (7, 15)}

# --- base patterns, on UTF-8 bytes: what they name is ASCII


def _set(chars: bytes) -> frozenset:
    return frozenset(chars)


ALNUM = _set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | _set(b"._%+-")
AT = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGIT_RUN = re.compile(rb"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(rb"[^0-9]+")


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits[::-1]]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def _before(t: bytes, at: int, low: int, allowed: frozenset) -> int:
    """Where the run of allowed bytes that ends at `at` begins, not before `low`."""
    while at > low and t[at - 1] in allowed:
        at -= 1
    return at


def base_spans(t: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of all base spans, by kind and start; time grows with the text's length."""
    out, last = [], 0
    for m in AT.finditer(t):
        if (start := _before(t, m.start(), last, LOCAL)) < m.start():
            out.append((EMAIL, start, m.end()))
            last = m.end()
    out += [(IP, m.start(), m.end()) for m in DOTTED.finditer(t) if all(len(p.lstrip(b"0")) < 4 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))]
    for kind, rx, least, most in ((CARD, DIGIT_RUN, 13, 19), (PHONE, PLUS, 9, 15)):
        for m in rx.finditer(t):
            digits = NOT_DIGIT.sub(b"", m[0])
            if least <= len(digits) <= most and (kind == PHONE or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


# --- identifier-like places

PART = rb"[^\x00-\x20@<>(){}\[\]\"',;:|]"
PARTS = frozenset(range(0x21, 0x100)) - _set(b"@<>(){}[]\"',;:|")
AROUND = re.compile(rb"(?:@| ?[\[({](?:at|AT|At)[\])}] ?)(" + PART + rb"++(?: ?[\[({](?:dot|DOT|Dot)[\])}] ?" + PART + rb"++)*)")
NUMBERS = re.compile(rb"(?<![0-9A-Za-z.:])(?:[0-9]++(?:\.[0-9]++){2,}|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7})(?![0-9A-Za-z:])")
DIGITED = re.compile(rb"(?<![0-9A-Za-z])(?:\+?\(?)[0-9](?:[ ().\-/]{0,2}[0-9])++(?![0-9A-Za-z])")


def places(t: bytes, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(class, start, end) of identifier-like places that meet neither a base span nor one another."""
    taken, found = sorted((s, e) for _, s, e in base), []
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)).tolist() if taken else []

    def free(s: int, e: int) -> bool:
        k = bisect_left(starts, e)
        return not k or reach[k - 1] <= s

    last = 0
    for m in AROUND.finditer(t):
        start, end = _before(t, m.start(), last, PARTS), m.end()
        while end > m.start(1) and t[end - 1] in b".!?":
            end -= 1
        if start < m.start() and end > m.start(1) and free(start, end):
            found.append((0, start, end))
            last = end
    for cls, rx in ((1, NUMBERS), (2, DIGITED)):
        own = []
        for m in rx.finditer(t):
            if m.end() > m.start() and free(m.start(), m.end()) and (cls == 1 and any(c in m[0] for c in b"0123456789") or 7 <= len(NOT_DIGIT.sub(b"", m[0])) <= 19):
                own.append((cls, m.start(), m.end()))
        if own and found:
            mine = np.array(sorted((s, e) for _, s, e in found))
            ends = np.maximum.accumulate(mine[:, 1])
            k = np.searchsorted(mine[:, 0], [e for _, _, e in own])
            own = [p for p, i in zip(own, k.tolist()) if not i or ends[i - 1] <= p[1]]
        found += own
    return found


# --- contexts: tokens end at white space, and after : and =


BREAK = np.zeros(256, bool)
BREAK[[*b":="]] = True
LETTER = np.zeros(256, bool)
LETTER[sorted(ALNUM)] = True
LETTER[128:] = True


def context_tokens(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, cut = ~tk.SPACE[buf], BREAK[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | cut[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | cut[:-1] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _pairs(h: np.ndarray) -> np.ndarray:
    return tk.combine(h[:-1], h[1:])


class Contexts:
    """Tokens of a slice's rows, with the hashes of each token and of each two of a row."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.buf = tk.LOWER[buf]
        self.starts, self.ends = context_tokens(self.buf, bounds)
        self.one = tk.hash_spans(self.buf, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, bounds)
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(self.first))
        self.two, self.joined = _pairs(self.one) if len(row) else self.one, row[1:] == row[:-1]

    def beside(self, row: int, start: int, end: int) -> list[tuple[int, int]]:
        """(side, hash) of the contexts of a span: one and two tokens before (0) and after (1); none on a side where the span is part of a longer word."""
        low, high, out = int(self.first[row]), int(self.first[row + 1]), []
        k = int(np.searchsorted(self.starts, start, "right")) - 1
        if k >= low and not LETTER[self.buf[self.starts[k] : start]].any():
            if k > low:
                out.append((0, self.one[k - 1]))
            if k > low + 1:
                out.append((0, self.two[k - 2]))
        k = int(np.searchsorted(self.ends, end))
        if k < high and not LETTER[self.buf[end : self.ends[k]]].any():
            if k + 1 < high:
                out.append((1, self.one[k + 1]))
            if k + 2 < high:
                out.append((1, self.two[k + 1]))
        return [(side, int(h.view(np.int64))) for side, h in out]


#: cls: 0 to 2; kind: of a base span, else null; instance: hash of its letters and digits.
PLACE = "array<struct<kind: int, cls: int, start: long, end: long, digits: int, instance: long, contexts: array<struct<side: int, g: long>>>>"
_CLASS = {EMAIL: 0, IP: 1, CARD: 2, PHONE: 2}
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("cls", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("digits", pa.int32()), ("instance", pa.int64()), ("contexts", pa.list_(pa.struct([("side", pa.int32()), ("g", pa.int64())])))]))


def _instances(spans: list[bytes]) -> np.ndarray:
    """Hashes of spans' letters, digits and signs of addresses, lower-cased."""
    plain = [re.sub(rb"[ ()\-/+]", b"", s).lower() for s in spans]
    buf = np.frombuffer(b"".join(plain), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
    return tk.hash_spans(buf, ends - np.fromiter(map(len, plain), np.int64, len(plain)), ends).view(np.int64)


def _found(carried: list[str]):
    """For mapInArrow: the carried columns and each row's places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                buf, bounds = tk.raw(part.column("__text"))
                points = np.zeros(len(buf) + 1, np.int64)
                np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
                contexts, out = Contexts(buf, bounds), []
                for row, (lo, hi) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    t = buf[lo:hi].tobytes()
                    base = base_spans(t)
                    own = [(k, _CLASS[k], s, e) for k, s, e in base] + [(None, c, s, e) for c, s, e in places(t, base)]
                    of = _instances([t[s:e] for _, _, s, e in own]).tolist()
                    out.append([
                        {"kind": k, "cls": c, "start": int(points[lo + s] - points[lo]), "end": int(points[lo + e] - points[lo]), "digits": len(NOT_DIGIT.sub(b"", t[s:e])), "instance": i, "contexts": [{"side": a, "g": g} for a, g in contexts.beside(row, lo + s, lo + e)]}
                        for (k, c, s, e), i in zip(own, of)
                    ])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(out, _ARROW)], [*carried, "__places"])

    return run


# --- how often contexts stand in the corpus


def _key_writer(path: str):
    """For mapInArrow over ranges of sorted keys g: a file of them; a row (first, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.zeros(0, np.int64), *(b.column("g").to_numpy() for b in batches)])
        if len(keys):
            name = str(TaskContext.get().partitionId())
            held = f"{path}/.{name}-{os.urandom(6).hex()}"
            with open(held, "wb") as f:
                f.write(np.sort(keys).data)
            os.replace(held, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([int(keys.min())]), pa.array([name])], ["first", "name"])

    return run


def _counting(path: str, files: list[tuple[int, str]]):
    """For mapInArrow: how often the keys of the files stand in the texts, as one token or two."""
    bounds = np.array([first for first, _ in files], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [mapped_bytes(f"{path}/{name}").view(np.int64) for _, name in files]
        sums = [np.zeros(len(k), np.int64) for k in kept]
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                c = Contexts(*tk.raw(part.column("__text")))
                h, n = np.unique(np.concatenate([c.one, c.two[: len(c.joined)][c.joined]]).view(np.int64), return_counts=True)
                cuts = [*np.searchsorted(h, bounds).tolist(), len(h)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if hi > lo:
                        at = np.minimum(np.searchsorted(kept[k], h[lo:hi]), len(kept[k]) - 1)
                        hit = kept[k][at] == h[lo:hi]
                        sums[k][at[hit]] += n[lo:hi][hit]
        for k, s in zip(kept, sums):
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(k[some]), pa.array(s[some])], ["g", "n"])

    return run


def corpus_counts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(g, n): how often each of the keys (g), distinct, stands in the texts (__text).

    The sorted keys lie in the shared folder, in at most MOST_FILES files that workers
    map into memory; a task holds a number for each key.
    """
    path = mounted(scratch(texts.sparkSession, "contexts"))
    os.makedirs(path)
    files = min(MOST_FILES, 1 + keys.count() // FILE_KEYS)
    names = keys.repartitionByRange(files, "g").mapInArrow(_key_writer(path), "first long, name string").collect()
    if not names:
        return keys.withColumn("n", F.lit(0).cast("long"))
    return spread(texts).mapInArrow(tk.lean(_counting(path, sorted((r.first, r.name) for r in names))), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


# --- patterns and instances


def _may_be(kind: Column) -> Column:
    """Whether an instance (cls, digits) may be of the kind."""
    wide = [(kind == k) & F.col("digits").between(*DIGITS[k]) for k in DIGITS]
    return F.when(F.col("cls") == 2, reduce(lambda a, b: a | b, wide)).otherwise(F.col("cls") == kind)


def patterns_of(edges: DataFrame, scores: DataFrame, totals: DataFrame, support: int, confident: float) -> DataFrame:
    """(g, side, kind, confidence): contexts that enough known instances stand beside, and that hold few others."""
    own = edges.join(scores, ["instance", "cls"]).groupBy("g", "side", F.col("of").alias("kind")).agg(F.sum(F.col("n") * F.col("score")).alias("known"), F.sum((F.col("score") >= confident).cast("long")).alias("support"))
    out = own.filter(F.col("support") >= support).join(totals.withColumnRenamed("n", "all"), "g")
    return out.withColumn("confidence", F.col("known") / (F.col("all") + 1)).filter(F.col("confidence") >= confident).select("g", "side", "kind", "confidence")


def bootstrapped(edges: DataFrame, totals: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Patterns (g, side, kind, confidence) and scores (instance, cls, of, score) after some rounds of scoring each other.

    edges: (g, side, instance, cls, digits, kind, n), distinct but for n; kind is null
    where the instance isn't a base span.  totals: (g, n), places in the corpus.
    """
    seeds = edges.filter("kind is not null").select("instance", "cls", F.col("kind").alias("of")).distinct().withColumn("score", F.lit(1.0))
    unknown = edges.filter("kind is null")
    scores = seeds
    for _ in range(rounds):
        patterns = checkpointed(patterns_of(edges, scores, totals, support, confident))
        new = unknown.join(patterns.withColumnRenamed("kind", "of"), ["g", "side"]).filter(_may_be(F.col("of")))
        new = new.groupBy("instance", "cls", "of").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = checkpointed(seeds.union(new.join(seeds, ["instance", "cls", "of"], "left_anti")))
    return patterns, scores


def extracted(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), support: int = SUPPORT, confident: float = CONFIDENT, accepted: float = ACCEPTED, rounds: int = ROUNDS) -> DataFrame:
    """(id, the kept columns, spans): for each row its spans (kind, start, end, base), by kind in the order of KINDS, then start.

    Null and empty texts have no spans; repeated rows have each their own; a table
    without rows gives none.
    """
    carried = {"__id": id, **{f"__{k}": c for k, c in enumerate(keep)}}
    rows = docs.select(*(F.col(f"`{c}`").alias(a) for a, c in carried.items()), text_bytes(text).alias("__text"))
    schema = T.StructType([*(T.StructField(a, docs.schema[c].dataType) for a, c in carried.items()), *T.StructType.fromDDL(f"__places {PLACE}").fields])
    held = checkpointed(spread(rows).mapInArrow(tk.lean(_found([*carried])), schema).withColumn("__row", F.monotonically_increasing_id()))
    place = held.select("__row", F.explode("__places").alias("p")).select("__row", "p.*")
    beside = place.select("__row", "kind", "cls", "start", "end", "digits", "instance", F.explode("contexts").alias("c")).select("*", "c.g", "c.side")
    edges = checkpointed(beside.groupBy("g", "side", "instance", "cls", "digits", "kind").agg(F.count("*").alias("n")))
    # contexts that enough seeds stand beside in the end have some already, or new instances: at least `support` instances
    some = checkpointed(edges.groupBy("g", "side").agg(F.sum("n").alias("places"), F.count("*").alias("instances")).filter(F.col("instances") >= support))
    totals = checkpointed(corpus_counts(rows.select("__text"), some.select("g").distinct()))
    # whatever the rounds say, no context is surer than all of its places together
    open_ = checkpointed(some.join(totals, "g").filter(F.col("places") >= confident * (F.col("n") + 1)).select("g", "side", "n"))
    patterns, scores = bootstrapped(checkpointed(edges.join(open_.select("g", "side"), ["g", "side"])), open_.select("g", "n").distinct(), support, confident, rounds)
    near = beside.filter("kind is null").join(patterns.withColumnRenamed("kind", "of"), ["g", "side"]).select("__row", "start", "end", "instance", "cls", "of").distinct()
    sure = near.join(scores.filter(F.col("score") >= accepted), ["instance", "cls", "of"])
    best = sure.groupBy("__row", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("of")))["of"].alias("of"))
    more = best.groupBy("__row").agg(F.collect_list(F.struct(F.col("of").alias("kind"), "start", "end", F.lit(False).alias("base"))).alias("__more"))
    base = F.transform(F.filter("__places", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"), F.lit(True).alias("base")))
    both = F.array_sort(F.concat(base, F.coalesce("__more", F.array().cast("array<struct<kind: int, start: bigint, end: bigint, base: boolean>>"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    spans = F.transform(both, lambda p: F.struct(name(p["kind"]).alias("kind"), p["start"].alias("start"), p["end"].alias("end"), p["base"].alias("base")))
    return held.join(more, "__row", "left").select(*(F.col(a).alias(c) for a, c in carried.items()), spans.alias("spans"))


def redacted(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, text): texts in which each span is replaced by its kind in brackets, overlapping spans by the first one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, spans in zip(b.column("__t").to_pylist(), b.column("spans").to_pylist()):
                parts, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["end"] > at:
                        parts += [t[at : s["start"]], f"[{s['kind']}]"] if s["start"] >= at else []
                        at = s["end"]
                out.append(None if t is None else "".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], [id, text])

    found = extracted(docs.withColumn("__t", F.col(f"`{text}`").cast("string")), id, text, keep=("__t",), **options)
    return found.mapInArrow(run, T.StructType([T.StructField(id, docs.schema[id].dataType), T.StructField(text, T.StringType())]))
