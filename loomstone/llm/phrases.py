"""Phrase collocations: count-min sketches first, exact counts of what survives.

Texts are lower-cased A-Z and cut into pieces at `[.,;:!?\\x0A-\\x0D]`, pieces into
words `[^\\x20\\x09]+`.  Everything is counted per language (null: `und`).

Sketches: a pass hashes the runs of one and two words of each piece; a run has a
cell in each of three rows of counters.  Tasks count cells in bounded chunks; the
counts of a stretch of cells meet in one task, are added up and leave one bit a
cell: whether it has reached the least frequency.  A cell's sum is never less than
the frequency of a run in it, so no frequent run is lost whatever the rows' width.
A second pass sketches in the same way the runs of three and four words all of whose
pairs survive the first.

Exact counts: a third pass maps the bits into memory and keeps the runs all of
whose cells have their bit and whose shorter parts survive too.  A task counts those
by hash, a bounded number at a time, and deals out their texts and counts in blocks
by the hash; the blocks of a stretch of hashes meet in one task and are added up by text.

The width grows with the text, a cell for some 16 bytes, up to 2 ** MOST_BITS; beyond, the
sketch lets more runs through to the exact pass, and the result is the same.
Frequencies, scores, dropping and ranks are DataFrame operations on exact numbers.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import spread
from . import tokens as tk
from .lm import mapped_bytes, packed, unpacked
from .shared import checkpointed, mounted, scratch, text_bytes

U64 = tk.U64
LONGEST = 4
LEAST, TOP, SCALE, COVERED = 30, 2000, 2_000_000, 80
ROWS = 3
#: Numbers of words of the runs in each sketch.
LEVELS = ((1, 2), (3, 4))
CELL_BYTES = 16
LEAST_BITS, MOST_BITS = 16, 36
SHARD_BITS = 20
CHUNK = 1 << 21
MOST_BLOCKS = 12
SLICE = 1 << 20
#: Cut a piece, and cut words in a piece.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?\n\v\f\r"]] = True
BETWEEN = PIECE.copy()
BETWEEN[[*b" \t"]] = True
BLOCK = "shard long, payload binary"
COUNTS = "lang binary, phrase binary, k int, n long"


def _runs(part: pa.RecordBatch) -> tuple[tk.Words, list[np.ndarray], list[np.ndarray]]:
    """Words of a slice; hashes of the runs of 1 to LONGEST words that begin at each word, apart by language; whether the run stays in its piece."""
    w = tk.words(part.column("text"), BETWEEN, lower=True)
    n = len(w.starts)
    _, bounds = tk.raw(part.column("lang"))
    langs = tk.hash_spans(tk.raw(part.column("lang"))[0], bounds[:-1], bounds[1:])
    piece = np.cumsum(PIECE[w.buf])[w.starts] if n else np.zeros(0, np.int64)
    linked = np.zeros(n, bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (w.row[1:] == w.row[:-1])
    word = w.hashes()
    hashes, whole = [tk.combine(langs[w.row], word)], [np.ones(n, bool)]
    for k in range(1, LONGEST):
        h, inside = np.zeros(n, U64), np.zeros(n, bool)
        if n > k:
            h[: n - k] = tk.combine(hashes[-1][: n - k], word[k:])
            inside[: n - k] = whole[-1][: n - k] & linked[k - 1 : n - 1]
        hashes.append(h)
        whole.append(inside)
    return w, hashes, whole


def _cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell in each row: leading bits of the hash and of others made of it."""
    kind = np.uint32 if bits <= 32 else U64
    return [((tk.mix(h + U64(row)) if row else h) >> U64(64 - bits)).astype(kind) for row in range(ROWS)]


def _bits_of(path: str, level: int) -> list[np.ndarray]:
    return [mapped_bytes(f"{path}/{level}-{row}") for row in range(ROWS)]


def _alive(h: np.ndarray, rows: list[np.ndarray], bits: int) -> np.ndarray:
    """Whether all cells of a run have their bit."""
    out = np.ones(len(h), bool)
    for cells, held in zip(_cells(h, bits), rows):
        out &= (held[cells >> cells.dtype.type(3)] >> (cells & cells.dtype.type(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
    return out


def _beside(lives: np.ndarray, k: int) -> np.ndarray:
    """Whether the k runs that begin at a word and those after it all live."""
    out = lives.copy()
    for j in range(1, k):
        out[: len(out) - j] &= lives[j:]
        out[max(0, len(out) - j) :] = False
    return out


def _sketching(path: str, level: int, bits: int, least: int):
    """For mapInArrow: counts of cells up to `least`, in chunks, cut into shards."""

    def dealt(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        shards, payloads = [], []
        h = np.concatenate(hashes)
        for row, cells in enumerate(_cells(h, bits)):
            cells.sort()
            starts = tk.runs(cells)
            counts = np.minimum(np.diff(starts, append=len(cells)), least).astype(U64)
            cells = cells[starts]
            own = (cells >> cells.dtype.type(SHARD_BITS)).astype(np.int64)
            cuts = tk.runs(own)
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
                shards.append((row << (bits - LEAST_BITS)) + int(own[lo]))
                payloads.append(packed([cells[lo:hi].astype(U64) & U64((1 << SHARD_BITS) - 1)], counts[lo:hi]))
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(payloads, pa.binary())], ["shard", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        pairs = _bits_of(path, 0) if level else []
        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                _, hashes, whole = _runs(part)
                if level:
                    lives = whole[1].copy()
                    lives[lives] = _alive(hashes[1][lives], pairs, bits)
                    whole = [inside & _beside(lives, k) if k else inside for k, inside in enumerate(whole)]
                held += [hashes[k - 1][whole[k - 1]] for k in LEVELS[level]]
                n += sum(map(len, held[-len(LEVELS[level]) :]))
                if n >= CHUNK:
                    yield from dealt(held)
                    held, n = [], 0
        if n:
            yield from dealt(held)

    return run


def _merging(path: str, level: int, bits: int, least: int):
    """For mapInArrow over rows sorted by shard: adds up each shard's counts, one block at a time, and writes a bit for each cell that has reached `least`.  A task that runs again writes the same bits."""

    def write(shard: int, sums: np.ndarray) -> None:
        row, own = shard >> (bits - LEAST_BITS), shard & ((1 << (bits - LEAST_BITS)) - 1)
        with open(f"{path}/{level}-{row}", "r+b") as f:
            f.seek(own << (SHARD_BITS - 3))
            f.write(np.packbits(sums >= least, bitorder="little")[: 1 << (bits - 3)].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, done = None, np.zeros(1 << SHARD_BITS, np.int32), 0
        for b in batches:
            for shard, payload in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    if now is not None:
                        write(now, sums)
                    now, done = shard, done + 1
                    sums[:] = 0
                cells, counts = unpacked(payload)
                cells = cells.astype(np.int64)
                sums[cells] = np.minimum(sums[cells] + counts.astype(np.int32), least)
        if now is not None:
            write(now, sums)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["shards"])

    return run


RUNS = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("k", pa.int32()), ("n", pa.int64())])


def _sealed(runs: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, RUNS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(runs)
    return out.getvalue().to_pybytes()


def _added(parts: list[pa.Table]) -> pa.Table:
    """Equal runs of tables added up."""
    sums = pa.concat_tables(parts).combine_chunks().group_by(["lang", "phrase", "k"], use_threads=False).aggregate([("n", "sum")])
    return sums.rename_columns({"n_sum": "n"}).select(RUNS.names)


def _adding(least: int):
    """For mapInArrow over blocks sorted by shard: runs with at least `least` occurrences, and numbers of words (k = 0).  Blocks are added up as soon as they hold CHUNK // 2 runs."""

    def done(parts: list[pa.Table]) -> list[pa.RecordBatch]:
        out = _added(parts)
        return out.filter((pc.field("k") == 0) | (pc.field("n") >= least)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [RUNS.empty_table()], 0
        for b in batches:
            for shard, payload in zip(*(c.to_pylist() for c in b.columns)):
                if shard != now:
                    yield from done(parts)
                    now, parts, size = shard, [RUNS.empty_table()], 0
                parts.append(pa.ipc.open_stream(payload).read_all())
                size += parts[-1].num_rows
                if size >= CHUNK // 2:
                    parts, size = [_added(parts)], 0
        yield from done(parts)

    return run


def _surviving(path: str, bits: int):
    """For mapInArrow: blocks of the runs that survive the sketches, and of all words of a language (k = 0), with their counts."""
    inner = min(MOST_BLOCKS, max(0, bits - SHARD_BITS + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [held for level, ks in enumerate(LEVELS) for held in [_bits_of(path, level)] * len(ks)]
        known, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        texts: list[pa.RecordBatch] = []  # of the known runs, in the order of `seen`
        seen: list[np.ndarray] = []
        totals = RUNS.empty_table()

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal known, counts, texts, seen
            if seen:
                h = np.concatenate(seen)
                runs = pa.Table.from_batches(texts).append_column("n", pa.array(counts[np.searchsorted(known, h)])).combine_chunks()
                shard = (h >> U64(64 - inner)).astype(np.int64) if inner else np.zeros(len(h), np.int64)
                by = np.argsort(shard, kind="stable")
                runs, cuts = runs.take(pa.array(by)), tk.runs(shard[by])
                ends = [*cuts[1:].tolist(), len(by)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[by][cuts]), pa.array([_sealed(runs.slice(lo, hi - lo)) for lo, hi in zip(cuts.tolist(), ends)], pa.binary())], ["shard", "payload"])
            known, counts, texts, seen = np.zeros(0, U64), np.zeros(0, np.int64), [], []

        for batch in batches:
            for part in tk.slices(batch, "text", SLICE):
                w, hashes, whole = _runs(part)
                lengths = w.ends - w.starts
                new = np.cumsum(lengths + 1) - (lengths + 1)
                at = np.arange(int(lengths.sum())) + np.repeat(w.starts - (np.cumsum(lengths) - lengths), lengths)
                spaced = np.full(int((lengths + 1).sum()), 0x20, np.uint8)  # words with one space between them
                spaced[np.arange(len(at)) + np.repeat(np.arange(len(lengths)), lengths)] = w.buf[at]
                lives = np.zeros(0, bool)
                for k, (h, inside) in enumerate(zip(hashes, whole), 1):
                    here = inside.copy()
                    if k > 1:
                        here[:-1] &= lives[:-1] & lives[1:]
                    where = np.flatnonzero(here)
                    where = where[_alive(h[where], rows[k - 1], bits)]
                    lives = np.zeros(len(h), bool)
                    lives[where] = True
                    own, first, n = np.unique(h[where], return_index=True, return_counts=True)
                    spot = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
                    old = known[spot] == own if len(known) else np.zeros(len(own), bool)
                    counts[spot[old]] += n[old]
                    fresh = ~old
                    if fresh.any():
                        begin = where[first[fresh]]
                        texts.append(pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(w.row[begin])), _cut(spaced, new[begin], new[begin + k - 1] + lengths[begin + k - 1]), pa.array(np.full(len(begin), k, np.int32))], ["lang", "phrase", "k"]))
                        seen.append(own[fresh])
                        merged = np.concatenate([known, own[fresh]])
                        by = np.argsort(merged, kind="stable")
                        known, counts = merged[by], np.concatenate([counts, n[fresh]])[by]
                totals = _added([totals, _totals(part, w)])
                if len(known) >= CHUNK // 2:
                    yield from flushed()
        yield from flushed()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([_sealed(totals)], pa.binary())], ["shard", "payload"])

    return run


def _cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary column."""
    size = ends - starts
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    data = buf[np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], size)]
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _totals(part: pa.RecordBatch, w: tk.Words) -> pa.Table:
    """Numbers of words by language."""
    langs = part.column("lang").dictionary_encode()
    n = np.bincount(langs.indices.to_numpy(zero_copy_only=False), w.counts, len(langs.dictionary)).astype(np.int64)
    return pa.table([langs.dictionary, pa.array([b""] * len(n), pa.binary()), pa.array(np.zeros(len(n), np.int32)), pa.array(n)], schema=RUNS)


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, phrase, k, n): runs of k = 1 to 4 words with at least `least` occurrences, and the number of all words (k = 0, an empty phrase).

    bits: log2 of the cells of a row, 16 at least; by the texts' bytes if not given.
    """
    rows = spread(docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).cast("binary").alias("lang"), text_bytes(text).alias("text")))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))
    path = mounted(scratch(docs.sparkSession, "sketch"))
    os.makedirs(path)
    for level in range(len(LEVELS)):
        for r in range(ROWS):  # sparse: cells that nothing is in
            with open(f"{path}/{level}-{r}", "wb") as f:
                f.truncate(1 << (bits - 3))
        blocks = rows.mapInArrow(tk.lean(_sketching(path, level, bits, least)), BLOCK)
        blocks.repartition(F.col("shard")).sortWithinPartitions("shard").mapInArrow(tk.lean(_merging(path, level, bits, least)), "shards long").agg(F.sum("shards")).collect()
    blocks = rows.mapInArrow(tk.lean(_surviving(path, bits)), BLOCK).repartition(F.col("shard")).sortWithinPartitions("shard")
    return checkpointed(blocks.mapInArrow(tk.lean(_adding(least)), COUNTS).select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "k", "n"))


def _words(phrase: Column, first: Column, number: Column) -> Column:
    """So many words of a phrase from the first-th (from 1) on."""
    return F.array_join(F.slice(F.split(phrase, " "), first, number), " ")


def scored(counts: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, phrase, k, a, l, r, score): candidates with their lowest-scoring cut, the smallest one in a tie.  Parts of a frequent run are as frequent, so they are all in `counts`."""
    runs = counts.filter("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    cuts = runs.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": _words(F.col("phrase"), F.lit(1), F.col("cut")), "right": _words(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut"))})
    part = lambda side, name: counts.filter("k > 0").select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"cast({scale} as decimal(9, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = F.min(F.struct(score.alias("score"), F.col("cut"), F.col("l"), F.col("r")))
    return both.groupBy("lang", "phrase", "k", "a").agg(best.alias("best")).select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score")


def kept(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Candidates that lie in no longer one with at least `covered` percent of their occurrences."""
    longer = candidates.filter("k > 2").select("lang", "phrase", "k", F.col("a").alias("f"))
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    inside = longer.select("lang", "phrase", "f", F.explode(spots).alias("s")).select("lang", _words(F.col("phrase"), F.col("s.i"), F.col("s.n")).alias("phrase"), "f")
    most = inside.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    hundredths = lambda c, k: F.lit(k).cast("decimal(3,0)") * F.col(c).cast("decimal(19,0)")
    return candidates.join(most, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (hundredths("f", 100) < hundredths("a", covered))).drop("f")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two to four words.

    By score, then frequency (both descending), then phrase in byte order.  A language
    that holds most candidates is ranked in parts first.  Null texts are empty, a null
    language is `und`; repeated rows count each time; without frequent phrases there
    are no rows; other columns are not read.
    """
    counts = frequencies(docs, text, lang, least, bits)
    found = kept(checkpointed(scored(counts)))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = found.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("__nth", nth("lang", "__part")).filter(F.col("__nth") <= top)
    ranked = some.withColumn("rank", nth("lang")).filter(F.col("rank") <= top)
    totals = counts.filter("k = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
