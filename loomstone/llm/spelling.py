"""Spelling variants: words one edit apart, found in a trie with one erratum.

Words stand in a trie.  At each node the child with the most words below is heavy,
the others, and the end of a word, are light: a word has no more light steps than
the logarithm of the number of words.  Light subtrees are merged into what lies
beside them, small into large, with one character skipped or replaced:

- a light step skipped is the word without that character;
- a light step replaced by the heavy character is a word of the heavy subtree;
- the heavy character put before a light step, or before the end, is a word of the
  heavy subtree with one character more;
- light subtrees of a node meet each other with their first character replaced.

Where terminals coincide two words are one edit apart.  Each such pair is met once,
at the place where its words part.  Light subtrees that meet are counted, with
their two most frequent words, and never listed as pairs.

Words, nodes and merged terminals are keyed by polynomial hashes of code points,
two of 64 bits for terminals, so a long word costs as many rows as it has code points,
all of one size.  Nodes that share a hash share a heavy character, which is as good as another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import numbered
from . import tokens as tk
from .shared import checkpointed

U64 = tk.U64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
SHORTEST, LEAST, ONE_IN, RATIO = 5, 3, 97, 2
#: Multipliers of the two hashes, and their inverses.
BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
INVERSES = tuple(U64(pow(int(b), -1, 1 << 64)) for b in BASES)
END = -1


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", one_in: int = ONE_IN, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(word, n): runs of letters of all texts, lower-cased A-Z, with their number.

    A run of which crc32(`<id>:<run>`) is divisible by `one_in` loses its code point
    crc32 % length (a planted error; 0 plants none).  Null ids count as empty text.
    """
    lower = F.translate(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    if one_in:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        runs = runs.select("run", h.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))
    else:
        runs = runs.select(F.col("run").alias("word"))
    return runs.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# --- hashes of code points


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and where each word begins and the last ends."""
    texts = column.to_pylist()
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=first[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), first


def _value(points: np.ndarray) -> np.ndarray:
    return tk.mix(points.astype(U64) + U64(1))


def _prefix_sums(points: np.ndarray, first: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what precedes each step of each word (its code points and its end), and whole hashes of the words."""
    length = np.diff(first)
    at = np.arange(len(points)) - np.repeat(first[:-1], length)
    sums = np.zeros(len(points) + 1, U64)
    np.cumsum(_value(points) * _powers(base, int(length.max(initial=0)))[at], dtype=U64, out=sums[1:])
    steps = length + 1
    begin = np.repeat(sums[first[:-1]], steps)
    here = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps) + np.repeat(first[:-1], steps)
    return sums[here] - begin, sums[first[1:]] - sums[first[:-1]]


HASHED = "id long, n long, f1 long, f2 long"
STEPS = "id long, n long, f1 long, f2 long, i int, a1 long, a2 long, c int, d int"


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in columns], [f.split()[0] for f in schema.split(", ")])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        points, first = _points(b.column("word"))
        yield _batch(HASHED, b.column("id").to_numpy(), b.column("n").to_numpy(), *(_prefix_sums(points, first, p)[1] for p in BASES))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each step of each word: the node (hash of what precedes), the step's code point or END, and the code point after it."""
    for b in batches:
        for part in tk.slices(b, "word", 1 << 16):
            points, first = _points(part.column("word"))
            length = np.diff(first)
            steps = length + 1
            begin = np.cumsum(steps) - steps
            i = np.arange(int(steps.sum())) - np.repeat(begin, steps)
            c = np.full(len(i), END, np.int32)
            c[i < np.repeat(length, steps)] = points
            d = np.full(len(i), END, np.int32)
            d[:-1] = c[1:]
            d[begin + length] = END
            (a1, f1), (a2, f2) = (_prefix_sums(points, first, p) for p in BASES)
            own = [np.repeat(x, steps) for x in (part.column("id").to_numpy(), part.column("n").to_numpy(), f1, f2)]
            yield _batch(STEPS, *own, i.astype(np.int32), a1, a2, c, d)


#: kind: 0 another word's terminal, 1 a merged light subtree's.
MERGED = "kind int, id long, n long, i int, p1 long, p2 long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of light steps with their node's heavy code point h: terminals with the step skipped, replaced, or h put before it."""
    for b in batches:
        col = {n: b.column(n).to_numpy() for n in b.schema.names}
        i, c, h = col["i"], col["c"], col["h"]
        top = int(i.max(initial=0)) + 1
        real = c != END
        skipped, put, replaced = [], [], []
        for f, a, base, inverse in ((col["f1"], col["a1"], BASES[0], INVERSES[0]), (col["f2"], col["a2"], BASES[1], INVERSES[1])):
            f, a, power = f.view(U64), a.view(U64), _powers(base, top)[i]
            own, heavy = _value(np.maximum(c, 0).astype(np.uint32)) * power, _value(h.astype(np.uint32)) * power
            put.append(a + heavy + (f - a) * base)
            replaced.append((f - own + heavy)[real])
            skipped.append((a + (f - a - own) * inverse)[real])
        last = col["d"][real] != c[real]  # of a run of one character, skip the last
        for kind, keep, keys in ((0, None, put), (0, real, replaced), (0, last, skipped), (1, real, skipped)):
            rows = [col["id"], col["n"], i]
            if keep is last:
                rows, keys = [x[real][last] for x in rows], [k[last] for k in keys]
            elif keep is not None:
                rows = [x[real] for x in rows]
            yield _batch(MERGED, np.full(len(rows[0]), kind, np.int32), *rows, *keys)


def near(found: DataFrame) -> DataFrame:
    """(id, n_near, best): for words (id, word, n), distinct, the number of words one edit away and the best of them, (-n, id).

    ids are numbers in the order of the words.  Rows without a near word are left out.
    """
    whole = checkpointed(found.select("id", "word", "n").mapInArrow(tk.lean(_hashed), HASHED))
    steps = checkpointed(found.select("id", "word", "n").mapInArrow(tk.lean(_steps), STEPS))
    edges = steps.groupBy(F.col("i"), F.col("a1"), F.col("c")).agg(F.count("*").alias("below"))
    heavy = F.max(F.when(F.col("c") != END, F.struct("below", "c")))["c"]
    nodes = checkpointed(edges.groupBy("i", "a1").agg(heavy.alias("h"), F.count("*").alias("children")).filter("children > 1").select("i", "a1", "h"))
    light = steps.join(nodes, ["i", "a1"]).filter("c <> h").select(*[f.split()[0] for f in STEPS.split(", ")], "h")
    merged = checkpointed(light.mapInArrow(tk.lean(_merged), MERGED))
    met = merged.filter("kind = 0").join(whole.select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("f1").alias("p1"), F.col("f2").alias("p2")), ["p1", "p2"])
    met = checkpointed(met.select("id", "n", "other", "m"))
    one = F.lit(1).cast("long")
    pairs = met.select("id", one.alias("k"), F.struct((-F.col("m")).alias("m"), F.col("other").alias("id")).alias("best"))
    back = met.select(F.col("other").alias("id"), one.alias("k"), F.struct((-F.col("n")).alias("m"), F.col("id")).alias("best"))
    # light steps of one node that lead to the same rest: at most an alphabet of them, counted with the first two
    group = Window.partitionBy("p1", "p2", "i")
    order = group.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = F.struct((-F.col("n")).alias("m"), F.col("id"))
    meeting = merged.filter("kind = 1").select("id", "n", "i", "p1", "p2").withColumns({"k": F.count("*").over(group) - 1, "first": F.first(at).over(order), "second": F.nth_value(at, 2).over(order)}).filter("k > 0")
    lights = meeting.select("id", F.col("k"), F.when(F.col("first.id") == F.col("id"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return pairs.union(back).union(lights).groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(id, root): follows (id, form) to the last; form is null at the end of a chain.

    A round doubles how far each id sees.  n at least doubles from word to form, so a
    chain has no more than 63 steps, and rounds are at most seven.
    """
    now = checkpointed(forms.select("id", F.coalesce("form", "id").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = checkpointed(now.join(on, "root").select("id", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = further.select("id", "root")
        if not further.agg(F.max("moved")).first()[0]:
            return now


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", one_in: int = ONE_IN, least: int = LEAST, shortest: int = SHORTEST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of at least `shortest` code points and `least` occurrences, with its variants.

    form: the near word of largest n (ties: smallest in code-point order) if that n is
    at least `ratio` times the word's, else null; root: what forms lead to.  Null and
    empty texts have no words; a table without words gives no rows; repeated rows count
    each time; columns other than id and text are not read.
    """
    found = checkpointed(numbered(words(docs, id, text, one_in, least, shortest), "id", F.col("word")))
    best = near(found)
    own = checkpointed(found.join(best, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.id")).alias("form"), F.when(-F.col("best.m") >= ratio * F.col("n"), -F.col("best.m")).alias("form_n")))
    named = lambda to: found.select(F.col("id").alias(f"{to}_id"), F.col("word").alias(to))
    out = own.withColumnRenamed("form", "form_id").join(rooted(own).withColumnRenamed("root", "root_id"), "id")
    out = out.join(named("root"), "root_id").join(named("form"), "form_id", "left")
    return out.select("word", "form", "root", "n", "n_near", "form_n")
