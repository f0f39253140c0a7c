"""Toxicity by class-conditional Kneser-Ney models.

Three trigram models with one vocabulary are counted in Spark from a bounded
sample of labelled texts: of class 1 (toxic), of class 0 (ordinary), and of both.
p(word | two words before, class) is the class's interpolated modified
Kneser-Ney probability, whose words back off to the shared model's words.

Rare expressions are smoothed through the shared counts whole: where neither the
word nor the bigram that it ends differs between the classes, by CAUTION standard
deviations and a factor of exp(MARGIN) in how many contexts it stands in, both
classes take the shared model's probability.  Language, style and chance then say
nothing about the class.

A text's contrast is its log-likelihood under class 1 less that under class 0, a
token (length normalised); tokens on which both take the shared model add
nothing to the difference and aren't looked up further.  A logistic curve of the
contrast, fitted on sampled rows that the models haven't counted and weighted to
the classes' shares in the labels, makes it a score.

Texts are lower-cased A-Z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, then
one end.  Only text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.shared import spread
from . import lm
from . import tokens as tk
from .sample import labelled
from .shared import text_bytes

ORDER = 3
#: Standard deviations (root of the likelihood ratio statistic) by which counts must differ.
CAUTION = 4.0
#: And the least difference of the logarithms of an expression's shares in the classes.
MARGIN = 1.0


@dataclass(frozen=True)
class Toxicity:
    """classes: models of class 0 and class 1 (empty if one has no rows); shared: of both; slope, offset: of the logistic curve; caution, margin: as CAUTION and MARGIN."""

    classes: tuple
    shared: lm.Model | None
    slope: float
    offset: float
    caution: float = CAUTION
    margin: float = MARGIN


def surprise(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Standard deviations by which counts a, of a + b, differ from their share."""
    n = a + b
    part = lambda x, q: x * np.log(np.maximum(x, 1e-9) / np.maximum(n * q, 1e-9))
    return np.sqrt(np.maximum(2 * (part(a, share) + part(b, 1 - share)), 0))


def differing(models: Toxicity, level: int, keys: np.ndarray) -> np.ndarray:
    """Whether the classes' counts of these n-grams differ enough to be told apart."""
    one, back = np.unique(keys, return_inverse=True)
    a, b = (lm.looked_up(m, level, one).astype(float) for m in models.classes)
    x, y = (m.totals[level - 1] for m in models.classes)
    apart = np.abs(np.log((b + 0.5) / (y + 1)) - np.log((a + 0.5) / (x + 1)))
    return ((surprise(b, a, y / (x + y)) >= models.caution) & (apart >= models.margin))[back]


def contrast(models: Toxicity, column: pa.Array) -> np.ndarray:
    """Log-likelihood under class 1 less that under class 0, a token."""
    n = len(column)
    if not models.classes:
        return np.zeros(n)
    w = tk.words(column, tk.NOT_ALNUM, lower=True)
    s, at, row = lm.stream(w, w.hashes(), ORDER)
    s = lm.numbered(models.shared.vocabulary, s)[0]
    total = np.zeros(n)
    for lo in range(0, len(at), lm.CHUNK >> 1):
        here, r = at[lo : lo + (lm.CHUNK >> 1)], row[lo : lo + (lm.CHUNK >> 1)]
        own = differing(models, 1, lm.ngram_keys([s[here]])[0]) | differing(models, 2, lm.ngram_keys([s[here - 1], s[here]])[0])
        here, r = here[own], r[own]
        base = lm.probabilities(models.shared, s, here, 1)
        p, q = (np.log(lm.probabilities(m, s, here, base=base)) for m in models.classes)
        total += np.bincount(r, q - p, n)
    return total / (w.counts + 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset by Newton's method, with a light pull of the slope in units of the spread."""
    spread = float(x.std()) or 1.0
    z = np.stack([x / spread, np.ones(len(x))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
        pull = np.array([1e-3, 1e-6])
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (weight * (y - p)) - pull * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(b[0]) / spread, 0.0), float(b[1])


def contrasts(models: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(contrast(models, part.column("text")))], ["y", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 5000, label: str = "toxic", seed: int = 29, caution: float = CAUTION, margin: float = MARGIN) -> Toxicity:
    """Models and curve from at most per_class labelled documents of either class.

    Equal texts of a class count once; three
    quarters of the sample are counted, the rest fit the curve.  Without
    rows of both classes every score is the share of class 1 in the labels (0.5
    without labels).
    """
    rows, held = labelled(docs, labels, label, per_class, seed)
    rows = rows.dropDuplicates(["y", "text"])
    part = F.xxhash64(F.lit(seed + 1), F.col("text")).bitwiseAND(3) > 0
    counted, fitted = rows.filter(part), rows.filter(~part)
    have = {r.y: r["count"] for r in counted.groupBy("y").count().collect()}
    share = held[1] / max(1, held[0] + held[1]) if held[0] + held[1] else 0.5
    flat = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not (have.get(0) and have.get(1)):
        return Toxicity((), None, 0.0, flat)
    words = lm.vocabulary(counted, separators=tk.NOT_ALNUM)
    *classes, shared = (lm.fit(x, ORDER, separators=tk.NOT_ALNUM, words=words) for x in (counted.filter("y = 0"), counted.filter("y = 1"), counted))
    models = Toxicity(tuple(classes), shared, 0.0, flat, caution, margin)
    got = sorted(fitted.select("y", "text").mapInArrow(tk.lean(contrasts(models)), "y int, x double").collect())
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got])
    if not (0 < y.sum() < len(y)):
        return models
    weight = np.where(y == 1, held[1] / y.sum(), held[0] / (y == 0).sum()) * len(y) / (held[0] + held[1])
    slope, offset = logistic(x, y, weight)
    return replace(models, slope=slope, offset=offset)


def scored(docs: DataFrame, models: Toxicity, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """A row per row of docs: `keep`, contrast, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts are scored by their end alone.  Repeated rows get equal
    scores; other columns are not read.
    """
    rows = spread(docs.select(*(F.col(f"`{c}`") for c in keep), text_bytes(text).alias("__text")))
    names = [*keep, "contrast", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, "__text"):
                x = contrast(models, part.column("__text"))
                s = 1 / (1 + np.exp(-np.clip(models.slope * x + models.offset, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(x), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names)

    return rows.mapInArrow(tk.lean(run), T.StructType([*(f for f in rows.schema.fields if f.name in keep), T.StructField("contrast", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def kept(docs: DataFrame, models: Toxicity, text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, unchanged, with all their columns; all of them without models, when no labels of both classes tell them apart."""
    if models.shared is None:
        return docs
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.clip(models.offset, -500, 500)
        for batch in batches:
            for part in tk.slices(batch, text):
                keep = models.slope * contrast(models, tk.as_bytes(part.column(text))) + flat < 0
                yield part.filter(pa.array(keep))

    return spread(docs).mapInArrow(tk.lean(run), schema)
