"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age(then: Column, as_of: Column, unit_seconds: float) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6 / unit_seconds


def time_decay(stamp: Column, as_of: Column, days: float = 7.0) -> Column:
    """1 / (1 + age / days) of an ISO-8601 text; 0.5 without a valid one."""
    return F.coalesce(1.0 / (1.0 + age(F.try_to_timestamp(stamp), as_of, 86400) / days), F.lit(0.5))


def keyword_score(matches: Column, query_size: Column) -> Column:
    return F.when(query_size > 0, matches / query_size).otherwise(0.0)


def relevance(keyword: Column, project: Column, decay: Column, keyword_weight: float = 0.3, project_weight: float = 1.0) -> Column:
    return F.least((keyword * keyword_weight + project * project_weight) * decay / (keyword_weight + project_weight), F.lit(1.0))


def project_bonus(project: Column, current: Column, folder_bonus: Column) -> Column:
    return F.when((current != "") & (project == current), 1.0).otherwise(0.0) + folder_bonus


def effective_importance(importance: Column, created: Column, accesses: Column, as_of: Column) -> Column:
    """importance * exp(-age in hours / 168) + min(accesses / 10, 0.5)."""
    return importance * F.exp(-age(created, as_of, 3600) / 168) + F.least(accesses * 0.1, F.lit(0.5))


def ema(values: Column, keep: float = 0.7) -> Column:
    """Exponential moving average of an ordered array, from 0."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a * keep + x * (1 - keep))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """A vector of length 1; zeros stay."""
    n = norm(vector)
    return F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    """Cosine of unit vectors from their squared distance."""
    return 1.0 - distance / 2.0


def segment_size(length: Column, base: int = 512, most: int = 2048) -> Column:
    return F.when(length < 2048, base).when(length < 8192, base * 2).when(length < 32768, base * 3).otherwise(most)


def rough_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
