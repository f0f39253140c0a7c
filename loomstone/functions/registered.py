"""Functions for SQL text: table functions over rows and partitions, and a grouped aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import chunks


class Chunks:
    """chunks(text, kind[, size]): (chunk_index, piece, piece_kind, head) of a text, for LATERAL; null texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, arg in (("text", text), ("kind", kind)):
            if not isinstance(arg.dataType, (T.StringType, T.NullType)):
                raise ValueError(f"chunks: {name} is {arg.dataType.simpleString()}, not string")
        if size is not None and (not size.isConstantExpression or not isinstance(size.value, int) or size.value < 1):
            raise ValueError("chunks: size is a positive number")
        return AnalyzeResult(T.StructType([T.StructField("chunk_index", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("piece", "piece_kind", "head"))]))

    def eval(self, text: str | None, kind: str | None, size: int = chunks.SIZE) -> Iterator[tuple]:
        for k, piece in enumerate(chunks.pieces(text, kind, size)):
            yield k, *piece


class WithinBudget:
    """within_budget(TABLE(t) PARTITION BY (group) ORDER BY (order), column, budget): a group's rows as far as the sum of the column reaches, with that sum (upto).

    A partition is read row by row and nothing of it is kept but the sum.
    """

    def __init__(self, *_):
        self.upto, self.over = 0, False

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, budget: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("within_budget: the first argument is a table")
        if column.value not in table.dataType.names:
            raise ValueError(f"within_budget: no column {column.value}")
        if budget.value is None:
            raise ValueError("within_budget: the budget is a constant")
        return AnalyzeResult(T.StructType([*table.dataType.fields, T.StructField("upto", T.LongType())]))

    def eval(self, row: T.Row, column: str, budget: int) -> Iterator[tuple]:
        self.upto += row[column] or 0
        self.over |= self.upto > budget
        if not self.over:
            yield *row, self.upto


def latency_at(values: pd.Series, share: pd.Series) -> float:
    """The value at index int(n * share), the last at most, of a group's sorted values."""
    own = values.dropna().sort_values().to_numpy()
    return float(own[min(len(own) - 1, int(len(own) * share.iloc[0]))]) if len(own) else float("nan")


def register(spark: SparkSession) -> None:
    """Makes chunks, within_budget and latency_at known to SQL."""
    spark.udtf.register("chunks", F.udtf(Chunks))
    spark.udtf.register("within_budget", F.udtf(WithinBudget))
    spark.udf.register("latency_at", F.pandas_udf(latency_at, "double"))
