"""Nearest neighbours, filters around them, and merged rankings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import scoring as S
from ..functions import text as X
from .shared import lean
from .vectors import best, matrix
from .windows import numbered


def knn(rows: DataFrame, query: list[float], k: int = 5, id: str = "id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k rows nearest to a vector by squared distance (ties by id), filters first: a scan with a top-k per partition."""
    rows = rows if where is None else rows.filter(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("distance", S.squared_distance(F.col(vector), q)).withColumn("score", S.similarity(F.col("distance"))).orderBy("distance", id).limit(k)


def _block(rows: DataFrame, ids: list, vectors: np.ndarray, k: int, kind: T.DataType) -> DataFrame:
    """k nearest rows for each of a block of queries, of every partition: (query_id, id, distance)."""
    squares = (vectors**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("q", pa.int32()), ("id", to_arrow_type(own_kind)), ("distance", pa.float64())])
        found, step = schema.empty_table(), max(1, (1 << 20) // max(1, len(ids)))
        for b in (batch.slice(lo, step) for batch in batches for lo in range(0, batch.num_rows, step)):
            v = matrix(b.column("v"))
            rough = squares[:, None] + (v**2).sum(axis=1)[None, :] - 2 * vectors @ v.T
            if len(v) > k:  # rounding may shuffle what is as near as the last one: all of that is kept
                edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
                q, r = np.nonzero(rough <= (edge + 1e-9 * np.maximum(1.0, np.abs(edge) + squares))[:, None])
            else:
                q, r = (x.ravel() for x in np.indices(rough.shape))
            exact = np.concatenate([((v[r[lo : lo + 65_536]] - vectors[q[lo : lo + 65_536]]) ** 2).sum(axis=1) for lo in range(0, len(q), 65_536)])
            found = best(pa.concat_tables([found, pa.table([pa.array(q.astype(np.int32)), b.column("id").take(pa.array(r)), pa.array(exact)], schema=schema)]), k)
        who = pa.array(ids, to_arrow_type(kind)).take(found.column("q").combine_chunks())
        yield from pa.table([who, found.column("id"), found.column("distance")], ["query_id", "id", "distance"]).combine_chunks().to_batches()

    own_kind = rows.schema["id"].dataType
    return rows.mapInArrow(lean(run), T.StructType([T.StructField("query_id", kind), T.StructField("id", own_kind), T.StructField("distance", T.DoubleType())]))


def knn_batch(rows: DataFrame, queries: DataFrame, k: int = 5, id: str = "id", vector: str = "vector", block: int = 1024) -> DataFrame:
    """k nearest rows for every query (query_id, query_vector), ties by id: a stated query set against all rows, in blocks.

    A pass over the rows takes at most `block` queries, the only ones that the driver
    and a worker hold; each partition keeps k rows a query, so k rows a partition and
    query are shuffled.  Null vectors are near nothing.
    """
    own = rows.filter(F.col(vector).isNotNull()).select(F.col(id).alias("id"), F.col(vector).alias("v"))
    asked = numbered(queries.filter(F.col("query_vector").isNotNull()), "__n", F.col("query_id"))
    kind = queries.schema["query_id"].dataType
    parts = []
    for lo in range(0, asked.count(), block):
        got = asked.filter((F.col("__n") > lo) & (F.col("__n") <= lo + block)).select("query_id", "query_vector").collect()
        parts.append(_block(own, [r.query_id for r in got], np.array([r.query_vector for r in got], float), k, kind))
    if not parts:
        return rows.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("id", own.schema["id"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def filtered_knn(rows: DataFrame, query: list[float], where: Column, k: int = 5, faithful: bool = False, id: str = "id", vector: str = "vector") -> DataFrame:
    """exact: filter, then k; faithful: the nearest 2k, then filter, then k."""
    if not faithful:
        return knn(rows, query, k, id, vector, where)
    return knn(rows, query, 2 * k, id, vector).filter(where).orderBy("distance", id).limit(k)


def symbol(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
    """The first row whose name is `name` or ends in ".name"."""
    return rows.filter((F.col("name") == name) | F.endswith(F.col("name"), F.lit("." + name))).orderBy(*order).limit(1)


def overlap(text: Column, query: str) -> Column:
    """Number of distinct words, between white space, that text and query share."""
    words = sorted(set(query.lower().split()))
    return F.size(F.array_intersect(X.plain_words(text), X.strings(words)))


def overlap_search(rows: DataFrame, query: str, k: int = 10, id: str = "id", text: str = "content", keep_zero: bool = False) -> DataFrame:
    """Most shared words first (ties by id)."""
    rows = rows.withColumn("overlap", overlap(F.col(text), query))
    return (rows if keep_zero else rows.filter("overlap > 0")).orderBy(F.desc("overlap"), id).limit(k)


def merged(parts: list[tuple[DataFrame, float]], k: int, id: str = "id", score: str = "score", default: float = 0.5) -> DataFrame:
    """Weighted rankings merged: an id has its greatest weighted score, the earlier part in a tie."""
    rows = reduce(DataFrame.unionByName, (p.select(F.col(id).alias("id"), (F.coalesce(F.col(score), F.lit(default)) * w).alias("score"), F.lit(i).alias("part")) for i, (p, w) in enumerate(parts)))
    first = Window.partitionBy("id").orderBy(F.desc("score"), "part")
    return rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth").orderBy(F.desc("score"), "id").limit(k)


def first_of_each(parts: list[DataFrame], id: str = "id") -> DataFrame:
    """Union in which the earliest part's row of an id stays; source_rank says which."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(id).orderBy("source_rank"))).filter("nth = 1").drop("nth")


# operator name -> predicate on a column and a value
TESTS = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "contains": lambda c, v: F.contains(c.cast("string"), F.lit(str(v))),
    "greater_than": lambda c, v: c > v,
    "less_than": lambda c, v: c < v,
}


def any_condition(conditions: list[dict]) -> Column:
    """Disjunction of {field, operator, value}; unknown operators never hold."""
    tests = [TESTS[c["operator"]](F.col(c["field"]), c["value"]) for c in conditions if c["operator"] in TESTS]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
