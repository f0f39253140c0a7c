"""An inverted-file index for vectors: rows stored by the cell of their nearest centroid.

Below its folder an index has `centroids` (fixed when it is built), `rows` (all columns of
the indexed rows with `ivf_cell` and `ivf_far`, the distance to the cell's centroid, a
folder for each cell of each batch) and `cells`, snapshots that name the batches and
each cell's size and radius.  A batch counts once a snapshot names it, so a reader sees
all of it or nothing, and an add that fails leaves no trace in results.

Exact search never reads a cell that can't hold one of the k nearest: by the triangle
inequality a row of a cell is no nearer to a query than the query's distance to
the centroid less the radius.  What the nearest cells hold bounds the rest.  Cells are
partitions of the table, so Spark's scan skips the others.  Approximate search
reads a fixed number of the nearest cells of a query.

Bounded by parameters and held by the driver and each worker: centroids (MOST_CELLS at
most) and a block of queries.  Centroids are fitted on at most `sample` rows, and
all rows are indexed.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import tables
from .shared import held, lean
from .windows import numbered

MOST_CELLS = 16_384
SAMPLE = 65_536
BLOCK = 1024
BUFFER = 1 << 18


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of doubles, by its flat values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fitted(rows: DataFrame, cells: int, id: str, vector: str, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Centroids of k-means over the `sample` rows of least hash; fewer than `cells` where rows repeat."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = held(rows.orderBy(F.xxhash64(F.lit(seed), F.col(id).cast("string")), id).limit(sample).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v")))
    if cells > 1:
        return np.array(KMeans(k=cells, seed=seed, initMode="random", maxIter=10, featuresCol="v").fit(some).clusterCenters(), float)
    from pyspark.ml.stat import Summarizer

    return np.array([some.agg(Summarizer.mean(F.col("v"))).first()[0].toArray()], float)


def _assigned(rows: DataFrame, centroids: np.ndarray, vector: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        squares = (c**2).sum(axis=1)
        for b in batches:
            v, cell = matrix(b.column(vector)), np.zeros(b.num_rows, np.int32)
            step = max(1, (1 << 19) // len(c))
            for lo in range(0, len(v), step):
                cell[lo : lo + step] = (squares[None, :] - 2 * v[lo : lo + step] @ c.T).argmin(axis=1)
            far = np.sqrt(((v - c[cell]) ** 2).sum(axis=1)) if len(v) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "ivf_cell", "ivf_far"])

    return rows.mapInArrow(lean(run), T.StructType([*rows.schema.fields, T.StructField("ivf_cell", T.IntegerType()), T.StructField("ivf_far", T.DoubleType())]))


CELLS = "batch string, cell int, n long, radius double"


def build(rows: DataFrame, path: str, id: str = "id", vector: str = "vector", cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> str:
    """Fits centroids (by default about the square root of the number of rows, at most MOST_CELLS) and indexes all rows; rows with a null vector are left out."""
    own = rows.filter(F.col(vector).isNotNull())
    n = own.count()
    k = min(MOST_CELLS, cells or max(1, math.isqrt(n)), max(n, 1))
    centroids = fitted(own, k, id, vector, sample, seed) if n else np.zeros((0, 0))
    spark = rows.sparkSession
    spark.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(centroids)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    tables.write_snapshot(spark.createDataFrame([], CELLS), f"{path}/cells")
    return add(rows, path, vector) if n else path


def add(rows: DataFrame, path: str, vector: str = "vector") -> str:
    """Indexes further rows by the centroids that there are, as a batch of its own.  A cell that very many rows fall into is dealt out over tasks and files."""
    spark = rows.sparkSession
    centroids = _centroids(spark, path)
    if not len(centroids):
        raise ValueError("the index was built from no rows and has no centroids")
    name = uuid.uuid4().hex
    _assigned(rows.filter(F.col(vector).isNotNull()), centroids, vector).hint("rebalance", "ivf_cell").sortWithinPartitions("ivf_cell", "ivf_far").write.partitionBy("ivf_cell").parquet(f"{path}/rows/ivf_batch={name}")
    new = spark.read.parquet(f"{path}/rows/ivf_batch={name}").groupBy(F.lit(name).alias("batch"), F.col("ivf_cell").alias("cell")).agg(F.count("*").alias("n"), F.max("ivf_far").alias("radius"))
    tables.write_snapshot(tables.read_snapshot(spark, f"{path}/cells").unionByName(new), f"{path}/cells")
    return path


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    got = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    return np.array([r.centroid for r in got], float)


class Index:
    """What the driver holds of an index: centroids, and size and radius of each cell."""

    def __init__(self, spark: SparkSession, path: str):
        self.centroids = _centroids(spark, path)
        cells = tables.read_snapshot(spark, f"{path}/cells")
        self.n, self.radius = np.zeros(len(self.centroids), np.int64), np.zeros(len(self.centroids))
        for r in cells.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():
            self.n[r.cell], self.radius[r.cell] = r.n, r.radius
        self.batches = [r.batch for r in cells.select("batch").distinct().collect()]
        self.rows = spark.read.parquet(f"{path}/rows").filter(F.col("ivf_batch").isin(self.batches)) if self.batches else None

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Of each query to each centroid."""
        c = self.centroids
        return np.sqrt(np.maximum((queries**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * queries @ c.T, 0))

    def nearest(self, far: np.ndarray, least: int, cells: int | None = None) -> np.ndarray:
        """Whether to probe a cell for a query: its nearest filled ones, until `least` rows are met, or so many cells."""
        order = np.argsort(np.where(self.n > 0, far, np.inf), axis=1, kind="stable")
        size = self.n[order]
        before = np.cumsum(size, axis=1) - size
        chosen = (before < least if cells is None else np.arange(far.shape[1])[None, :] < cells) & (size > 0)
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, chosen, axis=1)
        return out

    def possible(self, far: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a cell can hold a row as near as a query's bound."""
        slack = 1e-9 * (1 + far)
        return (far - self.radius[None, :] <= bound[:, None] + slack) & (self.n > 0)[None, :]


def best(found: pa.Table, k: int) -> pa.Table:
    """The k rows of each query with the least distance, then id."""
    found = found.take(pc.sort_indices(found, [("q", "ascending"), ("distance", "ascending"), ("id", "ascending")]))
    q = found.column("q").to_numpy()
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
    return found.filter(pa.array(nth < k))


def _scan(rows: DataFrame, queries: np.ndarray, asks: np.ndarray, far: np.ndarray, bound: np.ndarray, k: int, id: str, vector: str) -> DataFrame:
    """(q, id, distance): of the cells that each query asks for, its k nearest rows of each partition; distance is squared.

    Rows of a cell whose distance to the centroid differs from the query's by more than
    the bound are passed over.
    """
    kind = rows.schema[id].dataType
    cells = np.flatnonzero(asks.any(axis=0))
    shared = rows.sparkSession.sparkContext.broadcast((queries, {int(c): np.flatnonzero(asks[:, c]) for c in cells}, {int(c): far[asks[:, c], c] for c in cells}, bound))
    names = ["q", "id", "distance"]

    def of_cell(v: np.ndarray, own_far: np.ndarray, who: np.ndarray, away: np.ndarray, all_q: np.ndarray, bounds: np.ndarray) -> tuple:
        q = all_q[who]
        rough = (q**2).sum(axis=1)[:, None] + (v**2).sum(axis=1)[None, :] - 2 * q @ v.T
        slack = 1e-9 * (1 + away)
        rough[np.abs(away[:, None] - own_far[None, :]) > (bounds[who] + slack)[:, None]] = np.inf
        if v.shape[0] > k:
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
            keep = rough <= (edge + 1e-9 * (1 + np.abs(edge)))[:, None]
        else:
            keep = np.ones(rough.shape, bool)
        a, r = np.nonzero(keep & np.isfinite(rough))
        return who[a], r, np.concatenate([np.zeros(0), *(((v[r[lo : lo + 65_536]] - q[a[lo : lo + 65_536]]) ** 2).sum(axis=1) for lo in range(0, len(a), 65_536))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_q, who, away, bounds = shared.value
        schema = pa.schema([("q", pa.int32()), ("id", to_arrow_type(kind)), ("distance", pa.float64())])
        parts, size = [schema.empty_table()], 0
        for b in batches:
            if not b.num_rows:
                continue
            v, own_far, cell = matrix(b.column("v")), b.column("ivf_far").to_numpy(), b.column("ivf_cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(cell[order]) != 0))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
                c = int(cell[order[lo]])
                if c not in who:
                    continue
                step = max(1, (1 << 19) // len(who[c]))
                for at in range(lo, hi, step):
                    own = order[at : min(hi, at + step)]
                    q, r, d = of_cell(v[own], own_far[own], who[c], away[c], all_q, bounds)
                    parts.append(pa.table([pa.array(q.astype(np.int32)), b.column("id").take(pa.array(own[r])), pa.array(d)], schema=schema))
                    size += len(r)
                    if size > BUFFER:
                        parts, size = [best(pa.concat_tables(parts), k)], 0
        yield from best(pa.concat_tables(parts), k).combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], schema)]

    own = rows.filter(F.col("ivf_cell").isin([int(c) for c in cells])).select(F.col(id).alias("id"), F.col(vector).alias("v"), "ivf_cell", "ivf_far")
    return own.mapInArrow(lean(run), T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])).select(*names)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, where: Column | None = None, probes: int | None = None, id: str = "id", vector: str = "vector", block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest indexed rows of every query (query_id, query_vector), ties by id.

    where: a condition on columns of the indexed rows, met before the k.  probes: None
    searches exactly; a number reads only that many nearest cells of each query and may
    miss some.  Null query vectors find nothing; an index without rows gives none.
    """
    index = Index(spark, path)
    kind = queries.schema["query_id"].dataType
    asked = numbered(queries.filter(F.col("query_vector").isNotNull()).select("query_id", "query_vector"), "__n", F.col("query_id"))
    parts = []
    for lo in range(0, asked.count() if index.rows is not None else 0, block):
        got = asked.filter((F.col("__n") > lo) & (F.col("__n") <= lo + block)).select("query_id", "query_vector").collect()
        q = np.array([r.query_vector for r in got], float)
        rows = index.rows if where is None else index.rows.filter(where)
        far, free = index.distances(q), np.full(len(q), np.inf)
        first = index.nearest(far, k, probes)
        found = _ranked(_scan(rows, q, first, far, free, k, id, vector), k)
        if probes is None:
            found = held(found)
            bound = free
            for r in found.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("d")).filter(F.col("n") >= k).collect():
                bound[r.q] = math.sqrt(r.d)
            rest = index.possible(far, bound) & ~first
            if rest.any():
                found = _ranked(found.select("q", "id", "distance").union(_scan(rows, q, rest, far, bound, k, id, vector)), k)
        names = spark.createDataFrame([(n, r.query_id) for n, r in enumerate(got)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", kind)]))
        parts.append(found.join(F.broadcast(names), "q").select("query_id", "id", "distance", "rank"))
    if not parts:
        none = index.rows.schema[id].dataType if index.rows is not None else T.LongType()
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("id", none), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    return reduce(DataFrame.union, parts)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (query_id, id) that were found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return float(hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0)


def tuned(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, target: float = 0.9, **options) -> tuple[int, float]:
    """The fewest cells to probe, among doublings and halvings, that reach the target recall on these queries, and that recall: measured against exact search, by bisection."""
    truth = held(search(spark, path, queries, k, **options))
    low, high, best = 0, max(1, len(Index(spark, path).centroids)), 1.0
    while high - low > max(1, low // 8):
        mid = (low + high) // 2
        got = recall(search(spark, path, queries, k, probes=mid, **options), truth)
        low, high, best = (low, mid, got) if got >= target else (mid, high, best)
    return high, best
