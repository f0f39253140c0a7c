"""The vector index against brute force: exact with pruned cells, filters, ties, adds, recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import tables, vectors

ROWS = "id long, vector array<double>, label int"


def clustered(n=1200, centres=24, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 10
    v = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim))
    v[100:130] = v[100:101]  # ties
    return v


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in r], (first + i) % 5) for i, r in enumerate(v)], ROWS)


def nearest(v, ids, q, k, keep=lambda i: True):
    d = ((v - q) ** 2).sum(axis=1)
    return sorted((round(d[i], 6), int(ids[i])) for i in range(len(v)) if keep(ids[i]))[:k]


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.distance, 6), r.id))
    return out


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    v = clustered()
    path = str(tmp_path_factory.mktemp("ivf") / "index")
    rows = frame(spark, v).union(spark.createDataFrame([(5000, None, 1)], ROWS)).repartition(5)
    return v, vectors.build(rows, path, cells=30)


def asked(spark, v):
    return spark.createDataFrame([(f"q{i}", [float(x) for x in r]) for i, r in enumerate(v)] + [("null", None)], "query_id string, query_vector array<double>")


def test_exact_search_equals_brute_force_in_blocks(spark, built):
    v, path = built
    q = np.concatenate([v[::60], v[100:101], clustered(5, seed=9)])
    want = {f"q{i}": nearest(v, np.arange(len(v)), x, 7) for i, x in enumerate(q)}
    assert got(vectors.search(spark, path, asked(spark, q), 7)) == want
    assert got(vectors.search(spark, path, asked(spark, q), 7, block=6)) == want


def test_filters_hold_before_the_nearest(spark, built):
    v, path = built
    want = {f"q{i}": nearest(v, np.arange(len(v)), x, 4, lambda i: i % 5 == 2) for i, x in enumerate(v[::200])}
    assert got(vectors.search(spark, path, asked(spark, v[::200]), 4, where=tables.condition_on("label", 2))) == want


def test_cells_are_pruned_by_the_triangle_bound(spark, built):
    v, path = built
    index = vectors.Index(spark, path)
    q = v[::50]
    far = index.distances(q)
    bound = np.array([np.sqrt(nearest(v, np.arange(len(v)), x, 5)[-1][0]) for x in q])
    assert index.possible(far, bound).mean() < 0.3 and index.n.sum() == len(v)
    asks = np.zeros(far.shape, bool)
    asks[:, :3] = True
    plan = vectors._scan(index.rows, q, asks, far, np.full(len(q), np.inf), 5, "id", "vector")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "ivf_cell" in plan.split("PartitionFilters")[1].split("]")[0]


def test_fewer_probes_lose_little_and_recall_is_measured(spark, built):
    v, path = built
    queries = asked(spark, v[::40])
    probes, share = vectors.tuned(spark, path, queries, 5)
    assert share >= 0.9 and probes < 15
    assert vectors.recall(vectors.search(spark, path, queries, 5, probes=probes), vectors.search(spark, path, queries, 5)) == pytest.approx(share)


def test_added_rows_are_found_and_an_unnamed_batch_is_not(spark, tmp_path):
    v, more = clustered(300), clustered(200, seed=8) * 1.5
    path = vectors.build(frame(spark, v), str(tmp_path / "i"), cells=9)
    before = got(vectors.search(spark, path, asked(spark, more[:4]), 3))
    lost = vectors._assigned(frame(spark, more, 9000), vectors._centroids(spark, path), "vector")
    lost.write.partitionBy("ivf_cell").parquet(f"{path}/rows/ivf_batch=lost")  # an add that ended before its snapshot
    assert got(vectors.search(spark, path, asked(spark, more[:4]), 3)) == before
    vectors.add(frame(spark, more, 1000), path)
    both, ids = np.concatenate([v, more]), np.concatenate([np.arange(300), 1000 + np.arange(200)])
    q = np.concatenate([more[:4], v[:4]])
    assert got(vectors.search(spark, path, asked(spark, q), 3)) == {f"q{i}": nearest(both, ids, x, 3) for i, x in enumerate(q)}


def test_one_cell_one_vector_and_no_rows(spark, tmp_path):
    same = np.ones((50, 3))
    path = vectors.build(frame(spark, same), str(tmp_path / "same"))
    assert got(vectors.search(spark, path, asked(spark, same[:1]), 4)) == {"q0": [(0.0, i) for i in range(4)]}
    empty = vectors.build(frame(spark, same).limit(0), str(tmp_path / "none"))
    assert vectors.search(spark, empty, asked(spark, same[:1]), 4).count() == 0
    assert vectors.search(spark, path, asked(spark, same[:1]).limit(0), 4).count() == 0
    few = vectors.search(spark, path, asked(spark, same[:1]), 99, where=F.col("id") < 3)
    assert got(few) == {"q0": [(0.0, i) for i in range(3)]}
