"""Task graphs: long chains in few rounds, components, shortest cycles and levels against plain walks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loomstone.operators import graph


def frames(spark, n, edges):
    return spark.createDataFrame([(k, f"r{k % 3}", "pending") for k in range(n)], "task long, role string, state string"), spark.createDataFrame(edges, "task long, dep long")


def plain_levels(n, edges):
    below = {k: [b for a, b in edges if a == k and 0 <= b < n] for k in range(n)}
    level: dict = {}

    def of(k):
        if k not in level:
            level[k] = 1 + max((of(b) for b in below[k]), default=-1)
        return level[k]

    return {k: of(k) for k in range(n)}


def reach(n, edges):
    to = {k: {b for a, b in edges if a == k} for k in range(n)}
    out = {}
    for k in range(n):
        seen, todo = set(), list(to[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += to[x]
        out[k] = seen
    return out


@pytest.mark.parametrize("seed", [1])
def test_levels_and_longest_chain_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    n = 24
    edges = [(a, rng.randrange(a)) for a in range(1, n) for _ in range(rng.choice([0, 1, 1, 1, 2]))] + [(5, 999)]
    edges += [(k + 1, k) for k in range(14, 20)]
    tasks, deps = frames(spark, n, edges)
    want = plain_levels(n, edges)
    assert {r.task: r.level for r in graph.levels(tasks, deps).collect()} == want
    path = [r.task for r in graph.critical_path(tasks, deps).orderBy("nth").collect()]
    assert len(path) == max(want.values()) + 1 and all((b, a) in edges for a, b in zip(path, path[1:])) and want[path[-1]] == max(want.values())


def test_a_chain_of_ten_thousand_tasks_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    tasks = spark.range(n).withColumnRenamed("id", "task")
    deps = spark.range(1, n).select(F.col("id").alias("task"), (F.col("id") - 1).alias("dep"))
    rounds, real = [], graph.held
    monkeypatch.setattr(graph, "held", lambda df: rounds.append(1) or real(df))
    out = graph.levels(tasks, deps)
    assert out.filter("task <> level").count() == 0 and out.count() == n
    assert len(rounds) < 30


@pytest.mark.parametrize("edges", [[(k, (k + 1) % 50) for k in range(50)], [(0, 1), (1, 2), (2, 1), (3, 2)]])
def test_levels_refuse_cycles(spark, edges):
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(*frames(spark, 60, edges))


@pytest.mark.parametrize("seed", [3])
def test_components_and_shortest_cycles_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(14)} | {(k, k + 1) for k in range(8)})
    to = reach(n, edges)
    want = {k: min(x for x in range(n) if x in to[k] and k in to[x]) for k in range(n) if k in to[k]}
    _, deps = frames(spark, n, edges)
    assert {r.task: r.component for r in graph.components(deps).collect()} == want
    got = {r.component: r.path for r in graph.shortest_cycles(deps).collect()}
    assert got.keys() == set(want.values())
    for c, path in got.items():
        steps, depth = {c}, 0
        while True:  # by breadth
            depth += 1
            steps = {b for a, b in edges if a in steps}
            if c in steps:
                break
        assert path[0] == c and len(path) == depth and all(e in edges for e in zip(path, [*path[1:], c]))


def test_a_complete_graph_of_thirty_tasks_ends_soon(spark):
    _, deps = frames(spark, 30, [(a, b) for a in range(30) for b in range(30) if a != b])
    began = time.time()
    assert {r.component for r in graph.components(deps).collect()} == {0}
    assert time.time() - began < 120


def test_bottlenecks(spark):
    tasks, deps = frames(spark, 20, [(k, 0) for k in range(1, 6)] + [(k + 1, k) for k in range(10, 16)])
    assert {tuple(r) for r in graph.bottlenecks(tasks, deps).collect()} == {("high_fanout", 0, 5), ("long_chain", None, 7)}
    assert graph.bottlenecks(*frames(spark, 4, [(1, 0)])).count() == 0


def test_empty_graphs(spark):
    tasks, deps = frames(spark, 3, [(1, 0)])
    none = deps.limit(0)
    assert {(r.task, r.level) for r in graph.levels(tasks, none).collect()} == {(0, 0), (1, 0), (2, 0)}
    assert graph.levels(tasks.limit(0), deps).count() == graph.components(none).count() == graph.scheduled(tasks.limit(0), none, {}).count() == 0
    assert graph.shortest_cycles(deps).count() == 0
