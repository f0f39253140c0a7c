"""The inverted index and routed queries against the single-query operators and plain code."""

import random

import pytest
from loomstone.operators import composite, postings, search, vectors

STRATEGIES = postings.STRATEGIES


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(n * 12)]
    out = [(i, " ".join(["the"] * (i % 3 > 0) + words[12 * i : 12 * i + rng.randint(0, 12)])) for i in range(n)]
    return out + [(n, None), (n + 1, "THE \tThe \n tHE x")]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("index")
    rows = texts(700, 1)
    df = spark.createDataFrame(rows, "id long, content string")
    postings.build(df.repartition(4), f"{at}/postings")
    rng = random.Random(2)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    vec = spark.createDataFrame(v, "id long, vector array<double>")
    vectors.build(vec, f"{at}/vectors")
    turns = [(f"s{k % 6}", f"m{k}", f"{'the ' if k % 4 else ''}{rows[k][1]}", k) for k in range(400)]
    mem = spark.createDataFrame(turns, "session_id string, id string, content string, nth long")
    return at, rows, df, vec, mem


def queries(spark, n, rows, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [w for _ in range(3) for w in (rows[rng.randint(0, 600)][1] or "").split()[:3]] + (["the", "The", "nowhere"] if i % 2 else [])
        out.append((i, " ".join(words) + (" and api vs maybe?" if i % 3 == 0 else ""), [rng.gauss(0, 1) for _ in range(8)], f"s{i % 7}", STRATEGIES[i % 5], [None, 0.2, 0.9][i % 3], [None, 1, 5][i % 4 % 3]))
    return spark.createDataFrame(out, "query_id long, query string, query_vector array<double>, session_id string, strategy string, history double, recent int"), out


def plain_overlap(rows, query, k):
    own = set(query.lower().split())
    hits = [(-len(own & set((t or "").lower().split())), i) for i, t in rows]
    return [(i, -n) for n, i in sorted(hits) if n][:k]


@pytest.mark.parametrize("k", [1, 4, 50])
def test_overlap_of_a_thousand_queries_equals_comparing_all(spark, world, k):
    at, rows, *_ = world
    df, asked = queries(spark, 1000, rows)
    got = {}
    for r in postings.overlap_batch(spark, f"{at}/postings", df.select("query_id", "query"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.overlap))
    plain[-1] = (701, "the  the the x".replace("  ", " "))
    for i, q, *_ in asked:
        own = {w for w in q.lower().split()}
        hits = [(-len(own & {w for w in (t or "").lower().replace(" ", "~").split()}), j) for j, t in rows]
        assert got.get(i, []) == [(j, -n) for n, j in sorted(hits) if n][:k], q


def test_frequent_words_are_compared_not_looked_up(spark, world):
    at, rows, *_ = world
    df = spark.createDataFrame([(0, "the w7 w11 w13 w17")], "query_id long, query string")
    asked = postings.query_words(df, spark.read.parquet(f"{at}/postings/words")).orderBy("nth").collect()
    assert asked[-1].word == "the" and asked[-1].met >= 3 and [r.texts for r in asked] == sorted(r.texts for r in asked)
    plan = postings.overlap_batch(spark, f"{at}/postings", df, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan


def test_a_thousand_routed_queries_equal_single_ones(spark, world):
    at, rows, df, vec, mem = world
    asked_df, asked = queries(spark, 1000, rows)
    out = postings.retrieved(asked_df, f"{at}/vectors", f"{at}/postings", mem, 6, 5, 20)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.route, r.id, None if r.score is None else round(r.score, 9), r.layer))
    routes = {r.query_id: (r.route, list(r.reasons)) for r in postings.routed(asked_df).collect()}
    assert {r for r, _ in routes.values()} >= {"hybrid", "vectors", "keywords", "tiers"}
    assert all((route == "none") == (not reasons) for i, (route, reasons) in routes.items() if asked[i][4] == "adaptive")
    rng = random.Random(9)
    for i, q, v, session, strategy, *_ in [asked[j] for j in rng.sample(range(1000), 14)] + asked[:5]:
        route = routes[i][0]
        if route == "hybrid":
            one = [(route, str(r.id), round(r.score, 9), None) for r in composite.hybrid(vec, v, df, q, 6).collect()]
        elif route == "vectors":
            one = [(route, str(r.id), round(r.score, 9), None) for r in search.knn(vec, v, 6).collect()]
        elif route == "keywords":
            one = [(route, str(r.id), float(r.overlap), None) for r in search.overlap_search(df, q, 6).collect()]
        else:
            one = [(route, r.id, None, r.layer) for r in composite.tiered(mem, session, q, 6, 5, 20).collect()] if route == "tiers" else []
        assert got.get(i, []) == one, (i, route, q)


def test_contexts_stop_at_the_budget(spark):
    found = spark.createDataFrame([(1, "a", "working", 1), (1, "b", None, 2), (1, "c", "short_term", 3), (2, "c", None, 1)], "query_id long, id string, layer string, rank int")
    content = spark.createDataFrame([("a", "x" * 10), ("b", "y" * 20), ("c", "z" * 500)], "id string, content string")
    got = {r.query_id: r.text for r in postings.contexts(found, content, 30).collect()}
    assert got == {1: "[Current Context]\n" + "x" * 10 + "\n\n[Background Knowledge]\n" + "y" * 20 + "\n\n"}


def test_indexes_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, content string")
    postings.build(empty, f"{tmp_path}/p")
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    assert postings.overlap_batch(spark, f"{tmp_path}/p", q, 3).count() == 0
    postings.build(spark.createDataFrame([(1, "a"), (2, None)], "id long, content string"), f"{tmp_path}/one")
    assert [(r.id, r.overlap) for r in postings.overlap_batch(spark, f"{tmp_path}/one", q, 3).collect()] == [(1, 1)]
    assert postings.overlap_batch(spark, f"{tmp_path}/one", q.limit(0), 3).count() == 0
