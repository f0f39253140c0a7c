"""What the findings of round 3 have shown."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.llm import copies
from loomstone.operators import evaluate, graph, postings, search, sessions, upkeep
from loomstone.operators.shared import parts, sliced
from loomstone.sources import code
from loomstone.streaming import changes, expiry

from .test_expiry import END, at, plain, run
from .test_postings import plain_overlap, texts


def test_needs_retrieval_at_its_thresholds(spark):
    df = spark.createDataFrame([(0.3, 0.0), (0.29, 0.0), (0.9, 1.5), (0.9, 1.51)], "c double, e double")
    got = [r.n for r in df.select(upkeep.needs_retrieval(F.lit(None).cast("double"), F.col("c"), F.col("e")).alias("n")).collect()]
    assert got == [False, True, False, True]


def graph_of(spark, n, edges, roles=3):
    return spark.createDataFrame([(k, f"r{k % roles}" if k % 7 else None, "failed" if k % 50 == 49 else "pending") for k in range(n)], "task long, role string, state string"), spark.createDataFrame(edges, "task long, dep long")


def test_closure_of_many_steps(spark):
    n = 24  # more steps than tables were kept apart
    _, deps = graph_of(spark, n, [(k, k - 1) for k in range(1, n)] + [(k, k // 2) for k in range(4, n)])
    assert {tuple(r) for r in graph.closure(deps).collect()} == {(a, b) for a in range(n) for b in range(a)}
    assert graph.closure(deps.limit(0)).count() == 0


def test_cancelled_tasks_on_many_paths_count_once(spark):
    n = 40  # 2 ** 19 paths from the first failed task on
    tasks, deps = graph_of(spark, n, [(k, k - 1) for k in range(2, n)] + [(k, k - 2) for k in range(3, n)] + [(1, 38)])
    tasks = tasks.withColumn("state", F.when(F.col("task") == 1, "failed").otherwise("pending"))
    assert {r.task for r in upkeep.cancelled(tasks, deps).collect()} == set(range(2, n))


def plain_phases(n, edges, capacity, default):
    role, edges = {k: f"r{k % 3}" if k % 7 else None for k in range(n)}, set(edges)
    below = {k: {b for a, b in edges if a == k} for k in range(n)}
    done, out = set(), []
    while now := [x for r in {*role.values()} for x in sorted((len(below[k]), k) for k in range(n) if role[k] == r and k not in done and below[k] <= done)[: capacity.get(r, default)]]:
        out += [(len({p for p, _ in out}), k) for _, k in now] if not out else [(out[-1][0] + 1, k) for _, k in now]
        done |= {k for _, k in now}
    return sorted(out)


@pytest.mark.parametrize("stretch, ahead", [(200_000, 32), (60, 32), (200_000, 3)])
def test_phases_in_stretches_equal_phases_one_by_one(spark, monkeypatch, stretch, ahead):
    rng = random.Random(stretch + ahead)
    n = 90
    edges = [(a, rng.randrange(a)) for a in range(1, n) for _ in range(rng.choice([0, 1, 1, 2]))] + [(50, 999), (60, 61), (61, 60)]
    tops = []
    monkeypatch.setattr(graph, "STRETCH", stretch)
    monkeypatch.setattr(graph, "AHEAD", ahead)
    real = graph._phases
    monkeypatch.setattr(graph, "_phases", lambda *a: tops.append(a) or real(*a))
    tasks, deps = graph_of(spark, n, edges)
    for capacity, default in (({"r0": 2, "r1": 3}, 1), ({"r2": 0}, 2)):
        want = plain_phases(n, edges, capacity, default)
        assert sorted(map(tuple, graph.scheduled(tasks, deps, capacity, default).collect())) == want
    assert tops and (ahead < 32 or stretch < 100 or len(tops) < 6)


def test_consolidation_runs_once_a_batch_for_all_its_hundreds(spark, tmp_path):
    for k in range(3):
        spark.range(1050 * k, 1050 * (k + 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    ran = []
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    changes.consolidating(stream, f"{tmp_path}/state", f"{tmp_path}/checkpoint", lambda *numbers: ran.append(numbers)).awaitTermination()
    assert ran == [(1, 10), (11, 21), (22, 31)]


def test_many_interventions_share_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(expiry, "BUCKETS", 3)
    events = [(f"i{k}", f"s{k % 5}", "created", at(k), None, None, 60.0 if k % 2 else None) for k in range(200)]
    events += [(f"i{k}", f"s{k % 5}", "resolved", at(k + 5 * k), "rejected", "ann", None) for k in range(0, 200, 3)]
    assert run(spark, tmp_path, [events[::2], events[1::2], [END]]) == plain([*events, END], at(90_000))


def test_similar_sets_equal_comparing_all_and_few_pairs_are_compared(spark):
    rng = random.Random(5)
    sets = {}
    for k in range(300):
        old = list(sets[rng.randrange(k)]) if k and rng.random() < 0.4 else []
        sets[k] = set(rng.sample(old, len(old) // 2 + len(old) // 4)) | {f"w{int(rng.paretovariate(0.5)) % 4000}" for _ in range(rng.choice([3, 10, 20]))}
    k = spark.createDataFrame([(i, w) for i, ws in sets.items() for w in ws], "id int, word string")
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for least in (0.3, 0.5):
        want = {(a, b): round(jaccard(a, b), 9) for a in sets for b in sets if a < b and jaccard(a, b) > least}
        got = sessions.similar(k, k, least)
        assert want and {(r.a, r.b): round(r.jaccard, 9) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan


def test_pairs_of_sets_are_not_shuffled_and_copies_are_compared_once(spark, monkeypatch):
    rng = random.Random(6)
    sets = {k: {f"w{int(rng.paretovariate(0.5)) % 60}" for _ in range(rng.choice([2, 5]))} if k % 3 else {"same", "words"} | ({"too"} if k % 2 else set()) for k in range(150)}
    known = spark.createDataFrame([(i, w) for i, ws in sets.items() for w in ws], "id int, word string")
    new = known.filter("id % 5 = 0 or id > 140").union(spark.createDataFrame([(500, "same"), (500, "words"), (501, "nowhere")], known.schema))
    plan = sessions.similar(known, known)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Exchange" not in plan.split("Join")[0]
    met, real = [], sessions._meeting
    monkeypatch.setattr(sessions, "_meeting", lambda *a: met.append(real(*a)) or met[-1])
    asked = {k: sets[k] for k in sets if k % 5 == 0 or k > 140} | {500: {"same", "words"}, 501: {"nowhere"}}
    want = {}
    for a, ws in asked.items():
        near = sorted((-len(ws & o) / len(ws | o), b) for b, o in sets.items() if b != a and len(ws & o) / len(ws | o) > 0.3)
        want |= {(a, n): (b, round(-j, 9), near[0][0] <= -0.8) for n, (j, b) in enumerate(near[:5], 1)}
    assert {(r.a, r["rank"]): (r.b, round(r.jaccard, 9), r.is_duplicate) for r in sessions.duplicates(new, known).collect()} == want
    distinct = len({frozenset(x) for x in sets.values()})
    assert distinct < 100 and met[0].count() < distinct**2 / 2


def test_keyword_counts_are_dealt_out_by_size(spark, monkeypatch):
    monkeypatch.setattr(sessions, "parts", lambda df, mb: 23)
    docs = spark.createDataFrame([(k, f"redis words number word{k % 9}") for k in range(100)], "id long, text string")
    out = sessions.keyword_counts(docs, "id", "text")
    assert out.rdd.getNumPartitions() == 23 and out.count() == 400
    assert parts(docs) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts(spark.range(10)) == spark.sparkContext.defaultParallelism < parts(spark.range(10**7))


def test_slices_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 500, "", "c" * 90, "d" * 20] + ["e"] * 40})
    got = list(sliced(batch, "text", 100, 16))
    assert [x for b in got for x in b.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(b.num_rows <= 16 and (b.num_rows == 1 or sum(len(x or "") for x in b.column("text").to_pylist()) <= 100) for b in got)
    assert [b.num_rows for b in sliced(batch.slice(0, 0), "text")] == [0]


def test_nearest_of_equal_rows_and_small_steps(spark):
    rows = spark.createDataFrame([(k, [float(k % 4), 1.0]) for k in range(40)], "id long, vector array<double>")
    asked = spark.createDataFrame([(q, [float(q), 1.0]) for q in range(4)], "query_id long, query_vector array<double>")
    for block in (1, 3, 1024):
        got = {(r.query_id, r["rank"]): (r.id, r.distance) for r in search.knn_batch(rows.coalesce(1), asked, 3, block=block).collect()}
        assert got == {(q, n + 1): (q + 4 * n, 0.0) for q in range(4) for n in range(3)}
    assert "lean" in search._block.__code__.co_names  # freed memory goes back


def test_near_copies_are_found_by_simhash_too(spark, monkeypatch):
    words = [f"word{k}" for k in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:399], "other"])), (3, " ".join(words[::-1])), (4, ""), (5, " \n")], "doc_id long, text string")
    assert {r.doc_id for r in copies.one_each(docs).collect()} == {1, 3, 4}
    monkeypatch.setattr(copies, "banded", lambda batches: iter(()))
    assert {r.doc_id for r in copies.one_each(docs).collect()} == {1, 3, 4}


def test_files_of_one_small_table_are_parsed_by_all_cores(spark, tmp_path):
    spark.range(100).select(F.concat("id", F.lit(".py")).alias("path"), F.lit("def f():\n    return g()\n").alias("content"), F.lit("python").alias("kind")).coalesce(1).write.parquet(f"{tmp_path}/files")
    out = code.calls(spark.read.parquet(f"{tmp_path}/files"))
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and out.count() == 100


def test_metrics_at_k_are_counted_in_parts_by_size(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "parts", lambda df, mb: 23, raising=False)
    rng = random.Random(7)
    runs = [(q, r, rng.randrange(9)) for q in range(40) for r in range(1, rng.choice([1, 4, 14]))]
    rels = {(q, i): rng.choice([0.0, 0.2, 0.5, 0.9]) for q in range(2, 45) for i in range(rng.choice([1, 6, 12]))}
    r, q = spark.createDataFrame(runs, "query_id long, rank int, item_id long"), spark.createDataFrame([(*k, v) for k, v in rels.items()], "query_id long, item_id long, relevance double")
    out = evaluate.at_k(r, q)
    want = {}
    for n in {n for n, _ in rels}:
        own, ideal = sorted(x[1:] for x in runs if x[0] == n), sorted((v for (m, _), v in rels.items() if m == n), reverse=True)
        relevant = sum(v >= 0.5 for v in ideal)
        for k in (1, 3, 5, 10):
            got = [(p, i, rels.get((n, i), 0.0)) for p, i in own if p <= k]
            found, hits = len({i for _, i, v in got if v >= 0.5}), sum(v >= 0.5 for *_, v in got)
            dcg, best = sum(v / math.log2(p + 1) for p, _, v in got), sum(v / math.log2(p + 2) for p, v in enumerate(ideal[:k]))
            a, b = (found / relevant, hits / len(got) if got else 0.0) if relevant else (0.0, 0.0)
            want |= {(n, k, c): x for c, x in enumerate((a, b, dcg, dcg / best if best else 0.0, 2 * a * b / (a + b) if a + b else 0.0))}
    assert {(x.query_id, x.k, c): v for x in out.collect() for c, v in enumerate(x[2:])} == pytest.approx(want)
    assert {evaluate.whole_list(r, q).rdd.getNumPartitions(), out.rdd.getNumPartitions()} == {23}


def test_texts_are_compared_by_numbers_of_the_queries_words(spark, tmp_path):
    rows = texts(200, 3)
    postings.build(spark.createDataFrame(rows, "id long, content string"), f"{tmp_path}/p")
    asked = [(q, " ".join(["THE", "nowhere", *(rows[7 * q][1] or "").split(), *(rows[q + 90][1] or "").split()])) for q in range(25)] + [(25, ""), (26, "nowhere")]
    out = postings.overlap_batch(spark, f"{tmp_path}/p", spark.createDataFrame(asked, "query_id long, query string"), 4)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.overlap))
    assert got == {q: want for q, text in asked if (want := plain_overlap(rows, text, 4))}
    assert "array<string>" not in out._jdf.queryExecution().executedPlan().toString()
