"""Queries and operators on inputs beyond the bounds that they once had."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import chunks, evaluate, graph, search, tables, upkeep, windows
from loomstone.plans import more, texts, views
from loomstone.streaming import changes


def test_line_numbers_of_long_documents(spark, tmp_path):
    texts = ["\n".join(f"line {k}" for k in range(n)) for n in (1, 398, 399, 400, 1000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = more.win09(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.line_no, r.line) for r in got) == [(i, k + 1, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]


def test_cycles_of_any_length(spark):
    ring = [(k, (k + 1) % 60) for k in range(60)]
    deps = spark.createDataFrame([*ring, ring[0], (100, 0), (70, 70), (80, 81), (81, 80), (81, 82)], "task long, dep long")
    assert sorted((r.start, r.path) for r in graph.cycles(deps).collect()) == [(0, list(range(60))), (70, [70]), (80, [80, 81])]


def naive_chunks(text, size=512, overlap=50):
    """Character by character: the last end of a sentence in reach, else the whole size."""
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for k in range(end, start, -1):
                if text[k] in ".!?:\n":
                    end = k + 1
                    break
        out.append(text[start:end])
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def naive_lines(text, size=512):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            for k in range(end - 1, start, -1):
                if text[k] == "\n":
                    end = k + 1
                    break
        out.append(text[start:end])
        start = end
    return out


def naive_heads(text, is_head, kind, size=512):
    lines, starts, at = text.split("\n"), [], 0
    for k, line in enumerate(lines):
        if is_head(line):
            starts.append(max(at - 1, 0) if k else 0)
        at += len(line) + 1
    if len(starts) < 2:
        return naive_chunks(text)
    pieces = [text[: starts[0]].strip()] + [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])]
    return [p for whole in pieces if whole for p in (naive_lines(whole, size) if kind == "code" and len(whole) > size and whole is not pieces[0] else [whole])]


def is_code(line):
    w = line.split(None, 1)
    return len(w) == 2 and w[0] in ("class", "def", "function") and line.startswith(w[0]) and (w[1][0].isalnum() or w[1][0] == "_")


def is_heading(line):
    n = len(line) - len(line.lstrip("#"))
    return 1 <= n <= 6 and line[n : n + 1].isspace() and bool(line[n:].strip())


@pytest.mark.parametrize("query", ["chk01_chunks_by_type", "chk02_text_chunks", "chk03_code_chunks", "chk04_markdown_chunks", "chk05_oversize_split"])
def test_chunks_equal_a_naive_walk(spark, monkeypatch, query):
    sent = {}
    real = chunks.chunked

    def spy(docs, id, text, kind, *a):
        sent["rows"] = docs.select(id, text, kind).collect()
        return real(docs, id, text, kind, *a)

    monkeypatch.setattr(chunks, "chunked", spy)
    got = {}
    for r in (texts.QUERIES | more.QUERIES)[query](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.id, {})[r.chunk_index] = r.text
    assert len(sent["rows"]) > 1
    for i, text, kind in sent["rows"]:
        walk = {"code": lambda t: naive_heads(t, is_code, "code"), "markdown": lambda t: naive_heads(t, is_heading, "markdown")}.get(kind, naive_chunks)
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == walk(text or "")


def test_capacity_phases_equal_a_plain_schedule(spark):
    d = "/root/testdata/sf0.001"
    role = {r.task: r.role for r in views.tasks(spark, d).collect()}
    needs = {t: {r.dep for r in views.deps(spark, d).collect() if r.task == t} for t in role}
    phase = {}
    for k in range(len(role)):
        free = {"role0": 2, "role1": 3}
        for _, t in sorted((len(needs[t]), t) for t in role if t not in phase and all(phase.get(x, k) < k for x in needs[t])):
            if free.setdefault(role[t], 1):
                free[role[t]] -= 1
                phase[t] = k
    from loomstone.plans import stats

    assert {r.task: r.phase for r in stats.gr08(spark, d).collect()} == phase


def test_extracted_triples(spark):
    got = more.prs07(spark, "/root/testdata/sf0.001").collect()
    want = {f"{r.conv_id}:{r.turn}": len(r.text or "") for r in views.table(spark, "/root/testdata/sf0.001", "conversations").collect()}
    assert {r.id: int(r.object) for r in got} == want and {(r.subject, r.relation) for r in got} == {("t", "has")}


def test_a_crash_between_writes_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    with pytest.raises(tables.NoSnapshot):
        tables.read_snapshot(spark, root)
    assert tables.load_or_new(spark, root, "a int").count() == 0
    rows = lambda n: spark.range(n).select(F.col("id").cast("int").alias("a"))
    tables.write_snapshot(rows(3), root)

    class Crash(Exception):
        pass

    def crash(*_, **__):
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(tables.json, "dumps", crash)  # the rows are written, the pointer isn't
        with pytest.raises(Crash):
            tables.write_snapshot(rows(5), root)
    assert tables.read_snapshot(spark, root).count() == 3
    for n in (6, 7, 8):
        tables.write_snapshot(rows(n), root)
    tables.forget_snapshots(spark, root, 2)
    assert tables.read_snapshot(spark, root).count() == 8
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("current-")]) == 2


def test_gone_files_leave_the_state(spark, tmp_path):
    root, state, gone = tmp_path / "src", str(tmp_path / "state"), []
    root.mkdir()
    for name in ("a.py", "b.py"):
        (root / name).write_text(name)

    def run():
        stream = changes.file_stream(spark, str(root))
        changes.indexed(stream, state, str(tmp_path / "cp"), lambda rows, n: rows.count(), str(root), lambda rows, n: gone.extend(r.path.rpartition("/")[2] for r in rows.collect())).awaitTermination()

    run()
    (root / "a.py").unlink()
    (root / "c.py").write_text("c")
    run()
    assert gone == ["a.py"]
    assert sorted(r.path.rpartition("/")[2] for r in tables.read_snapshot(spark, state).collect()) == ["b.py", "c.py"]


def test_policies(spark):
    rows = spark.createDataFrame([("delete", 1, 0), ("drop", 101, 4), ("undelete", 100, 3), (None, None, None)], "operation_type string, estimated_cost int, error_count int")
    got = rows.select(*(F.coalesce(search.any_condition(c), F.lit(False)).alias(n) for n, c in upkeep.POLICIES.items())).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, True, True), (False, False, False), (False, False, False)]


def test_batches_of_queries(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(99, None)], "id long, vector array<double>").repartition(5)
    queries = rows.filter("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    want = {(q, i, r + 1) for q in range(0, 60, 3) for r, (_, i) in enumerate(sorted((float(((v[i] - v[q]) ** 2).sum()), i) for i in range(60))[:5])}
    for block in (7, 4096):
        assert {(r.query_id, r.id, r["rank"]) for r in search.knn_batch(rows, queries, 5, block=block).collect()} == want
    assert search.knn_batch(rows, queries.limit(0)).count() == 0


def test_windows_over_partitions(spark):
    random.seed(1)
    rows = [(k, random.randrange(50)) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r.id: r.nth for r in windows.numbered(df, "nth", F.desc("v"), F.col("id")).collect()}
    assert got == {i: n + 1 for n, (_, i) in enumerate(sorted((-v, i) for i, v in rows))}
    known = df.withColumn("known", F.col("id").isin(17, 300))
    order = sorted((-v, i) for i, v in rows)
    first = next(n for n, (_, i) in enumerate(order) if i in (17, 300))
    assert {r.id for r in windows.until_known(known, "known", "v", "id", descending=("v",)).collect()} == {i for _, i in order[:first]}
    assert windows.until_known(df.withColumn("known", F.lit(False)), "known", "id").count() == 500
    s = {r.kind: r for r in evaluate.latency(df.withColumn("kind", F.col("id") % 3), "kind", "v").collect()}
    for kind in range(3):
        own = sorted(v for i, v in rows if i % 3 == kind)
        assert (s[kind].p50, s[kind].p95, s[kind].p99) == (own[len(own) // 2], own[int(len(own) * 0.95)], own[int(len(own) * 0.99)])


def test_tiers_hold_every_item(spark):
    from loomstone.streaming import cascade

    rows = spark.range(1, 700).select("id", *(c.alias(n) for n, c in upkeep.tier_sizes(F.col("id")).items())).collect()
    state, limits = ([], [], []), cascade.Limits()
    for r in sorted(rows, key=lambda r: r.id):
        state, _ = cascade.step(state, [(str(r.id), "t")], limits)
        assert (r.working, r.waiting, r.short_term) == tuple(map(len, state))
        assert r.working + r.waiting + 5 * (r.short_term + r.long_term) == r.id


def test_upkeep_runs_until_it_is_stopped(spark):
    import time

    seen = []
    query = changes.every(spark, seen.append, minutes=1 / 60)
    end = time.time() + 30
    while len(seen) < 2 and time.time() < end:
        time.sleep(0.2)
    query.stop()
    assert len(seen) >= 2
