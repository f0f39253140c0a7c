"""Sources, parsers, tables and reports on small fixtures."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomstone.functions import text as T
from loomstone.operators import chunks, composite, embed, graph, report, search, sessions, tables, triples
from loomstone.sources import code, files, git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")

    def run(*args):
        subprocess.run(["git", "-C", str(at), "-c", "user.name=Test User", "-c", "user.email=test@example.com", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    steps = [("README.md", "# Demo\n", "Initial commit: Add README"), ("auth.py", "def login():\n    pass\n", "feat(auth): Add login function"), ("auth.py", "def login():\n    return 1\n\n\ndef other():\n    return 2\n", "fix(auth): Implement login logic"), ("utils.py", "def helper():\n    return 3\n", "feat(utils): Add helper function")]
    for k, (name, text, message) in enumerate(steps):
        (at / name).write_text(text)
        run("add", ".")
        run("-c", "core.hooksPath=/dev/null", "commit", "-q", "-m", message, "--date", f"2024-01-0{k + 1}T00:00:00+00:00")
    run("mv", "utils.py", "tools.py")
    run("commit", "-q", "-m", "Rename")
    return str(at)


def test_git_log(spark, repo):
    log = git.recent(spark, repo)
    rows = log.collect()
    assert len(rows) == 5 and all(len(r.hash) == 8 and r.author == "Test User <test@example.com>" for r in rows)
    of = {r.message: r for r in rows}
    fix = of["fix(auth): Implement login logic"]
    assert fix.files == ["auth.py"] and (fix.insertions, fix.deletions) == (5, 1) and fix.diff_summary == "auth.py: +5/-1"
    assert of["Rename"].files == ["tools.py"]
    assert git.recent(spark, repo, file="auth.py").count() == 2 and git.recent(spark, repo, 3).count() == 3
    assert git.by_author(log, "TEST user").count() == 5 and git.by_author(log, "nobody").count() == 0
    assert git.by_pattern(log, "AUTH").count() == 2


def test_blame_and_evolution(spark, repo):
    git.register(spark)
    lines = spark.read.format("gitblame").option("path", repo).option("file", "auth.py").load()
    assert [r.content for r in lines.orderBy("line_no").collect()][:2] == ["def login():", "    return 1"]
    assert lines.filter("line_no = 2").count() == 1
    got = git.evolution(spark, repo, "auth.py", "login").collect()
    assert {r.content for r in got} == {"def login():\n    pass", "def login():\n    return 1"}
    assert git.section("class A:\n  def f(self):\n    x\n\n  def g(self):\n    y", "f") == "  def f(self):\n    x"
    assert git.section("x", "f") is None


PY = '''import os
from typing import Any, List as L
class A(Base):
    """Doc."""
    @property
    def m(self, x: int = 1) -> str:
        return str(x)
async def go(a, *, b=2):
    await run(a)
'''
JS = "export class B extends C {\n  x() { return '}'; }\n}\nasync function f(a, b) {\n  if (a) { return 1; }\n}\n"


def test_files_and_symbols(spark, tmp_path):
    (tmp_path / "a.py").write_text(PY)
    (tmp_path / "bad.py").write_text("def (:")
    (tmp_path / "b.js").write_text(JS)
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "c.py").write_text("x = 1")
    found = files.files(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.kind for r in found.collect()} == {"a.py": "python", "bad.py": "python", "b.js": "javascript"}
    rows = {r.name: r for r in code.symbols(found).collect()}
    assert {n: r.symbol_type for n, r in rows.items()} == {"A": "class", "A.m": "method", "go": "function", "B": "class", "f": "function"}
    assert rows["A.m"].signature == "def m(self, x: int=1) -> str" and rows["A.m"].decorators == ["property"] and rows["A"].docstring == "Doc."
    assert rows["go"].is_async and "*" in rows["go"].signature and rows["f"].content.endswith("}") and rows["B"].content.count("\n") == 2
    imported = code.imports(found)
    assert {(r.module, *r.names) for r in imported.collect()} == {("os",), ("typing", "Any", "List")}
    assert {r.callee for r in code.calls(found).collect()} == {"str", "run"}
    assert code.chunks(code.symbols(found), imported).filter("name = 'A'").first().text.startswith("from typing import Any, List\nimport os\n\nclass A")


def test_sessions(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"session_id": "s1", "decisions": [{"content": "Use redis"}, "plain text"], "project": "p", "working_directory": "/a", "timestamp": "2024-01-01T00:00:00Z"}))
    (tmp_path / "2.json").write_text("{broken")
    got = files.sessions(spark, str(tmp_path))
    assert got.count() == 1
    assert [r.content for r in files.decisions(got).orderBy("nth").collect()] == ["Use redis", "plain text"]
    (tmp_path / "q.set").write_text(json.dumps({"queries": [{"query": "x", "expected": [{"id": "a"}, {"id": "b", "relevance": 0.5}]}]}))
    assert {(r.item_id, r.relevance) for r in files.qrels(spark, str(tmp_path / "q.set")).collect()} == {("a", 1.0), ("b", 0.5)}


def test_chunks():
    text = "One. " * 300
    parts = [*chunks.by_size(text)]
    assert all(len(p) <= 514 for p in parts) and all(p.endswith((".", " ")) for p in parts) and parts[0] + "".join(p[50:] for p in parts[1:]) == text
    assert [*chunks.by_size("a." + "b" * 600 + "c" * 600)][0] == "a."  # a sole boundary near the start still advances
    assert [*chunks.by_size("")] == []
    assert [p for p, *_ in chunks.pieces("intro\n# A\nx\n## B\ny", "markdown")] == ["intro", "# A\nx", "## B\ny"]
    assert len([*chunks.pieces("def a():\n" + "  x\n" * 300 + "def b():\n  y", "code")]) == 4
    assert [*chunks.pieces(None, "text")] == []


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "def login(user): return user"), (2, ""), (3, "the and of"), (4, "ñé")], "id int, text string")
    got = embed.hashed_tf(df, "id", "text")
    assert {r.id for r in got.collect()} == {1}
    assert got.groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("value")), 9).alias("n")).first().n == 1
    assert len(embed.dense(got).first().vector) == 384
    assert embed.hashed_grams(df, "id", "text").filter("id = 2").count() == 0 and embed.embedder("unknown") is embed.hashed_tf


def test_texts(spark):
    df = spark.createDataFrame([("C++ db redis redis API; Größe größe größe",), ("",), (None,)], "t string")
    got = df.select(T.keyword_words(F.col("t")).alias("w"), T.shingles(F.col("t")).alias("s")).collect()
    assert got[0].w == ["redis", "redis", "api", "größe", "größe", "größe"] and got[1].w == []
    assert len(got[0].s) == 6 and got[1].s == []
    sig = df.limit(1).select(T.minhash(T.shingles(F.col("t"))).alias("m")).first().m
    assert len(sig) == 128


def test_duplicates_at_the_bounds(spark):
    words = lambda i, ws: [(i, w) for w in ws]
    a = spark.createDataFrame(words(1, "abcdefghij") + words(2, "abcde"), "id int, word string")
    b = spark.createDataFrame(words(10, "abcdefgh") + words(11, "abcxyzuvw") + words(12, "klm"), "id int, word string")
    got = {(r.a, r.b): (round(r.jaccard, 6), r.is_duplicate) for r in sessions.duplicates(a, b).collect()}
    assert got == {(1, 10): (0.8, True), (2, 10): (0.625, False)}  # 3 of 11, and 3 of 16, are too few


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, version int, v int")
    new = spark.createDataFrame([("a", 1, 2), ("c", 0, 3)], "k string, version int, v int")
    assert {tuple(r) for r in tables.upserted(old, new, ["k"], "version").collect()} == {("a", 1, 2), ("b", 1, 1), ("c", 0, 3)}
    root = str(tmp_path / "t")
    first = tables.write_snapshot(old, root)
    second = tables.write_snapshot(tables.deleted(tables.read_snapshot(spark, root), new, "k"), root, ["k"])
    assert first != second and [r.k for r in tables.read_snapshot(spark, root).collect()] == ["b"]
    chunks_ = spark.createDataFrame([("x", 1), ("y", 1)], "path string, n int")
    assert {tuple(r) for r in tables.replaced(chunks_, spark.createDataFrame([("x", 9)], "path string, n int"), chunks_.filter("path = 'y'")).collect()} == {("x", 9)}


def test_graphs(spark):
    deps = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 5), (7, 8), (8, 7), (9, 99)], "task long, dep long")
    assert {tuple(r.path) for r in graph.cycles(deps).collect()} == {(1, 2, 3), (5,), (7, 8)}
    tasks = spark.createDataFrame([(k, "r", "pending") for k in (1, 9, 10)], "task long, role string, state string")
    assert [r.task for r in graph.ready(tasks, deps).collect()] == [10]
    assert sorted(map(tuple, graph.scheduled(tasks, deps.filter("task = 9"), {"r": 1}).collect())) == [(0, 1), (1, 10)]


def test_triples(spark):
    df = spark.createDataFrame([(1, 'Sure:\n```json\n{"triples":[{"subject":" A ","relation":"r","object":"b"},{"subject":"x"}]}\n```'), (2, '[{"subject":"a","relation":"R","object":"B","confidence":0.2}]'), (3, "none")], "id int, reply string")
    got = triples.parsed(df, "id", "reply")
    assert {tuple(r) for r in got.collect()} == {(1, "A", "r", "b", 1.0), (2, "a", "R", "B", 0.2)}
    assert [tuple(r) for r in triples.distinct(got).collect()] == [("A", "r", "b", 1.0)]


def test_services_and_reports(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = composite.mapped_texts(df, "id", "text", lambda: lambda ts: [[float(len(t))] for t in ts], "array<double>")
    assert {r.id: r.value for r in got.collect()} == {1: [2.0], 2: [0.0]}
    m = spark.createDataFrame([("a|b", 0.5)], "name string, value double")
    assert json.loads(report.to_json(m)) == [{"name": "a|b", "value": 0.5}]
    assert "a\\|b" in report.to_markdown(m) and "<td>0.5000</td>" in report.to_html(m)
    assert m.filter(search.any_condition([{"field": "value", "operator": "less_than", "value": 1}, {"field": "x", "operator": "odd", "value": 1}])).count() == 1
