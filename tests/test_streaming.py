"""Streams run to their end on small inputs."""

from loomstone.operators import tables
from loomstone.streaming import cascade, changes


def test_file_changes(spark, tmp_path):
    root, state, seen = tmp_path / "src", str(tmp_path / "state"), []
    root.mkdir()
    (root / "a.py").write_text("x = 1")
    (root / "b.txt").write_text("skip")

    def run():
        stream = changes.file_stream(spark, str(root), includes=("*.py",))
        changes.indexed(stream, state, str(tmp_path / "cp"), lambda rows, n: seen.append(sorted(r.content for r in rows.collect()))).awaitTermination()

    run()
    (root / "c.py").write_text("y = 2")
    run()
    assert seen == [["x = 1"], ["y = 2"]]
    assert tables.read_snapshot(spark, state).count() == 2


def test_store_then_publish(spark, tmp_path):
    spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2")], "id long, content string, session_id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, content string, session_id string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        changes.stored_then_published(stream, str(tmp_path / "t"), str(tmp_path / "topics"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert spark.read.json(str(tmp_path / "topics" / "batch=0" / "session_id=s1")).count() == 1


def test_cascade(spark, tmp_path):
    limits = cascade.Limits(working=3, batch=2, short=4, share=0.5)
    rows = [(k % 2, f"i{k}", f"text {k}", k) for k in range(40)]
    for lo in (0, 25):
        spark.createDataFrame(rows[lo : lo + 25 if lo == 0 else 40], "session_id long, id string, content string, nth long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("session_id long, id string, content string, nth long").parquet(str(tmp_path / "in"))
        out = cascade.cascade(stream, limits)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.session_id, r.layer, tuple(r.ids), r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = []
    for s in (0, 1):
        _, out = cascade.step(([], [], []), [(i, t) for x, i, t, _ in rows if x == s], limits)
        want += [(s, layer, tuple(ids), t) for layer, ids, t in out]
    assert got == sorted(want) and any(r[1] == "long_term" for r in got)


def test_cascade_keeps_every_item():
    state, out = cascade.step(([], [], []), [(str(k), "t") for k in range(1000)])
    working, queue, short = state
    assert len(working) == 10 and len(short) < 50
    compressed = [i for layer, ids, _ in out if layer == "short_term" for i in ids]
    assert sorted([i for i, _ in working + queue] + compressed, key=int) == [str(k) for k in range(1000)]


def test_windowed_counts(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = changes.windowed_counts(stream, "ts", "event_type", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 1000
