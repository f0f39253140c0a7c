"""Topic logs: every subscriber sees each event once, over restarts, retries, failures and several publishers."""

import os
import threading

import pytest

from loomstone.sources import topics
from loomstone.streaming import bus


def events(spark, folder, rows):
    spark.createDataFrame(rows, topics.EVENTS).coalesce(2).write.mode("append").parquet(folder)
    return spark.readStream.schema(topics.EVENTS).parquet(folder)


def some(lo, hi):
    return [(f"s{k % 3}" if k % 10 else None, f"e{k}", "created" if k % 4 else "deleted", "agent", None if k % 7 == 0 else f"text {k}") for k in range(lo, hi)]


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_two_subscribers_see_each_event_once_over_a_restart(spark, tmp_path):
    root, seen = str(tmp_path / "log"), {"a": [], "b": []}

    def listen(who, after=0):
        handler = lambda rows, n: seen[who].extend(ids(rows))
        bus.subscribed(spark, root, "s1", {None: [handler]}, str(tmp_path / who), after).awaitTermination()

    want = lambda lo, hi: sorted(e[1] for e in some(lo, hi) if e[0] == "s1")
    bus.published(events(spark, str(tmp_path / "in"), some(0, 40)), root, "p", str(tmp_path / "cp")).awaitTermination()
    listen("a")
    assert sorted(seen["a"]) == want(0, 40)
    bus.published(events(spark, str(tmp_path / "in"), some(40, 90)), root, "p", str(tmp_path / "cp")).awaitTermination()
    for _ in range(2):
        listen("a")
        listen("b")
    assert sorted(seen["a"]) == sorted(seen["b"]) == want(0, 90)
    later = []
    bus.subscribed(spark, root, "s1", {None: [lambda rows, n: later.extend(ids(rows))]}, str(tmp_path / "c"), after=1).awaitTermination()
    assert sorted(later) == want(40, 90)
    assert sorted(ids(bus.replayed(spark, root, "s1", 1))) == want(40, 90)
    everything = bus.replayed(spark, root).collect()
    assert sorted(r.position for r in everything) == list(range(90)) and {tuple(r)[:5] for r in everything} == set(some(0, 90))


def test_a_batch_that_runs_again_publishes_nothing(spark, tmp_path):
    root = str(tmp_path / "log")
    bus.published(events(spark, str(tmp_path / "in"), some(0, 10)), root, "p", str(tmp_path / "cp")).awaitTermination()
    bus.published(spark.readStream.schema(topics.EVENTS).parquet(str(tmp_path / "in")), root, "p", str(tmp_path / "lost checkpoint")).awaitTermination()
    assert topics.committed(root) == 1 and bus.replayed(spark, root).count() == 10
    assert len(os.listdir(f"{root}/data")) == len(topics.manifest(root, 1)["segments"])
    bus.published(spark.readStream.schema(topics.EVENTS).parquet(str(tmp_path / "in")), root, "another", str(tmp_path / "cp2")).awaitTermination()
    assert bus.replayed(spark, root).count() == 20


def test_segments_without_a_manifest_are_not_read(spark, tmp_path):
    root = str(tmp_path / "log")
    bus.published(events(spark, str(tmp_path / "in"), some(0, 10)), root, "p", str(tmp_path / "cp")).awaitTermination()
    import pyarrow as pa

    writer = topics.Publisher({"path": root, "writer": "q"})
    message = writer.write(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*some(50, 60))], schema=topics.SCHEMA)]))
    assert bus.replayed(spark, root).count() == 10
    writer.abort([message, None], 0)
    assert all(not os.path.exists(f"{root}/data/{s['file']}") for s in message.segments)


def test_publishers_at_once_take_different_numbers(tmp_path):
    root = str(tmp_path / "log")
    work = [threading.Thread(target=lambda w=w: [topics.commit(root, w, b, [{"file": f"{w}{b}", "bucket": 0, "n": 3}]) for b in range(15)]) for w in "abcd"]
    for t in work:
        t.start()
    for t in work:
        t.join()
    found = [topics.manifest(root, k) for k in range(1, topics.committed(root) + 1)]
    assert len(found) == 60 and {(m["writer"], m["batch"]) for m in found} == {(w, b) for w in "abcd" for b in range(15)}
    assert [m["first"] for m in found] == list(range(0, 180, 3))
    assert topics.commit(root, "b", 7, []) is None


def test_handlers_by_type_and_one_that_fails(spark, tmp_path):
    root, seen = str(tmp_path / "log"), {"created": [], "deleted": [], "all": []}
    bus.published(events(spark, str(tmp_path / "in"), some(0, 30)), root, "p", str(tmp_path / "cp")).awaitTermination()
    keep = lambda k: lambda rows, n: seen[k].extend(ids(rows))

    def fail(rows, n):
        raise RuntimeError("no")

    with pytest.raises(Exception, match="no"):
        bus.subscribed(spark, root, None, {"created": [fail, keep("created")], None: [keep("all")]}, str(tmp_path / "a")).awaitTermination()
    assert len(seen["created"]) == sum(e[2] == "created" for e in some(0, 30)) and len(seen["all"]) == 30
    seen["created"], seen["all"] = [], []
    bus.subscribed(spark, root, None, {"created": [keep("created")], "deleted": [keep("deleted")]}, str(tmp_path / "a")).awaitTermination()
    assert sorted(seen["created"] + seen["deleted"]) == sorted(e[1] for e in some(0, 30))


def test_watch_queue_of_a_session_without_events(spark, tmp_path):
    root = str(tmp_path / "log")
    bus.published(events(spark, str(tmp_path / "in"), some(0, 12)), root, "p", str(tmp_path / "cp")).awaitTermination()
    for session, n in (("s2", 4), ("nobody", 0)):
        for _ in range(2):
            bus.watched(spark, root, session, str(tmp_path / f"q{session}"), str(tmp_path / f"w{session}")).awaitTermination()
        assert spark.read.schema(topics.EVENTS).parquet(str(tmp_path / f"q{session}")).count() == n
    assert bus.replayed(spark, root, "nobody").count() == 0
