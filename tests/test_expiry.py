"""Expiry, automatic approval and resolution of interventions: orders of arrival, restarts, timers."""

import datetime as dt
import itertools
import random

from loomstone.streaming import expiry

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def plain(events, watermark):
    """Outcomes by definition, of interventions whose end the watermark has passed or a resolution has told."""
    out = {}
    for i in {e[0] for e in events}:
        made = [e for e in events if e[0] == i and e[2] == "created"]
        if not made:
            continue
        c = min(made, key=lambda e: e[3])
        auto = c[6] is not None and c[6] < 300
        deadline = c[3] + dt.timedelta(seconds=c[6] if auto else 300)
        done = sorted((e for e in events if e[0] == i and e[2] == "resolved"), key=lambda e: e[3])
        if done and done[0][3] <= deadline:
            out[i] = (c[1], done[0][4], done[0][5], done[0][3])
        elif done or deadline < watermark:
            out[i] = (c[1], "approved" if auto else "expired", "system", deadline)
    return out


EVENTS = [
    ("a", "s1", "created", at(0), None, None, None), ("a", "s1", "resolved", at(20), "approved", "ann", None),
    ("b", "s1", "created", at(1), None, None, None),
    ("c", "s2", "created", at(2), None, None, 60.0),
    ("d", "s2", "created", at(3), None, None, 60.0), ("d", "s2", "resolved", at(30), "rejected", "bob", None),
    ("e", "s2", "created", at(4), None, None, None), ("e", "s2", "resolved", at(400), "approved", "late", None),
    ("f", "s3", "created", at(5), None, None, 900.0),
    ("g", "s3", "resolved", at(6), "approved", "nobody", None),
    ("h", "s3", "created", at(7), None, None, None), ("h", "s3", "created", at(7), None, None, None), ("h", "s3", "resolved", at(8), "modified", "ann", None), ("h", "s3", "resolved", at(9), "rejected", "bob", None),
]
END = ("z", "s9", "created", at(100_000), None, None, None)


def run(spark, folder, batches, late="20 minutes"):
    """Batches of events, a run of the stream after each; what has come out so far."""
    for rows in batches:
        spark.createDataFrame(rows, expiry.EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = expiry.outcomes(spark.readStream.schema(expiry.EVENT).parquet(f"{folder}/in"), late)
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(expiry.OUT).parquet(f"{folder}/out").collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: (r.session_id, r.status, r.by, r.at) for r in rows}


def test_each_intervention_ends_once_and_restarts_lose_none(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    want = plain(EVENTS, at(90_000))
    assert want["c"][1:3] == ("approved", "system") and want["e"][1] == "expired" and want["f"][1] == "expired" and want["h"][2] == "ann" and "g" not in want
    assert run(spark, tmp_path / "one", [EVENTS + [END]]) == want
    some = run(spark, tmp_path / "two", [EVENTS[:5], EVENTS[5:]])
    assert set(some) == {"a", "d", "e", "h"}  # no timer has fired yet
    assert run(spark, tmp_path / "two", [[END]]) == want


def test_out_of_order_within_the_watermark(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events = EVENTS[::-1]
    assert run(spark, tmp_path, [events[:6], events[6:], [END]]) == plain(EVENTS, at(90_000))


def test_steps_in_any_order_end_alike():
    rng = random.Random(4)
    for _ in range(60):
        own = [("created", 0, "s", None, None, rng.choice([None, 100.0, 500.0]))] * rng.randint(1, 2) + [("resolved", rng.choice([50, 100, 200, 300, 301]) * 10**6, "s", "approved", f"u{k}", None) for k in range(rng.randint(0, 2))]
        ends = set()
        for order in itertools.permutations(own):
            state, outcome = expiry.step(None, list(order))
            if not outcome:
                outcome = expiry.passed(state[2], state[3])
            ends.add(outcome)
        assert len(ends) == 1
