"""Interventions that wait for people: expiry, automatic approval and resolution as a stateful stream.

An intervention is open from its creation until the first of three things in event
time: someone resolves it, its policy approves it by itself, or it expires.  They are
held in buckets by the hash of their ids, so a session that has very many doesn't gather
in one task, and state is read and written once a bucket and batch.  Timers fire as the watermark passes a deadline; a resolution that comes first deletes
the timer.  The outcome follows from the events' times alone, in whatever order they
come within the watermark: a resolution may come before its creation, or after a
deadline that has passed without the timer having fired.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "created long, session string, deadline long, automatic boolean, resolved long, status string, who string, closed boolean"
HELD = f"id string, {STATE}"
OUT = "id string, session_id string, status string, by string, at timestamp"
#: Events: what says "created" or "resolved"; status, by: of a resolution; auto_approve_after: seconds, null where a policy has none.
EVENT = "id string, session_id string, what string, at timestamp, status string, by string, auto_approve_after double"
SECONDS = 300.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(held: tuple | None, events: list[tuple], seconds: float = SECONDS) -> tuple[tuple, tuple | None]:
    """State after events (what, micros, session, status, by, auto_approve_after) of one intervention, and its outcome (status, by, micros) if they decide it.

    Of repeated creations and of repeated resolutions the earliest counts.
    """
    created, session, deadline, automatic, resolved, status, who, closed = held or (None, None, None, False, None, None, None, False)
    if closed:
        return held, None
    for what, at, own, to, by, after in sorted(events, key=lambda e: (e[1], str(e[3]), str(e[4]))):
        if what == "created" and (created is None or at < created):
            auto = after is not None and after == after and after < seconds
            created, session, automatic, deadline = at, own, bool(auto), at + int((after if auto else seconds) * 1e6)
        elif what == "resolved" and (resolved is None or at < resolved):
            resolved, status, who = at, to, by
    outcome = None
    if created is not None and resolved is not None:
        closed = True
        outcome = (status, who, resolved) if resolved <= deadline else passed(deadline, automatic)
    return (created, session, deadline, automatic, resolved, status, who, closed), outcome


def passed(deadline: int, automatic: bool) -> tuple:
    """Outcome of an intervention that nobody has resolved by its deadline."""
    return ("approved", "system", deadline) if automatic else ("expired", "system", deadline)


class Waiting(StatefulProcessor):
    """The interventions of a bucket: the open ones' states as one map, and one timer, for the first that ends."""

    def __init__(self, seconds: float = SECONDS):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("interventions", HELD)

    def _open(self) -> dict[str, tuple]:
        return {id: tuple(rest) for id, *rest in self.state.get()} if self.state.exists() else {}

    def _ends(self, state: tuple) -> int:
        """When a state isn't needed any more, in milliseconds: a closed one is remembered, and a resolution without creation kept, until late events can't come."""
        created, _, deadline, _, resolved, *_ = state
        return -(-(deadline if created is not None else resolved + int(self.seconds * 1e6)) // 1000)

    def _keep(self, held: dict[str, tuple]) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if held:
            self.state.put([(id, *state) for id, state in held.items()])
            self.handle.registerTimer(min(map(self._ends, held.values())))
        else:
            self.state.clear()

    def _rows(self, ended: list[tuple]) -> pd.DataFrame:
        ids, sessions, outcomes = zip(*ended)
        status, by, at = zip(*outcomes)
        return pd.DataFrame({"id": ids, "session_id": sessions, "status": status, "by": by, "at": pd.to_datetime([x * 1000 for x in at])})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        told: dict[str, list[tuple]] = {}
        for part in rows:
            micros = part["at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            for id, *event in zip(part["id"], part["what"], micros, part["session_id"], part["status"], part["by"], part["auto_approve_after"]):
                told.setdefault(id, []).append(tuple(event))
        held, ended = self._open(), []
        for id, events in told.items():
            held[id], outcome = step(held.get(id), events, self.seconds)
            if outcome:
                ended.append((id, held[id][1], outcome))
        self._keep(held)
        if ended:
            yield self._rows(ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark, held, ended, left = timerValues.getCurrentWatermarkInMs(), self._open(), [], {}
        for id, state in held.items():
            if self._ends(state) >= mark:
                left[id] = state
                continue
            created, session, deadline, automatic, *_, closed = state
            if created is not None and not closed:
                ended.append((id, session, passed(deadline, automatic)))
        if len(left) < len(held):
            self._keep(left)
        if ended:
            yield self._rows(ended)

    def close(self) -> None:
        pass


#: Buckets of ids, each a key of the stream's state.
BUCKETS = 4096


def outcomes(events: DataFrame, late: str = "10 minutes", seconds: float = SECONDS) -> DataFrame:
    """(id, session_id, status, by, at): a row for each intervention as it ends, from a stream of events (columns of EVENT).

    status: the resolution's, `approved` by `system` after auto_approve_after seconds where
    that is set and shorter, or `expired` after `seconds`.  Events later than the
    watermark are left out; ids and times are not null.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in EVENT.split(", "))).filter("id is not null and at is not null")
    return rows.withWatermark("at", late).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(Waiting(seconds), OUT, "Append", "EventTime")
