"""Working, short-term and long-term memory of each session as a stateful stream.

A session keeps its last `working` items; what falls out queues up and is
compressed in batches; once `short` compressed rows are there, the oldest share
moves on to long-term memory.  Nothing is lost on the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id long, layer string, ids array<string>, content string"


@dataclass(frozen=True)
class Limits:
    working: int = 10
    batch: int = 5
    short: int = 50
    share: float = 0.3
    cut: int = 2000


def step(state: tuple[list, list, list], items: list[tuple[str, str]], limits: Limits = Limits()) -> tuple[tuple[list, list, list], list[tuple]]:
    """(working, queue, short) after the items, and the rows (layer, ids, content) that they make."""
    working, queue, short = (list(x) for x in state)
    out: list[tuple] = []
    for item in items:
        if len(working) >= limits.working:
            queue.append(working.pop(0))
        working.append(item)
        if len(queue) >= limits.batch:
            text = "\n".join(t for _, t in queue)
            row = ([i for i, _ in queue], text if len(text) <= limits.cut else text[: limits.cut] + "...")
            queue = []
            short.append(row)
            out.append(("short_term", *row))
            if len(short) >= limits.short:
                n = int(len(short) * limits.share)
                out += [("long_term", *r) for r in short[:n]]
                short = short[n:]
    return (working, queue, short), out


def cascade(items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows (session_id, layer, ids, content) as they reach a layer, from a stream (session_id, id, content, nth)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches]).sort_values("nth", kind="stable")
        held = state.get if state.exists else ([], [], [], [], [], [])
        before = ([*zip(held[0], held[1])], [*zip(held[2], held[3])], [([*i], t) for i, t in zip(held[4], held[5])])
        (w, q, s), out = step(before, [*zip(rows["id"], rows["content"])], limits)
        state.update(([i for i, _ in w], [t for _, t in w], [i for i, _ in q], [t for _, t in q], [i for i, _ in s], [t for _, t in s]))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["session_id", "layer", "ids", "content"])

    kept = "wi array<string>, wt array<string>, qi array<string>, qt array<string>, si array<array<string>>, st array<string>"
    rows = items.select("session_id", "id", "content", F.col("nth").cast("long").alias("nth"))
    return rows.groupBy("session_id").applyInPandasWithState(run, OUT, kept, "append", GroupStateTimeout.NoTimeout)
