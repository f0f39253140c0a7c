"""Session topics as a Spark source and sink: `topics`, a log of events with positions.

Below its folder a topic log has `data` (parquet segments, each of one bucket of
sessions) and `commits` (numbered manifests).  A publishing task writes its segments; the
commit then names them all in the next manifest, which is made by a hard link, so it is
there whole or not at all and two publishers never take one number.  A batch that runs
again finds its name in the log and changes nothing; segments of an attempt that failed are
named by no manifest and never read.

Offsets are numbers of manifests.  A subscriber reads the segments of its session's
bucket, from any manifest on, in parallel; each event has a position, one more than
that of the event before it.  Nothing is deleted, so any number of subscribers read
at their own pace.  The folder is mounted on all machines.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

EVENTS = "session_id string, id string, event_type string, source string, content string"
SCHEMA = pa.schema([(c.split()[0], pa.string()) for c in EVENTS.split(", ")])
BUCKETS = 64


def bucket(session: str | None) -> int:
    return zlib.crc32((session or "").encode()) % BUCKETS


# --- manifests


def _manifest(root: str, number: int) -> str:
    return f"{root}/commits/{number:012d}.json"


def committed(root: str, after: int = 0) -> int:
    """Number of the last manifest, at least `after`; looks at what comes after it only."""
    if not after and os.path.isdir(f"{root}/commits"):
        after = max((int(n[:12]) for n in os.listdir(f"{root}/commits") if n.endswith(".json")), default=0)
    while os.path.exists(_manifest(root, after + 1)):
        after += 1
    return after


def manifest(root: str, number: int) -> dict:
    with open(_manifest(root, number)) as f:
        return json.load(f)


def commit(root: str, writer: str, batch: int, segments: list[dict]) -> int | None:
    """Names the segments (file, bucket, n) in the next manifest; its number, or None if this writer has committed the batch already."""
    os.makedirs(f"{root}/commits", exist_ok=True)
    last = committed(root)
    for number in range(last, 0, -1):  # a writer's batches ascend: its last manifest tells
        m = manifest(root, number)
        if m["writer"] == writer:
            if m["batch"] >= batch:
                return None
            break
    held = f"{root}/commits/.{uuid.uuid4().hex}"
    while True:
        before = manifest(root, last) if last else {"first": 0, "n": 0}
        with open(held, "w") as f:
            json.dump({"writer": writer, "batch": batch, "first": before["first"] + before["n"], "n": sum(s["n"] for s in segments), "segments": segments}, f)
        try:
            os.link(held, _manifest(root, last + 1))
        except FileExistsError:  # another publisher's
            last = committed(root, last)
            continue
        os.remove(held)
        return last + 1


# --- source


@dataclass
class Segment(InputPartition):
    file: str
    first: int


def segments(root: str, start: int, end: int, session: str | None) -> list[Segment]:
    """Segments of the manifests after `start` up to `end`, with the position of their first event."""
    out, own = [], None if session is None else bucket(session)
    for number in range(start + 1, end + 1):
        m = manifest(root, number)
        at = m["first"]
        for s in m["segments"]:
            if own is None or s["bucket"] == own:
                out.append(Segment(s["file"], at))
            at += s["n"]
    return out


def read(root: str, segment: Segment, session: str | None) -> Iterator[pa.RecordBatch]:
    at = segment.first
    with pq.ParquetFile(f"{root}/data/{segment.file}") as f:
        for b in f.iter_batches():
            b = b.append_column("position", pa.array(range(at, at + b.num_rows), pa.int64()))
            at += b.num_rows
            yield b if session is None else b.filter(pc.fill_null(pc.equal(b.column("session_id"), session), False))


class Replay(DataSourceReader):
    """All events of a range of manifests: options `after` (0) and `upto` (the last)."""

    def __init__(self, options: dict):
        self.root, self.session = options["path"], options.get("session")
        self.start, self.end = int(options.get("after", 0)), options.get("upto")

    def partitions(self) -> list[InputPartition]:
        return segments(self.root, self.start, committed(self.root) if self.end is None else int(self.end), self.session) or [Segment("", 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return read(self.root, partition, self.session) if partition.file else iter(())


class Subscription(DataSourceStreamReader):
    """Events as they are committed, those after manifest `after` (0: from the beginning)."""

    def __init__(self, options: dict):
        self.root, self.session, self.start, self.last = options["path"], options.get("session"), int(options.get("after", 0)), 0

    def initialOffset(self) -> dict:
        return {"commit": self.start}

    def latestOffset(self) -> dict:
        self.last = committed(self.root, self.last)
        return {"commit": max(self.last, self.start)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return segments(self.root, start["commit"], end["commit"], self.session)

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        return read(self.root, partition, self.session)


# --- sink


@dataclass
class Written(WriterCommitMessage):
    segments: list


class Publisher(DataSourceStreamArrowWriter):
    """Two phases: tasks write segments, the commit of a batch names them."""

    def __init__(self, options: dict):
        self.root, self.writer = options["path"], options["writer"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(f"{self.root}/data", exist_ok=True)
        out, open_ = {}, {}
        try:
            for b in iterator:
                own = pa.array([bucket(s) for s in b.column("session_id").to_pylist()], pa.int32())
                for k in sorted(set(own.to_pylist())):
                    rows = b.filter(pc.equal(own, k)).select(SCHEMA.names)
                    if k not in open_:
                        out[k] = {"file": f"{k:02d}-{uuid.uuid4().hex}.parquet", "bucket": k, "n": 0}
                        open_[k] = pq.ParquetWriter(f"{self.root}/data/{out[k]['file']}", SCHEMA)
                    open_[k].write_batch(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in rows.columns], schema=SCHEMA))
                    out[k]["n"] += rows.num_rows
        finally:
            for w in open_.values():
                w.close()
        return Written([out[k] for k in sorted(out)])

    def _all(self, messages: list) -> list[dict]:
        return [s for m in messages if m is not None for s in m.segments]

    def commit(self, messages: list, batchId: int) -> None:
        if commit(self.root, self.writer, batchId, self._all(messages)) is None:
            self.abort(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        for s in self._all(messages):
            if os.path.exists(f"{self.root}/data/{s['file']}"):
                os.remove(f"{self.root}/data/{s['file']}")


class Topics(DataSource):
    """Options: path; session (a subscriber's, all if not given); after, upto (numbers of manifests); writer (a publisher's name, the same at each start)."""

    @classmethod
    def name(cls) -> str:
        return "topics"

    def schema(self) -> str:
        return f"{EVENTS}, position long"

    def reader(self, schema) -> DataSourceReader:
        return Replay(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Subscription(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return Publisher(self.options)
