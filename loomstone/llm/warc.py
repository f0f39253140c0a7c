"""A deterministic, sharded WARC writer, and its reader.

Records are sorted by id and payload digest, and cut into shards of about equal
bytes: exact running sums of bytes in that order, taken on ids and digests alone,
give the key with which each shard begins, so a rerun makes the same shards however
rows are partitioned and however ids are spread.  A payload crosses the network
once; which records revisit which is found on digests and meets the payloads in
the sorted shard, whose order is total but for rows that repeat whole, so files
are the same byte for byte.  A shard rolls its file once its compressed size
reaches `roll`; files are written under temporary names and renamed when whole, and
the manifest, renamed last, names the files that count.  Every record is a gzip
member of its own with fresh headers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed, mounted, running, scratch
from .tokens import lean

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, payload: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{payload}')}>"


def record(kind: str, headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """A gzip member with one record; the same bytes at every run."""
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    data = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, level, mtime=0)


def page_record(page: int | None, url: str | None, payload: bytes, first: int | None, level: int) -> bytes:
    """A response, or, if `first` is another page, a revisit of it."""
    own = digest(payload)
    target = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    headers = [("WARC-Record-ID", record_id(page, own)), ("WARC-Date", DATE), ("WARC-Target-URI", target or "urn:none"), ("WARC-Payload-Digest", f"sha1:{own}"), ("X-Page-Id", "" if page is None else str(page)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first == page:
        return record("response", headers, http + payload, level)
    return record("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, own)), ("X-Refers-To-Page-Id", str(first))], http, level)


class Files:
    """The files of a shard, rolled by compressed size."""

    def __init__(self, path: str, shard: int, roll: int, level: int):
        self.path, self.shard, self.roll, self.level = path, shard, roll, level
        self.done: list[tuple] = []
        self.out = None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.held = f"{self.path}/.{self.name}.{os.getpid()}-{os.urandom(6).hex()}"
            self.out, self.sum, self.size, self.n = open(self.held, "wb"), hashlib.sha1(), 0, 0
            self.put(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level))
        self.put(member)
        self.n += 1
        if self.size >= self.roll:
            self.close()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            os.replace(self.held, f"{self.path}/{self.name}")
            self.done.append((self.name, self.n, self.size, self.sum.hexdigest()))
            self.out = None


def writer(path: str, roll: int, level: int):
    """For mapInArrow over rows sorted by shard, id, kind (decisions before payloads), digest and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, now, page, firsts = None, None, None, {}
        rows = ((b, i) for b in batches for i in range(b.num_rows))
        for b, i in rows:
            shard, id_, kind, first, own, url, payload = (c[i].as_py() for c in b.columns)
            if shard != now:
                if files:
                    files.close()
                    yield manifest_rows(files.done)
                files, now, page, firsts = Files(path, shard, roll, level), shard, None, {}
            if id_ != page:
                page, firsts = id_, {}
            if kind == 0:
                firsts[own] = first
            else:
                files.add(page_record(id_, url, payload, firsts.get(hashlib.sha1(payload).hexdigest(), id_), level))
        if files:
            files.close()
            yield manifest_rows(files.done)

    return run


def manifest_rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 4, kinds)], ["file", "records", "bytes", "sha1"])


def starts(keys: DataFrame, shard_bytes: int, most_shards: int) -> list[tuple]:
    """The keys (id is known, id, digest) with which shards begin, of rows (id, own, bytes): at most most_shards + 1."""
    order = [F.col("id").asc_nulls_first(), F.col("own")]
    each = checkpointed(keys.groupBy("id", "own").agg(F.sum("bytes").alias("bytes")))
    total = each.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    size = max(shard_bytes, -(-total // most_shards))
    shard = F.floor((F.col("upto") - F.col("bytes")) / F.lit(size))
    first = running(each, order, {"upto": F.col("bytes")}).groupBy(shard.alias("shard")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "own")).alias("k"))
    return sorted((r.k.known, r.k.id or 0, r.k.own) for r in first.collect())


def dealt(bounds: list[tuple]):
    """For mapInArrow: adds the shard of rows (id, own, ...) in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [bisect_right(bounds, (i is not None, i or 0, own)) - 1 for i, own in zip(b.column("id").to_pylist(), b.column("own").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *b.columns], ["shard", *b.schema.names])

    return run


def write(pages: DataFrame, path: str | None = None, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, shard_bytes: int = 16 << 20, roll: int = 8 << 20, level: int = 6, most_shards: int = 1 << 16) -> tuple[str, DataFrame]:
    """Writes a record per row; returns the folder and the manifest (file, records, bytes, sha1).

    Of rows with equal payloads of at least `least` bytes those with the largest id
    are responses, the others revisit it.  Null payloads are empty, null ids are
    smaller than any other and have an empty page id; a repeated row is a record
    of its own.  Beyond most_shards * shard_bytes shards are larger, as many.  The
    folder must be mounted where executors run; without a path one is made in the
    shared folder.
    """
    spark = pages.sparkSession
    path = mounted(path or scratch(spark, "warc"))
    os.makedirs(path, exist_ok=True)
    rows = pages.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("id", F.sha1("payload").alias("own"), "url", "payload")
    slim = checkpointed(rows.select("id", "own", F.octet_length("payload").cast("long").alias("size")))
    bounds = starts(slim.select("id", "own", (F.col("size") + 512).alias("bytes")), shard_bytes, most_shards)

    # written apart, so that a digest which many rows have can be split in the join
    firsts = checkpointed(slim.filter(F.col("size") >= least).groupBy("own").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    decided = slim.join(firsts, "own").filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "own", "first").distinct()
    null = lambda t: F.lit(None).cast(t)
    kinds = "shard int, id long, own string, kind int, first long, url string, payload binary"
    both = rows.select("id", "own", F.lit(1).alias("kind"), null("long").alias("first"), "url", "payload").union(decided.select("id", "own", F.lit(0), "first", null("string"), null("binary")))
    both = both.mapInArrow(lean(dealt(bounds)), kinds).select("shard", "id", "kind", "first", "own", "url", "payload")
    order = ["shard", F.col("id").asc_nulls_first(), "kind", "own", F.col("url").asc_nulls_first()]
    both = both.repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions(*order)
    manifest = checkpointed(both.mapInArrow(lean(writer(path, roll, level)), "file string, records long, bytes long, sha1 string"))
    held = f"{path}/.manifest.{os.urandom(6).hex()}"
    with open(held, "w") as f:  # a line per file of about `roll` bytes
        for r in manifest.orderBy("file").toLocalIterator():
            f.write(json.dumps(r.asDict()) + "\n")
    os.replace(held, f"{path}/manifest.jsonl")
    return path, manifest


def records(file: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record; digests are checked."""
    with gzip.open(file, "rb") as f:
        while line := f.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{file}: not a record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(": ")
                headers[k] = v
            block = f.read(int(headers["Content-Length"]))
            if f.read(4) != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
                raise ValueError(f"{file}: damaged record {headers.get('WARC-Record-ID')}")
            yield headers, block


def read(path: str, manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per page record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload if asked for (null in revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column("file").to_pylist():
                out: list[tuple] = []
                for h, block in records(f"{path}/{name}"):
                    if h["WARC-Type"] == "warcinfo":
                        continue
                    body = block[block.index(b"\r\n\r\n") + 4 :] if h["WARC-Type"] == "response" else None
                    own = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if body is not None and digest(body) != own:
                        raise ValueError(f"{name}: payload of {h['WARC-Record-ID']} differs from its digest")
                    number = lambda k: int(h[k]) if h.get(k) else None  # noqa: B023, E731
                    out.append((number("X-Page-Id"), number("X-Payload-Length"), own, h["WARC-Type"], number("X-Refers-To-Page-Id"), h["WARC-Target-URI"], body if payloads else None))
                    if len(out) == 1000:
                        yield rows_of(out)
                        out = []
                yield rows_of(out)

    kinds = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())])
    names = manifest.select("file")
    return names.repartition(max(1, min(2000, names.count()))).mapInArrow(lean(run), kinds)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
