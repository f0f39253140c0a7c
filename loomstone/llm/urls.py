"""URL filters by a sort-merge range join.

A host's labels in reverse, each closed by a low byte, make a key of which a
rule's key is a prefix exactly if the rule fits the host or a parent of it, so a
rule covers an interval of keys.  Keys are cut into ranges of about equal size
by a bounded sample, which decides only where rows are handled; a rule goes to
each range that its interval meets, and a key so frequent that it spans ranges
is spread over them.  A range is sorted and swept once with a stack of the
nested rules that are active at the current key; paths are looked up by length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLOSE, BEYOND = "\x01", "\x02"
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, lower-cased A-Z; path: from there up to ? # or the end.  Null, or without ://: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


#: Signs of the keys that stand in a host are written as two others.
ESCAPES = (("\x03", "\x03\x05"), (CLOSE, "\x03\x06"), (BEYOND, "\x03\x07"))


def key_of(host: Column) -> Column:
    for sign, pair in ESCAPES:
        host = F.replace(host, F.lit(sign), F.lit(pair))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), CLOSE), F.lit(CLOSE))


def spread(bounds: list[str]):
    """For mapInArrow: adds the number of the range that handles a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = []
            for key, salt in zip(b.column("key").to_pylist(), b.column("salt").to_pylist()):
                lo, hi = bisect_left(bounds, key), bisect_right(bounds, key)
                part.append(lo + salt % (hi - lo + 1))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(c for c, n in zip(b.columns, b.schema.names) if n != "salt")], ["part", *(n for n in b.schema.names if n != "salt")])

    return run


def swept(default: str, id_kind: pa.DataType):
    """For mapInArrow over rows sorted by part, key and kind (rules first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, int, dict, list]] = []  # prefix, length of the host, verdicts by path, lengths of paths, longest first
        now = None
        for b in batches:
            out: list[tuple] = []
            for part, key, kind, id_, host, path, verdict in zip(*(c.to_pylist() for c in b.columns)):
                if part != now:
                    now, stack = part, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, len(host), {}, []))
                    paths, lengths = stack[-1][2:]
                    if paths.get(path) != "block":  # of rules that differ in the verdict alone, blocking wins
                        paths[path] = verdict
                    if len(path) not in lengths:
                        lengths.append(len(path))
                        lengths.sort(reverse=True)
                    continue
                best = None
                for _, n, paths, lengths in stack:
                    for m in lengths:
                        if m <= len(path) and (v := paths.get(path[:m])) is not None:
                            if best is None or (n + m, n) > best[0]:
                                best = ((n + m, n), path[:m], v)
                            break
                rule = host[len(host) - best[0][1] :] + best[1] if best else None
                out.append((id_, host, path, rule, best[2] if best else default))
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_kind, *[pa.string()] * 4])], ["id", "host", "path", "rule", "verdict"])

    return run


def judged(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow", parts: int | None = None, rows_per_part: int = 100_000, seed: int = 3) -> DataFrame:
    """A row per row of pages: id, host, path, rule (host and path of the longest that fits, the longer host in a tie; else null), verdict (the rule's, else `default`).

    rules: columns verdict (allow or block), host, path; hosts are lower-cased A-Z,
    repeated ones count once, rows with a null are left out.  A rule fits its host
    and all subdomains if the path starts with the rule's.  Equal urls are judged
    alike.  The driver gets at most some 80,000 sampled keys, for the ranges.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{id}`").alias("id"), host.alias("host"), path.alias("path"))
    kind = rows.schema["id"].dataType
    n = pages.count()
    parts = parts or min(4096, max(64, n // rows_per_part))
    keyed = rows.select(key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    sample = sorted(r.key for r in keyed.sample(min(1.0, 20 * parts / max(1, n)), seed).select("key").collect())
    bounds = [sample[k * len(sample) // parts] for k in range(1, parts)] if sample else []
    fields = T.StructType([T.StructField("part", T.IntegerType()), *(f for f in keyed.schema.fields)])
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64(F.col("id").cast("string"), "path"), F.lit(1 << 20))).mapInArrow(spread(bounds), fields)

    clean = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna().distinct()
    clean = clean.withColumn("key", key_of(F.col("host")))

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            spans = [[*range(bisect_left(bounds, k), bisect_right(bounds, k[:-1] + BEYOND) + 1)] for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, pa.list_(pa.int32()))], [*b.schema.names, "parts"])

    placed = clean.mapInArrow(meets, "verdict string, host string, path string, key string, parts array<int>")
    placed = placed.select(F.explode("parts").alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("id"), "host", "path", "verdict")
    both = dealt.unionByName(placed).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind")
    out = both.mapInArrow(swept(default, to_arrow_type(kind)), T.StructType([T.StructField("id", kind), *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))]))
    return out.withColumnRenamed("id", id)


def rules_table(spark, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "verdict string, host string, path string")
