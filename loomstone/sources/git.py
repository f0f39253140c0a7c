"""Git history as Spark sources: `gitlog` (a row per commit) and `gitblame` (a row per line).

Readers call the git program where the repository is mounted; a log is read in
parallel by ranges of commits.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMMIT = "hash string, message string, author string, timestamp timestamp, files array<string>, diff_summary string, insertions long, deletions long"
BLAME = "path string, line_no int, hash string, author string, timestamp timestamp, content string"
STEP = 1000


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, check=True).stdout.decode(errors="replace")


def commits(repo: str, skip: int, most: int, path: str | None = None) -> Iterator[tuple]:
    """Newest first.  Changes are those against the first parent; a renamed file has its new path."""
    out = git(repo, "log", f"--skip={skip}", f"--max-count={most}", "--diff-merges=first-parent", "--numstat", "-M", "-z", "--format=%x1e%H%x1f%an%x1f%ae%x1f%at%x1f%B%x1f", *(["--", path] if path else []))
    for part in out.split("\x1e")[1:]:
        hash_, name, mail, stamp, message, rest = part.split("\x1f", 5)
        files, lines, added, removed = [], [], 0, 0
        fields = iter(rest.strip("\n").split("\0"))
        for field in fields:
            m = re.match(r"\s*(\d+|-)\t(\d+|-)\t(.*)", field, re.S)
            if not m:
                continue
            a, r, file = m.groups()
            if not file:  # a rename: the old path, then the new one
                next(fields)
                file = next(fields)
            files.append(file)
            lines.append(f"{file}: +{a}/-{r}")
            added, removed = added + int(a.replace("-", "0")), removed + int(r.replace("-", "0"))
        yield hash_[:8], message.strip(), f"{name} <{mail}>", datetime.fromtimestamp(int(stamp), timezone.utc), files, "\n".join(lines), added, removed


def blame(repo: str, path: str) -> Iterator[tuple]:
    at: dict[str, str] = {}
    number = 0
    for line in git(repo, "blame", "--line-porcelain", "--", path).split("\n"):
        if line.startswith("\t"):
            yield path, number, at["hash"][:8], f"{at['author']} {at['author-mail']}", datetime.fromtimestamp(int(at["author-time"]), timezone.utc), line[1:]
        elif m := re.match(r"([0-9a-f]{40}) \d+ (\d+)", line):
            at["hash"], number = m[1], int(m[2])
        else:
            k, _, v = line.partition(" ")
            at[k] = v


class Range(InputPartition):
    def __init__(self, skip: int, most: int):
        self.skip, self.most = skip, most


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.path, self.limit = options["path"], options.get("file"), int(options.get("limit", 1 << 62))

    def partitions(self):
        n = min(self.limit, int(git(self.repo, "rev-list", "--count", "HEAD", *(["--", self.path] if self.path else []))))
        return [Range(k, min(STEP, n - k)) for k in range(0, n, STEP)] or [Range(0, 0)]

    def read(self, partition):
        yield from commits(self.repo, partition.skip, partition.most, self.path)


class BlameReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.path = options["path"], options["file"]

    def read(self, partition):
        yield from blame(self.repo, self.path)


class GitLog(DataSource):
    """Options: path (the repository), file (its history alone), limit."""

    @classmethod
    def name(cls):
        return "gitlog"

    def schema(self):
        return COMMIT

    def reader(self, schema):
        return LogReader(self.options)


class GitBlame(DataSource):
    """Options: path (the repository), file."""

    @classmethod
    def name(cls):
        return "gitblame"

    def schema(self):
        return BLAME

    def reader(self, schema):
        return BlameReader(self.options)


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitBlame):
        spark.dataSource.register(source)


def recent(spark: SparkSession, repo: str, limit: int = 100, file: str | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("gitlog").option("path", repo).option("limit", limit)
    return (reader.option("file", file) if file else reader).load().orderBy(F.desc("timestamp"), "hash").limit(limit)


def by_author(commits: DataFrame, author: str, limit: int = 100) -> DataFrame:
    return commits.filter(F.contains(F.lower("author"), F.lit(author.lower()))).orderBy(F.desc("timestamp"), "hash").limit(limit)


def by_pattern(commits: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """Message or any file meets the pattern, case ignored."""
    rx = F.lit(f"(?i){pattern}")
    return commits.filter(F.rlike("message", rx) | F.exists("files", lambda f: F.rlike(f, rx))).orderBy(F.desc("timestamp"), "hash").limit(limit)


def section(content: str, function: str | None = None, cls: str | None = None) -> str | None:
    """The lines of a function or class by indentation; None if it isn't there."""
    lines = content.split("\n")
    start = None
    for k, line in enumerate(lines):
        if (function and re.match(rf"\s*(?:async\s+)?def\s+{re.escape(function)}\b", line)) or (cls and re.match(rf"\s*class\s+{re.escape(cls)}\b", line)):
            start = k
            break
    if start is None:
        return None
    indent = len(lines[start]) - len(lines[start].lstrip())
    end = next((k for k in range(start + 1, len(lines)) if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent), len(lines))
    return "\n".join(lines[start:end]).rstrip()


def evolution(spark: SparkSession, repo: str, file: str, function: str | None = None, cls: str | None = None, most: int = 20) -> DataFrame:
    """(hash, timestamp, message, content): a section of a file at its last `most` commits, cut to 2,000 characters."""
    log = recent(spark, repo, most, file)

    def at(hash_: str) -> str | None:
        try:
            text = git(repo, "show", f"{hash_}:{file}")
        except subprocess.CalledProcessError:
            return None
        found = section(text, function, cls) if function or cls else text
        return found and found[:2000]

    content = F.udf(at, "string")  # a git call for each of at most `most` rows
    return log.select("hash", "timestamp", "message", content("hash").alias("content")).filter("content is not null")
