"""A repository's history as a Spark source, read in parallel or as a stream.

    spark.dataSource.register(GitHistory)
    spark.read.format("git_history").load("/shared/repository")
    spark.readStream.format("git_history").load("/shared/repository")

Options: `chunk`, commits of a partition (500); `most`, the newest commits that a batch read takes (all); `revision`, what is followed (HEAD).
The driver asks for the newest commit and for the number of commits; each partition is a range of the history of that commit, which its own task reads, so commits that arrive meanwhile move nothing, and a range that is read again is the same. A stream's offset is a commit: a micro-batch has
the commits that its end reaches and its start does not, and so it gives each commit once. The folder has to be readable on all nodes.

Cases: a folder that is no repository, or has no commit, gives no row; merges have no files; a commit that is reached on several ways is one row; after a rewritten history the stream
has the commits that are new, and it fails if the commit that it last read up to is gone. Texts that are no UTF-8 have replacement characters. `most` and `chunk` under 1 are errors.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "sha string, author string, date string, message string, files array<string>, stat string"
_FORM = "--format=%x1e%h%x1f%an%x1f%ad%x1f%s%x1f"


def git(path: str, *args: str) -> str | None:
    """What git prints; null where it fails."""
    out = subprocess.run(["git", "-c", "core.quotePath=off", "-C", path, *args], capture_output=True, check=False)
    return out.stdout.decode("utf-8", "replace") if out.returncode == 0 else None


@dataclass
class Range(InputPartition):
    """`count` commits of a history after the first `skip`; without those that `after` reaches."""

    tip: str
    after: str
    skip: int
    count: int


class _History:
    """What both readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.revision = options["path"], options.get("revision", "HEAD")
        self.chunk = int(options.get("chunk", 500))
        self.most = int(options["most"]) if "most" in options else None
        if any(n is not None and n < 1 for n in (self.chunk, self.most)):
            raise ValueError("chunk and most are numbers of commits, from 1")

    def tip(self) -> str:
        return (git(self.path, "rev-parse", "--verify", "-q", f"{self.revision}^{{commit}}") or "").strip()

    @staticmethod
    def span(tip: str, after: str) -> list[str]:
        return [tip, *([f"^{after}"] if after else [])]

    def ranges(self, tip: str, after: str = "", most: int | None = None) -> list[Range]:
        counted = git(self.path, "rev-list", "--count", *self.span(tip, after)) if tip else "0"
        if counted is None:
            raise RuntimeError(f"{self.path}: no history from {after or 'the start'} to {tip}")
        n = int(counted) if most is None else min(int(counted), most)
        return [Range(tip, after, i, min(self.chunk, n - i)) for i in range(0, n, self.chunk)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None or not partition.count:
            return
        args = ["log", f"--skip={partition.skip}", f"-{partition.count}", "--date=short", _FORM, "--numstat", *self.span(partition.tip, partition.after), "--"]
        out = git(self.path, *args)
        if out is None:
            raise RuntimeError(f"{self.path}: the history of {partition.tip} can't be read here")
        for part in out.split("\x1e")[1:]:
            sha, author, date, message, tail = part.split("\x1f", 4)
            changes = [x.split("\t", 2) for x in tail.strip("\n").splitlines() if x.count("\t") >= 2]
            added, removed = (sum(int(c[i]) for c in changes if c[i].isdigit()) for i in (0, 1))
            yield sha, author, date, message, [c[2] for c in changes], f"{len(changes)} files, +{added} -{removed}" if changes else ""


class BatchReader(_History, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(self.tip(), most=self.most) or [Range("", "", 0, 0)]


class StreamReader(_History, DataSourceStreamReader):
    """Offsets are {"sha": commit}; the start of a stream is before all commits."""

    last = ""

    def initialOffset(self) -> dict:
        return {"sha": ""}

    def latestOffset(self) -> dict:
        tip = self.tip()
        self.last = tip or self.last
        return {"sha": self.last}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.last = end["sha"]
        return (self.ranges(end["sha"], start["sha"]) if start != end else []) or [Range("", "", 0, 0)]

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are through."""


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))
