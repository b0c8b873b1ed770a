"""Commits of a git repository as a table, through the Python data source interface."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "commit_sha string, parent_sha string, author_name string, author_email string, author_time long, committer_time long, subject string"
_FORMAT = "%H%x1f%P%x1f%an%x1f%ae%x1f%at%x1f%ct%x1f%s%x1e"


class CommitRange(InputPartition):
    def __init__(self, ids: str) -> None:
        self.ids = ids


class CommitReader(DataSourceReader):
    """Ranges of the log are read by separate tasks. Every executor needs the repository under the same path."""

    def __init__(self, options: dict) -> None:
        self.repo = options["path"]
        self.revision = options.get("revision", "HEAD")
        self.step = int(options.get("commitspertask", 10_000))

    def _git(self, *args: str, given: str | None = None) -> str:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.repo, *args], input=given, capture_output=True, text=True, check=True, errors="replace").stdout

    def partitions(self) -> list[InputPartition]:
        ids = self._git("rev-list", self.revision).split()
        return [CommitRange("\n".join(ids[k : k + self.step])) for k in range(0, len(ids), self.step)]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        # the task reads its own commits by id, without a walk from the tip
        log = self._git("log", "--no-walk=unsorted", "--stdin", f"--format={_FORMAT}", given=partition.ids)
        for entry in log.split("\x1e"):
            if entry.strip():
                sha, parents, name, email, at, ct, subject = entry.strip("\n").split("\x1f")
                yield sha, parents.split(" ")[0] or None, name, email, int(at), int(ct), subject


class CommitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CommitReader(self.options)


def read_commits(spark: SparkSession, repo: str, revision: str = "HEAD") -> DataFrame:
    """Commits reachable from a revision or in a range (a..b, a...b)."""
    spark.dataSource.register(CommitSource)
    return spark.read.format("git_commits").option("revision", revision).load(repo)
