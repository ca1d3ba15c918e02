"""Commits as a source: files of a revision, read through git itself (SRC-14, VER-9)."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.sources.files import SOURCE_ENDINGS, WINDOW_ENDINGS


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def resolve(repo: str, revision: str = "HEAD") -> str:
    """The commit a revision names."""
    return git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()


class Blobs(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        super().__init__(len(paths))
        self.paths = paths


class CommitReader(DataSourceReader):
    """Lists the tree once and reads the blobs of wanted files, a partition for each ``batch`` of them."""

    def __init__(self, options: dict):
        self.repo, self.revision = options["path"], options.get("revision", "HEAD")
        self.batch = int(options.get("batch", "200"))
        wide = options.get("allLanguages", "false").lower() == "true"
        self.endings = tuple("." + e for e in SOURCE_ENDINGS + (WINDOW_ENDINGS if wide else []))

    def partitions(self) -> list[Blobs]:
        listing = git(self.repo, "ls-tree", "-r", "-z", self.revision).decode("utf-8", "replace")
        wanted = []
        for entry in filter(None, listing.split("\0")):
            meta, path = entry.split("\t", 1)
            mode, kind, name = meta.split()
            if kind == "blob" and mode != "120000" and path.endswith(self.endings):
                wanted.append((path, name))
        return [Blobs(wanted[a : a + self.batch]) for a in range(0, len(wanted), self.batch)] or [Blobs([])]

    def read(self, partition: Blobs) -> Iterator[tuple[str, str]]:
        for path, name in partition.paths:
            yield path, git(self.repo, "cat-file", "blob", name).decode("utf-8", "replace")


class CommitSource(DataSource):
    """spark.read.format("commit").option("revision", ...).load(repository): (path, content)."""

    @classmethod
    def name(cls) -> str:
        return "commit"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> CommitReader:
        return CommitReader(self.options)


def read_commit(spark: SparkSession, repo: str, revision: str = "HEAD", all_languages: bool = False):
    spark.dataSource.register(CommitSource)
    return spark.read.format("commit").option("revision", resolve(repo, revision)).option("allLanguages", str(all_languages)).load(repo)


def sync(spark: SparkSession, repo: str, folder: str, revision: str = "HEAD", label: str | None = None) -> dict:
    """Index a commit under its label; a label whose build came to its end is skipped."""
    from quern.sources import files, store

    commit = resolve(repo, revision)
    label = label or commit[:12]
    if store.is_committed(spark, folder, label):
        return {"version": label, "skipped": True}
    good, _ = files.scan(read_commit(spark, repo, commit))
    return store.build(spark, good.select("id", "text"), folder, label, kind="repo") | {"skipped": False}
