"""The change feed: ``git diff --name-status`` lines as (status, path, old_path).

``spark.read.format("name_status")`` with options ``base``, ``target`` and ``scope`` (a JSON list) gives the lines of one diff,
as an executor's git prints them.  ``spark.readStream`` of it follows a name (option ``ref``, HEAD by default) from ``base`` on: each
batch has the lines between the revision that the last one ended at and the one the name then stands for, so a stream
that is started again goes on from its checkpoint.  The work tree is one that executors see, as for ``sources.files``.
"""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..errors import CodedError
from ..operators.graph import saved

SCHEMA = "status string, path string, old_path string"
NAME = "name_status"
LINES = "value string, base string, target string"
FAILED = "GIT_DIFF_FAILED"


def parsed(lines: DataFrame, value: str = "value", *keep: str) -> DataFrame:
    """One row for each line of two fields or more; renames and copies of three give new path and old path."""
    part = F.split(value, "\t")
    status = F.substring(value, 1, 1)
    moved = status.isin("R", "C") & (F.size(part) >= 3)
    return lines.where(F.size(part) >= 2).select(*keep, status.alias("status"), F.when(moved, F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1))).alias("path"), F.when(moved, F.get(part, F.lit(1))).alias("old_path"))


@dataclass
class Between(InputPartition):
    base: str
    target: str


def git(root: str, *command: str) -> Iterator[str]:
    """The lines that git prints, as it prints them; an error once it has failed."""
    with tempfile.TemporaryFile() as errors:
        with subprocess.Popen(["git", "-C", root, *command], stdout=subprocess.PIPE, stderr=errors, encoding="utf-8", errors="replace") as run:
            for line in run.stdout:
                yield line.removesuffix("\n")
        if run.returncode:
            errors.seek(0)
            raise RuntimeError(f"{FAILED}: {errors.read().decode('utf-8', 'replace').strip()}")


class Diffs:
    """What the batch and the stream reader have in common."""

    def __init__(self, options: dict):
        self.root, self.scope = options["path"].removeprefix("file:"), json.loads(options.get("scope", "[]"))
        self.base, self.target, self.ref = options["base"], options.get("target"), options.get("ref", "HEAD")

    def read(self, unit: Between) -> Iterator[tuple[str, str, str]]:
        for line in git(self.root, "diff", "--name-status", unit.base, unit.target, "--", *self.scope):
            yield line, unit.base, unit.target


class DiffReader(Diffs, DataSourceReader):
    def partitions(self) -> list[Between]:
        return [Between(self.base, self.target)]  # git prints one diff as one stream of lines


class DiffStream(Diffs, DataSourceStreamReader):
    def revision(self, name: str) -> dict:
        return {"revision": next(git(self.root, "rev-parse", "--verify", f"{name}^{{commit}}"))}

    def initialOffset(self) -> dict:  # noqa: N802  the interface's names
        return self.revision(self.base)

    def latestOffset(self) -> dict:  # noqa: N802
        return self.revision(self.ref)

    def partitions(self, start: dict, end: dict) -> list[Between]:
        return [Between(start["revision"], end["revision"])]


class NameStatus(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DiffReader:
        return DiffReader(dict(self.options))

    def streamReader(self, schema) -> DiffStream:  # noqa: N802
        return DiffStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NameStatus)


def git_changes(spark: SparkSession, root: str, base: str, target: str, scope: list[str]) -> DataFrame:
    """Changes between two revisions of a work tree, kept in the shared folder; a failing git is GIT_DIFF_FAILED."""
    register(spark)
    lines = spark.read.format(NAME).option("base", base).option("target", target).option("scope", json.dumps(list(scope))).load(root)
    try:
        return saved(parsed(lines))
    except PySparkException as e:
        told = str(e)
        if FAILED not in told:
            raise
        raise CodedError(FAILED, message=told.split(f"{FAILED}: ", 1)[1].split("\n\n")[0].strip()) from e
