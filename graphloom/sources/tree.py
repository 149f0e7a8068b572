"""Files of a tree as a data source: ``spark.read.format("source_tree").load(root)`` gives (path, size) of all files, hidden ones too.

Executors list the directories.  The planner looks only at the names of the upper directories, until there are ``UNITS`` of
them, and each partition lists one of them and all below it; a directory with more subdirectories than that is listed by
``SHARES`` partitions, each of which goes down into its share of them.  So no list of file names is on the driver.

Options ``scope`` and ``exclude`` are JSON lists of prefixes, compared by whole components, as in ``functions.text.under``;
directories that can hold no wanted file are not listed.  They are options and no pushed filters, as Spark 4.1 keeps what one
query has pushed to a Python source for the next query of the same DataFrame, which then lacks rows.  Links to directories are
not followed.  A root that is no directory has no files.  A name that is not UTF-8 is an error.
"""

from __future__ import annotations

import json
import os
import posixpath
import stat
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "source_tree"
SCHEMA = "path string, size long"
UNITS = 256
SHARES = 16
ROWS = 4096


def is_local(root: str) -> bool:
    return root.startswith("file:") or "://" not in root


def opened(root: str) -> tuple[fs.FileSystem | None, str]:
    """(file system, the root's path in it); None for what the machine mounts."""
    if is_local(root):
        path = root.removeprefix("file:")
        return None, "/" + path.lstrip("/") if path.startswith("/") else os.path.abspath(path)
    system, path = fs.FileSystem.from_uri(root)
    return system, path


def entries(system: fs.FileSystem | None, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a directory, size) of what is in a folder; links to directories and special files are left out."""
    if system is None:
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield x.name, True, 0
                elif x.is_file():
                    yield x.name, False, x.stat().st_size
        return
    for x in system.get_file_info(fs.FileSelector(folder)):
        if x.type in (fs.FileType.Directory, fs.FileType.File):
            yield x.base_name, x.type == fs.FileType.Directory, x.size or 0


def is_folder(system: fs.FileSystem | None, path: str) -> bool:
    if system is None:
        return os.path.isdir(path) and stat.S_ISDIR(os.stat(path).st_mode)
    return system.get_file_info(path).type == fs.FileType.Directory


def prefixes(given: Iterable[str]) -> list[str]:
    """Prefixes as the paths they stand for; the empty one is everything."""
    return ["" if (p := posixpath.normpath(x).strip("/")) == "." else p for x in given]


def under(path: str, given: list[str]) -> bool:
    return any(not p or path == p or path.startswith(f"{p}/") for p in given)


@dataclass
class Unit(InputPartition):
    """A folder to list, with what is below it if ``deep``; of its subfolders only a share."""

    folder: str
    deep: bool
    share: int = 0
    shares: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, root: str, scope: list[str], exclude: list[str]):
        self.root, self.scope, self.exclude = root, prefixes(scope), prefixes(exclude)

    def worth(self, folder: str) -> bool:
        """Whether a folder can hold a wanted file."""
        inside = f"{folder}/"
        return (under(folder, self.scope) or any(p.startswith(inside) for p in self.scope)) and not under(folder, self.exclude)

    def subfolders(self, system, base: str, folder: str) -> Iterator[str]:
        at = posixpath.join(base, folder) if folder else base
        for name, is_dir, _ in entries(system, at):
            path = f"{folder}/{name}" if folder else name
            if is_dir and self.worth(path):
                yield path

    def partitions(self) -> list[Unit]:
        system, base = opened(self.root)
        if not is_folder(system, base):
            return []
        units, folders = [], [""]
        while folders and len(units) + len(folders) < UNITS:
            folder, below = folders.pop(0), []
            for path in self.subfolders(system, base, folder):
                below.append(path)
                if len(below) > UNITS:
                    break
            if len(below) > UNITS:
                units += [Unit(folder, True, i, SHARES) for i in range(SHARES)]
            else:
                units.append(Unit(folder, False))
                folders += below
        return units + [Unit(folder, True) for folder in folders]

    def read(self, unit: Unit | None) -> Iterator[pa.RecordBatch]:
        if unit is None:  # there is no such directory
            return
        system, base = opened(self.root)
        paths, sizes, folders = [], [], [unit.folder]
        while folders:
            folder = folders.pop()
            first = folder == unit.folder
            for name, is_dir, size in entries(system, posixpath.join(base, folder) if folder else base):
                path = f"{folder}/{name}" if folder else name
                if is_dir:
                    mine = not first or zlib.crc32(os.fsencode(name)) % unit.shares == unit.share
                    if unit.deep and mine and self.worth(path):
                        folders.append(path)
                elif (not first or unit.share == 0) and under(path, self.scope) and not under(path, self.exclude):
                    paths.append(path)
                    sizes.append(size)
                    if len(paths) == ROWS:
                        yield named(paths, sizes)
                        paths, sizes = [], []
        if paths:
            yield named(paths, sizes)


def named(paths: list[str], sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        asked = {k: json.loads(self.options.get(k, usual)) for k, usual in (("scope", '["."]'), ("exclude", "[]"))}
        return TreeReader(self.options["path"], **asked)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
