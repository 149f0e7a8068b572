"""Source files of a tree, hidden ones included, as (path, source, valid)."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import saved
from . import tree

SCHEMA = "path string, source string, valid boolean"
PART_BYTES = 64 << 20  #: of files that one task reads
BATCH_BYTES = 8 << 20  #: of files that a task holds


def names(spark: SparkSession, root: str, scope: list[str], exclude: list[str] = ()) -> DataFrame:
    """(path, size) of the files in scope and not excluded, whole components compared; executors list them."""
    tree.register(spark)
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return spark.read.format(tree.NAME).option("scope", json.dumps(list(scope))).option("exclude", json.dumps(list(exclude))).load(full)


def contents(found: DataFrame, root: str) -> DataFrame:
    """SCHEMA of files (path, size) under ``root``, dealt out by their paths; a file that isn't UTF-8 is not valid and has no source."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = tree.opened(root)
        sources, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                full = posixpath.join(base, path)
                with open(full, "rb") if system is None else system.open_input_stream(full) as file:
                    content = file.read()
                try:
                    text = content.decode("utf-8")
                except UnicodeDecodeError:
                    text = None
                sources.append((path, text))
                held += len(content)
                if held > BATCH_BYTES:
                    yield read(sources)
                    sources, held = [], 0
        if sources:
            yield read(sources)

    sizes = found.agg(F.count("*").alias("n"), F.sum("size").alias("size")).first()
    parts = max(1, min(sizes.n, found.sparkSession.sparkContext.defaultParallelism), -(-(sizes.size or 0) // PART_BYTES))
    return found.select("path").repartition(parts, "path").mapInArrow(run, SCHEMA)


def read(sources: list[tuple[str, str | None]]) -> pa.RecordBatch:
    columns = [[p for p, _ in sources], [s for _, s in sources], [s is not None for _, s in sources]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], ["path", "source", "valid"])


def scan(spark: SparkSession, root: str, scope: list[str], exclude: list[str] = ()) -> DataFrame:
    """Files in scope and not excluded.  Which there are is found out once and kept in the shared folder; contents are read when asked for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return contents(saved(names(spark, full, scope, exclude)), full)
