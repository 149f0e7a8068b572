"""Extraction as a distributed dataflow: files (path, source) to nodes, edges and diagnostics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import text
from ..functions.parsers import Registry
from . import rows

NODE = "canonical_key string, kind string, name string, start_line int, end_line int, payload string"
EDGE = "edge_type string, source_key string, target_key string, start_line int, payload string"
DIAGNOSTIC = "code string, message string, detail string"
SCHEMA = f"path string, parser_id string, parser_version string, language string, nodes array<struct<{NODE.replace(' string', ':string').replace(' int', ':int')}>>, edges array<struct<{EDGE.replace(' string', ':string').replace(' int', ':int')}>>, diagnostics array<struct<{DIAGNOSTIC.replace(' string', ':string')}>>"

#: what a snapshot keeps of its files, for the next to take over
KEPT = f"{SCHEMA}, source_hash string"
#: payload fields of edges that binding reads
FIELDS = ("symbol", "resolution", "language", "module", "import", "import_source", "imported_symbol", "alias")


def recorded(registry: Registry, path: str, source: str | None) -> tuple:
    """A file's row of SCHEMA; a null source counts as empty."""
    parser, found = registry.detect(path), registry.parse(path, source or "")
    for x in (*found.nodes, *found.edges):
        x["payload"] = text.canonical_json(x["payload"])
    for x in found.diagnostics:
        x["detail"] = text.canonical_json(x["detail"])
    language = None if parser is None else getattr(parser, "language_of", lambda _: parser.language)(path)
    return path, parser and parser.parser_id, parser and parser.version, language, found.nodes, found.edges, found.diagnostics


def parsed(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One row for each file: SCHEMA. A null source counts as empty."""
    registry = registry or Registry.default()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [recorded(registry, path, source) for path, source in zip(batch["path"], batch["source"], strict=True)]
            yield pd.DataFrame(out, columns=["path", "parser_id", "parser_version", "language", "nodes", "edges", "diagnostics"])

    return files.select("path", "source").mapInPandas(run, SCHEMA)


def reused(files: DataFrame, known: DataFrame, registry: Registry | None = None) -> DataFrame:
    """``parsed`` of files (path, source), with source_hash, of which those that ``known`` (of the same columns) has are taken from there.

    A file is known by its path, the hash of its source, and the parser and version that would read it, so a new version
    reads all of its files again.  Only the others' sources go to a parser.
    """
    registry = registry or Registry.default()
    files = files.select("path", "source", F.sha2(F.coalesce("source", F.lit("")), 256).alias("source_hash"))
    chosen = rows.longest_suffix(files.select("path"), registry.suffixes(files.sparkSession)).select("path", F.col("parser_id").alias("own_id"), F.col("parser_version").alias("own_version"))
    files = files.join(chosen, "path")
    same = (F.col("parser_id").eqNullSafe(F.col("own_id"))) & (F.col("parser_version").eqNullSafe(F.col("own_version")))
    held = known.join(files.select("path", "source_hash", "own_id", "own_version"), ["path", "source_hash"]).where(same).select(*known.columns)
    rest = files.join(held.select("path"), "path", "left_anti")
    hashes = rest.select("path", "source_hash")
    return held.unionByName(parsed(rest, registry).join(hashes, "path").select(*known.columns))


#: what the table function gives rows of, by the name asked for
RECORDS = {"nodes": NODE, "edges": EDGE, "diagnostics": DIAGNOSTIC}


def row_type(fields: str) -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split() for f in fields.split(", "))])


def register(spark: SparkSession, name: str = "parse_source", registry: Registry | None = None) -> None:
    """A table function for SQL: ``SELECT f.path, x.* FROM files f, LATERAL parse_source(f.path, f.source, 'nodes') x``.

    Its columns are those of the records asked for: nodes, edges or diagnostics.  ``registry`` may hold parsers of a user's own;
    they go to the workers with the function.
    """
    registry = registry or Registry.default()
    spark.udtf.register(name, table_function(registry))


def table_function(registry: Registry):
    class ParseSource:
        @staticmethod
        def analyze(path: AnalyzeArgument, source: AnalyzeArgument, records: AnalyzeArgument) -> AnalyzeResult:
            if records.value not in RECORDS:
                raise ValueError(f"parse_source gives {', '.join(RECORDS)}, not {records.value}")
            return AnalyzeResult(schema=T.StructType([T.StructField("parser_id", T.StringType()), T.StructField("language", T.StringType()), *row_type(RECORDS[records.value])]))

        def eval(self, path: str, source: str, records: str) -> Iterator[tuple]:
            _, parser_id, _, language, *found = recorded(registry, path, source)
            for x in found[list(RECORDS).index(records)]:
                yield parser_id, language, *(x[f.split()[0]] for f in RECORDS[records].split(", "))

    return udtf(ParseSource)


def nodes(found: DataFrame) -> DataFrame:
    """(path, position, NODE, language, module_identity, package_identity) of parsed files."""
    out = found.select("path", F.posexplode("nodes").alias("position", "x")).select("path", "position", "x.*")
    return out.withColumns({c: F.get_json_object("payload", f"$.{c}") for c in ("language", "module_identity", "package_identity", "qualified_name")})


def edges(found: DataFrame) -> DataFrame:
    """(path, position, EDGE, FIELDS) of parsed files."""
    out = found.select("path", F.posexplode("edges").alias("position", "x")).select("path", "position", "x.*")
    return out.withColumns({c: F.get_json_object("payload", f"$.{c}") for c in FIELDS})


def diagnostics(found: DataFrame) -> DataFrame:
    return found.select("path", "language", F.explode("diagnostics").alias("x")).select("path", "language", "x.*")
