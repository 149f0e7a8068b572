"""Tables clustered by a key, with a list of the key's range in each file: a lookup reads the files whose range holds it.

``write`` deals rows by ranges of the key, sorts each file by it and puts a Bloom filter of the key into each row group, so of the one
file that a key can be in, the row groups without it are skipped.  The list has a row for each file and is written once the
files are; files that were added later are in no range, so a lookup reads them as well.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS = 250_000  #: in a file
ASKED = 1000  #: keys up to which a lookup names each of them to the scan


def write(rows: DataFrame, path: str, ranges: str, key: str, parts: int) -> None:
    """Writes rows, of which no key is null, under ``path`` in ``parts`` files, and their ranges under ``ranges``; rows of a key share a file."""
    clustered = rows.repartitionByRange(parts, key).sortWithinPartitions(key)
    clustered.write.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    each = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("rows"))
    each.coalesce(1).write.parquet(ranges)  # a row for each file


def ranges_of(kind: str) -> str:
    """The columns of a list of ranges, for keys of a type."""
    return f"file string, first {kind}, last {kind}, rows long"


class Clustered:
    """A table written by ``write``, as a schema reads it; ``names``: the files there are now."""

    def __init__(self, spark: SparkSession, path: str, ranges: DataFrame, key: str, schema: str, names: Iterable[str]):
        self.spark, self.path, self.ranges, self.key, self.schema = spark, path, ranges, key, schema
        self.names = {n for n in names if n.endswith(".parquet")}

    def listed(self) -> list:
        """The ranges, in order; a row for each file."""
        return sorted(self.ranges.collect(), key=lambda r: r.first)

    def files(self, keys: Iterable) -> list[str]:
        """The files in whose range one of the keys lies; files in no range are not among them.

        Strings compare here by code points, which is the order of their bytes that the ranges are in.
        """
        ranges = self.listed()
        firsts = [r.first for r in ranges]
        found = {ranges[i] for k in keys if (i := bisect_right(firsts, k) - 1) >= 0 and k <= ranges[i].last}
        return sorted(r.file for r in found)

    def loose(self) -> list[str]:
        """The files that were added one by one."""
        return sorted(self.names - {r.file for r in self.listed()})

    def read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in files))

    def rows(self, keys: Iterable) -> DataFrame:
        """The rows of some keys, which a caller names; many are sent to the rows by a join."""
        keys = sorted({k for k in keys if k is not None})
        found = self.read(sorted({*self.files(keys), *self.loose()}))
        if len(keys) <= ASKED:
            return found.where(F.col(self.key).isin(keys))
        kind = found.schema[self.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, kind)]))
        return found.join(asked, self.key, "left_semi")
