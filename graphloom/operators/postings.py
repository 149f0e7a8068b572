"""A stored search index: blocks of postings in files clustered by token, and a dictionary of the files' ranges.

Each task makes blocks of its own places, and blocks, not places, are dealt by ranges of (token, field, node, position), so a
file holds a stretch of the alphabet and a frequent token spans files of its own; no task has to hold a token.  A block
holds up to ``ENTRIES`` places of one token in one field of up to ``NODES`` nodes with neighbouring ids, and of ``PLACES``
positions in these, as differences to the least that there may be.
``part`` is the number of the range and the folder; the dictionary has a row for each part with its first and last token.  A
word or prefix is looked up in the dictionary, which is a few rows, and only the folders whose range holds it are listed
and read; inside them the token is pushed down to the row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import shared_folder

NODES = 1 << 12
PLACES = 1 << 14
ENTRIES = 4  # of a block at most, so that ranges of as many blocks hold like numbers of places
RUN = 1 << 21  # places that a task sorts together
BATCH = 1 << 14
POSTINGS = "token string, field string, node long, place int, nodes array<int>, places array<int>, part int"
TERMS = "part int, first string, last string, blocks long, postings long"


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each ``RUN`` places or so of a partition's (token, field, node_id, pos), or (words, field, node_id)."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, len(batch), 256):
            own = flat(batch.slice(start, 256)) if len(batch.columns) == 3 else batch.slice(start, 256)
            held.append(own)
            size += len(own)
            if size >= RUN:
                yield from blocks(pa.Table.from_batches(held))
                held, size = [], 0
    if size:
        yield from blocks(pa.Table.from_batches(held))


def flat(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(token, field, node_id, pos) of (words, field, node_id)."""
    words, at = rows.column(0), pc.list_parent_indices(rows.column(0))
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    return pa.RecordBatch.from_arrays([words.flatten(), rows.column(1).take(at), rows.column(2).take(at), pa.array(pos)], ["token", "field", "node_id", "pos"])


def blocks(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The blocks of some (token, field, node_id, pos)."""
    token, field = (rows.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
    node, pos = rows.column(2).to_numpy().astype(np.int64), rows.column(3).to_numpy().astype(np.int64)
    word, of = token.indices.to_numpy(), field.indices.to_numpy()
    both = word.astype(np.uint64) * np.uint64(len(field.dictionary)) + of.astype(np.uint64)
    if ((node[1:] < node[:-1]) | (node[1:] == node[:-1]) & (of[1:] == of[:-1]) & (pos[1:] < pos[:-1])).any():
        order = np.lexsort((pos, node, both))
    else:  # by token and field, places as they come
        bits = np.uint64(len(node).bit_length())
        order = (np.sort(both << bits | np.arange(len(node), dtype=np.uint64)) & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    node, pos = node[order], pos[order]
    base, place = node // NODES * NODES, pos // PLACES * PLACES
    key = (word[order], of[order], base, place)
    new = np.zeros(len(node), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    new[np.flatnonzero((np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))) % ENTRIES == 0)] = True
    starts = np.flatnonzero(new)
    for i in range(0, len(starts), BATCH):
        own = starts[i : i + BATCH]
        a, b = int(own[0]), int(starts[i + BATCH]) if i + BATCH < len(starts) else len(node)
        ends = pa.array(np.append(own - a, b - a).astype(np.int32))
        lists = (pa.ListArray.from_arrays(ends, pa.array(x[a:b].astype(np.int32))) for x in (node - base, pos - place))
        words = (x.dictionary.take(pa.array(k[own])) for x, k in ((token, key[0]), (field, key[1])))
        yield pa.RecordBatch.from_arrays([*words, pa.array(base[own]), pa.array(place[own].astype(np.int32)), *lists], ["token", "field", "node", "place", "nodes", "places"])


def write(tokens: DataFrame, path: str, parts: int | None = None) -> None:
    """Stores the index of ``tokens`` (node_id, field, pos, token), or of (node_id, field, words), under ``path``, in ``parts`` ranges (by default of the size that
    Spark gives the partitions of a shuffle)."""
    spark, keys, kind = tokens.sparkSession, ["token", "field", "node", "place"], POSTINGS.removesuffix(", part int")
    made = f"{shared_folder(spark)}/blocks-{uuid.uuid4().hex}"  # tokens are made once: ranges are found, and blocks dealt, from these files
    own = ["words", "field", "node_id"] if "words" in tokens.columns else ["token", "field", "node_id", "pos"]
    tokens.select(*own).mapInArrow(packed, kind).write.option("compression", "zstd").parquet(made)
    found = spark.read.schema(kind).parquet(made)
    ends = [*keys, F.get("nodes", F.lit(0)), F.get("places", F.lit(0))]  # blocks of one key are of different tasks, or follow each other
    found = (found.repartitionByRange(parts, *ends) if parts else found.repartitionByRange(*ends)).withColumn("part", F.spark_partition_id())
    found.sortWithinPartitions("part", *ends).write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    ranges = stored.groupBy("part").agg(F.min("token").alias("first"), F.max("token").alias("last"), F.count("*").alias("blocks"), F.sum(F.size("nodes")).alias("postings"))
    ranges.coalesce(1).write.parquet(f"{path}/terms")  # a row for each part


@dataclass(frozen=True)
class Stored:
    """An index written by ``write``."""

    spark: SparkSession
    path: str

    @property
    def terms(self) -> DataFrame:
        return self.spark.read.schema(TERMS).parquet(f"{self.path}/terms")

    def parts(self, words: tuple[str, ...], prefix: bool = False) -> list[int]:
        """The parts whose range holds one of the words, or, with ``prefix``, what the last of them begins."""
        held = F.lit(False)
        for i, word in enumerate(words):
            begins = prefix and i == len(words) - 1
            last = F.substring("first", 1, len(word)) <= word if begins else F.col("first") <= word
            held = held | (last & (F.col("last") >= word))
        return sorted(r.part for r in self.terms.where(held).select("part").collect())  # parts are a few

    def blocks(self, words: tuple[str, ...], prefix: bool = False) -> DataFrame:
        """The blocks of some words, read from the parts that can hold them."""
        match = F.lit(False)
        for i, word in enumerate(words):
            match = match | matching(F.col("token"), word, prefix and i == len(words) - 1)
        every = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        return every.where(F.col("part").isin(self.parts(words, prefix)) & match)

    def tokens(self, words: tuple[str, ...], prefix: bool = False, fields: tuple[str, ...] | None = None) -> DataFrame:
        """(node_id, field, pos, token) of some words."""
        own = self.blocks(words, prefix)
        if fields is not None:
            own = own.where(F.col("field").isin(*fields) if fields else F.lit(False))
        at = own.select("token", "field", "node", "place", F.inline(F.arrays_zip("nodes", "places")))
        return at.select((F.col("node") + F.col("nodes")).alias("node_id"), "field", (F.col("place") + F.col("places")).alias("pos"), "token")

    def isEmpty(self) -> bool:  # noqa: N802  as of a DataFrame
        return self.terms.isEmpty()


def matching(token: Column, word: str, prefix: bool) -> Column:
    return token.startswith(word) if prefix else token == word
