"""Questions of bundles to shards of a table too large for one machine, and the answers back.

A bundle asks each shard once, about all the keys of that shard it holds; what it knows of them itself (counts, say)
goes along.  A shard puts together what all bundles know of its keys and answers every bundle in the order it asked
in, so answers need no keys, and a key that all bundles hold is one entry for each of them.  Questions are dealt by
shard and checkpointed; a shard holds what some ``SHARD_BYTES`` of text ask, so it grows with nothing but its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SHARD_BYTES = 8 << 20
SCHEMA = "shard int, bundle long, data binary"
KIND = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bundle", T.LongType()), T.StructField("data", T.BinaryType())])
ARROW = pa.schema([("shard", pa.int32()), ("bundle", pa.int64()), ("data", pa.binary())])


def dump(*arrays: np.ndarray) -> bytes:
    """Compressed arrays of numbers; of unsigned 64-bit ones, which are to ascend, the differences are kept."""
    parts = []
    for x in arrays:
        x = np.diff(x, prepend=x.dtype.type(0)) if x.dtype == np.uint64 else x
        parts += [f"{x.dtype.str}{len(x)} ".encode(), np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def load(data: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(data):
        stop = data.index(b" ", at)
        kind, n = np.dtype(data[at : at + 3].decode()), int(data[at + 3 : stop])
        at = stop + 1 + n * kind.itemsize
        x = np.ascontiguousarray(np.frombuffer(data[stop + 1 : at], np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n)
        out.append(np.cumsum(x, dtype=np.uint64) if kind == np.uint64 else x)
    return out


def shards(size: int, each: int = SHARD_BYTES) -> int:
    """Number of shards for so many bytes of text."""
    return max(1, -(-size // each))


def placed(groups: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ascending groups of keys that belong together: (the keys' order by shard, the shards that are asked, where each's begin and end)."""
    first = np.flatnonzero(np.diff(groups, prepend=~groups[:1]))
    size = np.diff(np.append(first, len(groups)))
    shard = (common.mixed(groups[first].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    upto = np.cumsum(size[by])
    order = np.repeat(first[by] - upto + size[by], size[by]) + np.arange(len(groups))
    asked, begin = np.unique(shard[by], return_index=True)
    return order, asked, np.append(np.append(0, upto)[begin], len(groups))


def rows(number: int, questions: Iterable[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of a bundle's (shard, data)."""
    held, size = [], 0
    for shard, data in questions:
        held.append((shard, data))
        size += len(data)
        if size > 4 << 20:
            yield batch([(s, number, d) for s, d in held])
            held, size = [], 0
    if held:
        yield batch([(s, number, d) for s, d in held])


def batch(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    shard, bundle, data = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(bundle, pa.int64()), pa.array(data, pa.binary())], ["shard", "bundle", "data"])


def dealt(asked: DataFrame, stored: bool = True) -> DataFrame:
    """Questions dealt by shard, each shard's one after the other; checkpointed (``stored``) if they are to be answered more than once."""
    out = asked.repartition("shard").sortWithinPartitions("shard", "bundle")
    return common.checkpointed(out) if stored else out


def each(questions: DataFrame, f: Callable[[int, list[int], list[bytes]], Iterator[pa.RecordBatch]], schema: str = SCHEMA) -> DataFrame:
    """What ``f`` makes of each shard's number, bundles and questions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bundles, data = None, [], []
        for batch in batches:
            for s, b, d in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if s != shard and bundles:
                    yield from f(shard, bundles, data)
                    bundles, data = [], []
                shard = s
                bundles.append(b)
                data.append(d)
        if bundles:
            yield from f(shard, bundles, data)

    return questions.mapInArrow(run, schema)


def told(found: pa.Table) -> dict[int, bytes]:
    """A bundle's answers by shard."""
    return dict(zip(found.column("shard").to_pylist(), found.column("data").to_pylist(), strict=True))
