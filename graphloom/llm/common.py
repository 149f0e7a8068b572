"""Shared parts of the text operators: shared storage, bundles of rows, seeded hashes.

A *bundle* is a run of rows of one input partition, at most ``limit`` bytes of text (a longer text is a
bundle of its own), kept as one compressed Arrow stream.  Operators that have to look up many keys for each
document exchange the distinct keys of a bundle, not those of a document, and bring the answers back to the
bundle (``exchange``).  Bundles are checkpointed or come straight from files, so that their numbers stay the same when
an executor is lost.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUNDLE_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the one the cluster names in ``spark.checkpoint.dir``; a local one is set only where that is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which takes less room than a checkpoint where texts are in it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the column as text, modulo ``divisor``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def is_remainder(column: str, divisor: int, value: int) -> Column:
    """Whether ``remainder`` is ``value``; false for null."""
    return F.coalesce(remainder(column, divisor) == value, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def runs(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[tuple[int, pa.Table]]:
    """The bundles of a partition: (number, rows)."""
    from pyspark import TaskContext

    number, size = TaskContext.get().partitionId() << 24, 0
    held: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        for i, n in enumerate(sizes(batch.column(text)).tolist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield number, pa.Table.from_batches(held)
                number, held, size, start = number + 1, [], 0, i
            size += n
        if len(batch) > start:
            held.append(batch.slice(start))
    if held:
        yield number, pa.Table.from_batches(held)


class Bundles:
    """The bundles of some rows, with the bytes of ``text`` in them.

    They are checkpointed as compressed Arrow streams.  With ``stored`` false they are computed anew at each use, which
    saves disk; only for rows that come straight from files, whose partitions and order of rows are the same each time.
    """

    def __init__(self, rows: DataFrame, text: str, limit: int = BUNDLE_BYTES, stored: bool = True, level: int = 1):
        self.rows, self.text, self.limit = rows, text, limit

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, table in runs(batches, text, limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as to:
                    to.write_table(table)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bundle", "payload"])

        held = rows.mapInArrow(pack, "bundle long, payload binary")
        self.held, self.stored = checkpointed(held) if stored else held, stored

    def bytes(self) -> int:
        """Bytes of all texts."""
        return self.rows.agg(F.sum(F.octet_length(self.text))).first()[0] or 0

    def map(self, f: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``f`` makes of each bundle's number and rows."""
        text, limit, stored = self.text, self.limit, self.stored

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, table in opened(batches) if stored else runs(batches, text, limit):
                yield from f(number, table)

        return (self.held if stored else self.rows).mapInArrow(run, schema)

    def answered(self, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], kind: T.StructType) -> DataFrame:
        """What ``f`` makes of each bundle's answers and rows."""
        return self.met(answers, lambda _, found, rows: f(found, rows), kind)

    def met(self, told: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], kind: T.StructType) -> DataFrame:
        """What ``f`` makes of each bundle's number, what it is told, and its rows."""

        def run(found: pa.Table, bundle: pa.Table) -> pa.Table:
            out = [f(number.as_py(), found, unpack(x.as_buffer())) for number, x in zip(bundle.column("bundle"), bundle.column("payload"), strict=True)]
            return pa.concat_tables(out) if out else arrow_schema(kind).empty_table()

        return told.groupBy("bundle").cogroup(self.held.groupBy("bundle")).applyInArrow(run, kind)


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Each bundle of Arrow batches of (bundle, payload)."""
    for batch in batches:
        for number, payload in zip(batch.column("bundle"), batch.column("payload"), strict=True):
            yield number.as_py(), unpack(payload.as_buffer())


def spans(texts: list, size: int = 1 << 20) -> Iterator[slice]:
    """Runs of texts of some ``size`` together; a longer text is a run of its own."""
    start = held = 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            yield slice(start, i)
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield slice(start, len(texts))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of hash (two columns of 64) of each stretch of bytes; equal stretches have equal hashes wherever they lie.

    Up to 15 bytes the hash is a bijection of the bytes and their number, so it is equal for equal bytes only; longer stretches
    go by the lower 120 bits of XXH3.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    at = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place
    size = ends - starts
    low = at[starts] & _FIRST[np.minimum(size, 8)]
    high = at[starts + np.minimum(size, 8)] & _FIRST[np.clip(size - 8, 0, 7)] | size.astype(np.uint64) << np.uint64(56)
    for i in np.flatnonzero(size > 15).tolist():
        h = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]])
        low[i], high[i] = h & (1 << 64) - 1, h >> 64 | 0xFF << 56
    high ^= mixed(low)
    low ^= mixed(high)
    return np.stack([mixed(low), mixed(high)], axis=1)


#: masks of the first 0 to 8 bytes of a word
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts, one after the other: place in ``data``, 128 bits of hash, text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
        blank = _BLANK[self.data]
        edge = np.diff(blank.astype(np.int8), prepend=1)
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(self.ends) and self.ends[0] == 0:
            self.ends = self.ends[1:]
        borders = np.cumsum([0, *(len(x) + 1 for x in texts)])
        #: number of the first word of each text, and of all words
        self.offsets = np.searchsorted(self.starts, borders)
        self.counts = np.diff(self.offsets)
        self.h = hashed(self.data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def take(self, which: np.ndarray) -> pa.Array:
        """These words as a binary array."""
        size = self.ends[which] - self.starts[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.starts[which] - upto[:-1], size) + np.arange(upto[-1])
        return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(self.data[at])])


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each distinct hash, number of each row's hash), by all 128 bits."""
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, first, number = np.unique(h[:, 0], return_index=True, return_inverse=True)
    if (h[first[number], 1] == h[:, 1]).all():
        return first, number
    _, first, number = np.unique(h.view("u8,u8").reshape(-1), return_index=True, return_inverse=True)
    return first, number


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Places:
    """Where keys are in an ascending array that holds all of them: by tables of hashes, each for what lost its slot in the
    one before, and by bisection what is left."""

    def __init__(self, keys: np.ndarray, tables: int = 3):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        for seed in range(tables):
            shift = np.uint64(64 - max(10, (4 * len(left)).bit_length()))
            table = np.zeros(1 << 64 - int(shift), np.int32)
            slot = mixed(keys[left] ^ np.uint64(seed)) >> shift
            table[slot] = left
            self.tables.append((np.uint64(seed), shift, table))
            left = left[table[slot] != left]

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.empty(0, np.int32)
        (_, shift, table), *others = self.tables
        at = table[mixed(keys) >> shift]
        miss = np.flatnonzero(self.keys[at] != keys)
        for seed, shift, table in others:
            own = keys[miss]
            at[miss] = found = table[mixed(own ^ seed) >> shift]
            miss = miss[self.keys[found] != own]
        at[miss] = np.searchsorted(self.keys, keys[miss])
        return at


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` entries of ``h`` a 64-bit hash of their sequence."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
        if j % 8 == 7:
            out ^= out >> np.uint64(29)
    return mixed(out)


def arrow_schema(kind: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)
