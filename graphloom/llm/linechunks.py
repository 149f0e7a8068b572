r"""Removal of repeated runs of lines, cut by content.

A text's lines (split at \n) are hashed, a rolling hash over the last ``span`` line hashes says where a chunk
ends (when it is 0 modulo ``divisor``), so boundaries move with the lines and an insertion shifts only the
chunks around it.  Chunks of two lines or more with two lines that aren't blank are compared over all texts by
128 bits of hash; the bytes of every chunk whose hash repeats are then compared, and chunks of equal hash but
other bytes are told apart by their bytes.  Of equal chunks the first (by id, then text, then place) stays, the
others' lines go; the rest of the text stays as it is.

Null text stays null; empty and one-line texts have no chunk; rows that repeat id and text are one text and get
one result each; an empty table gives an empty one; texts of any length are cut whole.  ``keep`` columns pass
through; the operator's own columns replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import dealt
from . import common

SPAN = 2
DIVISOR = 2
SALTS = 32
HELD = 32 << 20  # bytes of chunks that a task remembers having sent


class Chunks:
    """The chunks of some texts: hash, place in ``data``, lines, number within their text, text."""

    def __init__(self, texts: list[bytes], span: int = SPAN, divisor: int = DIVISOR, hash_bits: int = 64):
        self.data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
        ends = np.flatnonzero(self.data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        borders = np.cumsum([0, *(len(x) + 1 for x in texts)])[:-1]
        head = np.zeros(len(starts), bool)
        head[np.searchsorted(starts, borders)] = True
        owner = np.cumsum(head) - 1
        place = np.arange(len(starts)) - np.flatnonzero(head)[owner] if len(starts) else owner
        h = common.hashed(self.data, starts, ends)[:, 0]
        roll = h.copy()
        for back in range(1, span):
            before = np.concatenate([np.zeros(min(back, len(h)), np.uint64), h[:-back]])
            roll = common.mixed(roll + np.where(place >= back, before, 0).astype(np.uint64) * np.uint64(2 * back + 1))
        last = np.append(head[1:], True).astype(bool)[: len(head)]
        cut, length = (roll % np.uint64(divisor) == 0).tolist(), 0
        close = np.zeros(len(starts), bool)
        for i, (c, e) in enumerate(zip(cut, last.tolist(), strict=True)):  # a chunk holds two lines at least, if the text has them
            length += 1
            if e or c and length > 1:
                close[i], length = True, 0
        stop = np.flatnonzero(close)
        start = np.concatenate([[0], stop[:-1] + 1]) if len(stop) else stop
        filled = np.concatenate([[0], np.cumsum([len(bytes(self.data[a:b]).strip()) > 0 for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])])
        self.first, self.end, self.owner = starts[start], ends[stop], owner[stop]
        self.lines = stop - start + 1
        self.number = np.arange(len(stop)) - np.searchsorted(self.owner, self.owner)
        self.multi = filled[stop + 1] - filled[start] > 1
        self.h = common.hashed(self.data, self.first, self.end)
        if hash_bits < 64:
            self.h = self.h & np.array([(1 << hash_bits) - 1, 0], np.uint64)

    def bytes(self, i: int) -> bytes:
        return self.data[self.first[i] : self.end[i]].tobytes()


def dedup(docs: DataFrame, text: str = "text", id_column: str = "doc_id", keep: tuple[str, ...] | None = None, span: int = SPAN, divisor: int = DIVISOR, hash_bits: int = 64) -> DataFrame:
    """``keep`` columns (all, if None), the text without repeated chunks, n_lines and n_removed_lines."""
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in ("n_lines", "n_removed_lines"))
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("\1")), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(*dict.fromkeys([*keep, text]), F.unhex(F.md5(key)).alias("__row"), F.col(id_column).alias("__id"))
    id_field = T.StructField("__id", docs.schema[id_column].dataType)
    cut = (span, divisor, hash_bits)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = common.texts(batch.column(0))
            for some in common.spans(own):
                c = Chunks(own[some], *cut)
                at = np.flatnonzero(c.multi)
                where = pa.array(c.owner[at] + some.start)
                h = c.h[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), batch.column(1).take(where), batch.column(2).take(where), pa.array(c.number[at].astype(np.int32))], ["h1", "h2", "__id", "__row", "number"])

    place = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), id_field, T.StructField("__row", T.BinaryType()), T.StructField("number", T.IntegerType())])
    found = rows.select(text, "__id", "__row").mapInArrow(find, place)
    first = F.min(F.struct("__id", "__row", "number")).alias("first")
    salt = F.pmod(F.xxhash64("__row", "number"), F.lit(SALTS))
    groups = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), first).where("n > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    again = found.withColumn("salt", salt).join(dealt(groups), ["h1", "h2", "salt"])
    again = again.select("h1", "h2", "__id", "__row", "number", (F.struct("__id", "__row", "number") == F.col("first")).alias("stays"))
    again = common.checkpointed(again.dropDuplicates(["__row", "number"]))
    marked = again.groupBy("__row").agg(F.collect_list(F.struct("number", "h1", "h2")).alias("__marked"))
    carried = rows.select("__row", "__id", F.col(text).alias("__text")).dropDuplicates(["__row"]).join(dealt(marked), "__row")

    def pieces(distinct: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent: dict[tuple[int, int], bytes] = {}
            room = HELD
            for batch in batches:
                own, numbers = common.texts(batch.column(2)), batch.column(3).to_pylist()
                for some in common.spans(own):
                    c, out = Chunks(own[some], *cut), []
                    begin = np.searchsorted(c.owner, np.arange(some.stop - some.start))
                    for i, marks in enumerate(numbers[some]):
                        for m in marks:
                            at = int(begin[i]) + m["number"]
                            if distinct:
                                key, data = (m["h1"], m["h2"]), c.bytes(at)
                                if sent.get(key) == data:
                                    continue
                                if key not in sent and len(data) < room:
                                    sent[key], room = data, room - len(data) - 200
                            out.append((m["h1"], m["h2"], some.start + i, m["number"], c.bytes(at)))
                    h1, h2, where, number, data = list(zip(*out, strict=True)) or [()] * 5
                    where = pa.array(where, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column(1).take(where), batch.column(0).take(where), pa.array(number, pa.int32()), pa.array(data, pa.binary())], ["h1", "h2", "__id", "__row", "number", "data"])

        return carried.mapInArrow(run, T.StructType([*place.fields, T.StructField("data", T.BinaryType())]))

    compared = pieces(True).groupBy("h1", "h2").agg(F.min("data").alias("least"), F.max("data").alias("most"))
    unlike = common.checkpointed(compared.where("least <> most").select("h1", "h2"))
    gone = again.where(~F.col("stays")).join(unlike, ["h1", "h2"], "left_anti").select("__row", "number")
    if not unlike.isEmpty():  # chunks of one hash but other bytes: the groups are those of equal bytes
        exact = pieces(False).join(unlike, ["h1", "h2"], "left_semi")
        firsts = exact.groupBy("h1", "h2", "data").agg(first)
        other = exact.join(firsts, ["h1", "h2", "data"]).where(F.struct("__id", "__row", "number") != F.col("first"))
        gone = gone.union(other.select("__row", "number"))
    gone = gone.groupBy("__row").agg(F.collect_set("number").alias("__gone"))
    own = [c for c in keep if c != text]
    out = rows.select(*own, F.col(text).alias("__text"), "__row").join(dealt(gone), "__row", "left").drop("__row")
    kind = T.StructType([*(docs.schema[c] for c in own), T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType())])

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, numbers = batch.column(len(own)).cast(pa.large_binary()).to_pylist(), batch.column(len(own) + 1).to_pylist()
            kept, n_lines, n_gone = [], [], []
            for x, marks in zip(raw, numbers, strict=True):
                n_lines.append(x.count(b"\n") + 1 if x else 0)
                n_gone.append(0)
                if marks:
                    c, lines, left, at = Chunks([x], *cut), x.split(b"\n"), [], 0
                    for number, size in enumerate(c.lines.tolist()):
                        if number in marks:
                            n_gone[-1] += size
                        else:
                            left += lines[at : at + size]
                        at += size
                    x = b"\n".join(left)
                kept.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64())], kind.names)

    return out.mapInArrow(remove, kind).select(*dict.fromkeys([*keep, text]), "n_lines", "n_removed_lines")
