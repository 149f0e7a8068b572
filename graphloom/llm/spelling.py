"""Groups of spelling variants: words that differ by one inserted, deleted or replaced letter, by letter-parity bitmasks.

A run of letters ``[A-Za-z\\u00C0-\\u00FF]+`` of a text, with A-Z lower-cased, is a word; in one of ``ERROR`` runs, by
crc32 of ``<id>:<run>``, a letter is left out.  Tasks sum up the words of some MB before they are dealt; words of at least
``LENGTH`` letters and ``TIMES`` occurrences stay.

A word's mask has a bit for each of the 90 letters: whether it occurs an odd number of times.  A replacement flips two bits, an
insertion or deletion one.  The mask is split into three bands of 30 bits (letter i of the alphabet is in band i mod 3), so
near words have an equal band, and more is known of them: either two bands are equal, or one, and then the words are of one
length and each of the other bands has one flip, so both change the parity of their bits.  So words are dealt by each two
bands, to be compared with those of their length (two flips in the third band) or of one letter more (one flip), and by
each band with the length and the joint parity of the others, to be compared with those of the other parity.  Pairs whose
flips fit are verified letter by letter; each near pair is in exactly one of these buckets.  A large bucket is cut into
blocks that meet each other in tasks of their own (of 8,192 words, or a sixteenth of it, but 65,536 at most), so no task
holds a bucket; a task tells for each word how many near words it met and the best of them, not the pairs.

A word's form is its near word of most occurrences (ties: the first in the order of code points) if it has at least twice
the word's own; its root is where the forms lead, found by pointer jumping, as many rounds as the logarithm of the
longest chain.

Null texts have no words; a null id counts as empty text in the hash; repeated rows count each; an empty table gives an
empty one; a text of any length is read whole, in stretches that end between runs; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import dealt
from . import common

ERROR = 97
LENGTH = 5
TIMES = 3
PIECE = 1 << 20
SPAN = 4 << 20
SMALL, LARGE = 8192, 65_536
SALTS = 8
BANDS = 3
FACTOR = 2  # occurrences of a form in those of its variant

_BREAK = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True  # 0xC3 begins U+00C0 to U+00FF, and nothing else
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ 0xEDB88320, _CRC >> 1).astype(np.uint32)


def pieces(text: bytes) -> Iterator[bytes]:
    """``text`` in stretches of some ``PIECE`` bytes that end between runs."""
    at = 0
    while at < len(text):
        found = _BREAK.search(text, at + PIECE)
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes, going on from the crc32 of what is before it."""
    out, size = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    long = np.flatnonzero(size > 64)
    live = np.flatnonzero(size <= 64)
    j = 0
    while len(live := live[size[live] > j]):
        out[live] = _CRC[(out[live] ^ data[starts[live] + j]) & 0xFF] ^ out[live] >> np.uint32(8)
        j += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in long.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]], int(before[i]))
    return out


def tallied(ids: list, stretches: list[bytes]) -> dict[bytes, int]:
    """Occurrences of each word of at least ``LENGTH`` letters in some stretches of text, with the ids of their rows."""
    data = np.frombuffer(b"\n".join([*stretches, b""]), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    letter = _LETTER[data]
    letter[1:] |= data[:-1] == 0xC3
    edge = np.diff(letter.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in stretches]), starts, side="right")
    h = common.hashed(data, starts, ends)
    own = common.mixed(owner.astype(np.uint64) + np.uint64(1))
    first, number = common.distinct(np.stack([common.mixed(h[:, 0] ^ own), h[:, 1] ^ own], axis=1))  # runs of one stretch share their hash
    n = np.bincount(number, minlength=len(first))
    starts, ends, owner, h = starts[first], ends[first], owner[first], h[first]
    crc = crcs(data, starts, ends, np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)[owner])
    marked = crc % ERROR == 0
    out: Counter[bytes] = Counter()
    for i in np.flatnonzero(marked).tolist():
        word = data[starts[i] : ends[i]].tobytes().decode()
        at = int(crc[i]) % len(word)
        if len(word) > LENGTH:
            out[(word[:at] + word[at + 1 :]).encode()] += int(n[i])
    letters = ends - starts - np.diff(np.append(0, np.cumsum(data == 0xC3))[np.stack([starts, ends], axis=1)], axis=1)[:, 0]
    kept = np.flatnonzero(~marked & (letters >= LENGTH))
    first, number = common.distinct(h[kept])
    total = np.bincount(number, weights=n[kept], minlength=len(first)).astype(np.int64)
    for i, m in zip(kept[first].tolist(), total.tolist(), strict=True):
        out[data[starts[i] : ends[i]].tobytes()] += m
    return out


def words(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(word, n) of the words that count."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[object, bytes]] = []
        size = 0

        def told() -> pa.RecordBatch:
            found = tallied(*map(list, zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), common.texts(b.column(1)), strict=True):
                for piece in pieces(x):
                    held.append((i, piece))
                    size += len(piece)
                    if size >= SPAN:
                        yield told()
                        held, size = [], 0
        if held:
            yield told()

    return docs.select(id_column, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def bands(letters: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[word, band] of the parity masks of words, whose letters (as Latin-1) follow each other."""
    i = np.where(letters < 0xC0, letters - 97, letters - (0xC0 - 26)).astype(np.uint32)
    bit = np.uint32(1) << i // BANDS
    return np.stack([np.bitwise_xor.reduceat(np.where(i % BANDS == b, bit, np.uint32(0)), starts) for b in range(BANDS)], axis=1)


def masked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of (word, n) in its six buckets, with the bits that these don't fix, and its side where only two sides are compared."""
    for b in batches:
        if len(b):
            own = [x.encode("latin-1") for x in b.column(0).to_pylist()]
            size = np.array(list(map(len, own)))
            m = bands(np.frombuffer(b"".join(own), np.uint8), np.cumsum(size) - size).astype(np.uint64)
            odd = np.bitwise_count(m).astype(np.uint64) & np.uint64(1)
            words, u = pa.array(own, pa.binary()), np.uint64
            for band in range(BANDS):
                low, high = (j for j in range(BANDS) if j != band)
                one = u(band << 60) | m[:, band] << u(30) | size.astype(u) << u(1) | odd[:, low] ^ odd[:, high]
                two = u(band + BANDS << 60) | m[:, low] << u(30) | m[:, high]
                for bucket, rest, side in ((one, m[:, low] | m[:, high] << u(32), odd[:, low].astype(np.int32)), (two, m[:, band], np.full(len(own), -1, np.int32))):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(rest.view(np.int64)), pa.array(side), words, b.column(1)], ["bucket", "rest", "side", "word", "n"])


class Block:
    """Some buckets, or a part of one, with the words' letters, and what is found of each word."""

    def __init__(self, bucket: np.ndarray, side: np.ndarray, rest: np.ndarray, word: list[bytes], n: np.ndarray):
        size = np.array(list(map(len, word)))
        by = np.lexsort((side, size, bucket))
        self.bucket, self.side, self.rest, self.size, self.n = bucket[by], side[by], rest[by].view(np.uint64), size[by], n[by]
        self.word = [word[i] for i in by.tolist()]
        self.letters = np.frombuffer(b"".join(self.word), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        order = sorted(range(len(word)), key=lambda i: (-self.n[i], self.word[i]))
        self.rank = np.empty(len(word), np.int64)
        self.rank[order] = np.arange(len(word))
        self.order = np.array(order)
        self.near, self.best = np.zeros(len(word), np.int64), np.full(len(word), len(word))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates (a, b), b as long as a or one longer, whose flips fit; those of small buckets row by row at each distance, those
        of large ones in rectangles."""
        first = np.flatnonzero(np.diff(self.bucket, prepend=~self.bucket[:1]))
        last = np.append(first[1:], len(self.bucket))
        small = np.repeat(last - first <= 64, last - first)
        # rows are in the order of bucket, length and side; upto: where words of the next length end
        place = np.repeat(np.arange(len(first)), last - first) * (int(self.size.max()) + 3) + self.size
        upto = np.searchsorted(place, place + 1, side="right")
        live, distance = np.flatnonzero(small), 1
        while len(live := live[live + distance < upto[live]]):
            fits = np.bitwise_count(self.rest[live] ^ self.rest[live + distance]) + (self.size[live + distance] - self.size[live]) == 2
            yield from self.apart(live[fits], live[fits] + distance)
            distance += 1
        for a, z in zip(first.tolist(), last.tolist(), strict=True):
            if z - a > 64:
                cuts = [a, *(np.flatnonzero(np.diff(self.size[a:z])) + 1 + a).tolist(), z]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    end = int(upto[i])
                    middle = i + int(np.searchsorted(self.side[i:j], 1)) if self.bucket[i] >> 60 < BANDS else j
                    step = max(1, (1 << 20) // (end - i))
                    for k in range(i, middle, step):
                        start = middle if middle < j else k
                        flips = np.bitwise_count(self.rest[k : min(k + step, middle), None] ^ self.rest[None, start:end])
                        wanted = np.full(end - start, 2, np.uint8)
                        wanted[j - start :] = 1
                        p, q = np.divmod(np.flatnonzero(flips == wanted), end - start)
                        p, q = p + k, q + start
                        yield from self.apart(p[q > p], q[q > p])

    def apart(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of candidates those of both sides, where there are two."""
        ok = (self.side[a] != self.side[b]) | (self.side[a] < 0)
        if ok.any():
            yield a[ok], b[ok]

    def verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """Counts the pairs that one edit parts."""
        for size in np.unique(self.size[a]).tolist():
            at = np.flatnonzero(self.size[a] == size)
            for i in range(0, len(at), step := max(1, (1 << 22) // size)):
                p, q = a[at[i : i + step]], b[at[i : i + step]]
                x = self.letters[self.start[p][:, None] + np.arange(size)]
                head = x == self.letters[self.start[q][:, None] + np.arange(size)]
                same = self.size[q] == size
                one = same & (size - head.sum(axis=1) == 1)
                longer = np.flatnonzero(~same)
                tail = x[longer] == self.letters[self.start[q[longer]][:, None] + np.arange(1, size + 1)]
                begun = np.logical_and.accumulate(head[longer], axis=1).sum(axis=1)
                ended = np.logical_and.accumulate(tail[:, ::-1], axis=1).sum(axis=1)
                one[longer] = begun + ended >= size
                for u, v in ((p[one], q[one]), (q[one], p[one])):
                    self.near += np.bincount(u, minlength=len(self.near))
                    np.minimum.at(self.best, u, self.rank[v])

    def found(self) -> pa.RecordBatch:
        for a, b in self.pairs():
            self.verify(a, b)
        some = np.flatnonzero(self.near)
        best = self.order[self.best[some]]
        name = lambda at: pa.array([self.word[i].decode("latin-1") for i in at.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([name(some), pa.array(self.near[some]), pa.array(self.n[best]), name(best)], ["word", "n_near", "best_n", "best"])


def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the words of (bucket, i, j, side, rest, word, n), sorted by the first three, find in their blocks."""
    held: list[pa.RecordBatch] = []

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        column = lambda name: rows.column(name).to_numpy()
        if len(rows) > 1:
            yield Block(column("bucket"), column("side"), column("rest"), rows.column("word").to_pylist(), column("n")).found()

    for b in batches:
        if not len(b):
            continue
        rows = pa.Table.from_batches([*held, b]).combine_chunks()
        key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
        new = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        split = np.append(0, new)  # where blocks begin; the last may go on
        whole = (key[1] == 0) & (key[2] == 0)  # of a bucket's first block, or all of it
        start = 0
        for at, end in zip(split[:-1].tolist(), split[1:].tolist(), strict=True):
            if not whole[at]:  # a part of a large bucket stands alone
                yield from told(rows.slice(start, at - start))
                yield from told(rows.slice(at, end - at))
                start = end
            elif end - start >= 32_768:
                yield from told(rows.slice(start, end - start))
                start = end
        rest = int(split[-1])
        yield from told(rows.slice(start, rest - start))
        held = rows.slice(rest).to_batches()
    if held:
        yield from told(pa.Table.from_batches(held).combine_chunks())


def near(counted: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) that has near words."""
    spread = counted.mapInArrow(masked, "bucket long, rest long, side int, word binary, n long")
    each = F.greatest(F.lit(SMALL), F.least(F.lit(LARGE), F.col("m") / 16))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / each).cast("int").alias("blocks"))
    salt = F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int")
    met = spread.withColumn("salt", salt).join(dealt(sizes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))), ["bucket", "salt"])
    own = F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # of two sides every block of one meets every block of the other; else blocks meet each other, and themselves, once
    sided, i, j = F.col("side") >= 0, F.least("own", "other"), F.greatest("own", "other")
    i, j = F.when(~sided, i).when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")), F.when(~sided, j).when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))
    side = F.when(sided, F.col("side")).when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    met = met.select("bucket", i.alias("i"), j.alias("j"), side.alias("side"), "rest", "word", "n")
    tasks = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work goes with the square of rows, so small ones are not put together
    found = met.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compared, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("least"), F.col("best").alias("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("top.least")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word of (word, form): where following forms ends."""
    ends = forms.select("word", F.col("form").alias("root"))
    while True:
        salted = ends.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        ends = common.checkpointed(salted.join(dealt(onward), ["root", "salt"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if ends.where("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def variants(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that counts."""
    counted = common.checkpointed(words(docs, text, id_column))
    form = F.col("best_n") >= FACTOR * F.col("n")
    found = counted.join(near(counted), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    found = common.checkpointed(found)
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
