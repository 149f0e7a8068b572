"""Removal of word sequences that occur more than once, with a count-min prefilter.

Two equal windows of ``width`` words hold the same ``anchor``-word run at the same place: the one of least
hash (the first of these).  Pass 1 counts anchors in a count-min sketch: each bundle sends what it adds to each slice
of the sketch, slices are merged and stay where they are, and each bundle learns which of its counters reach two
(``exchange``).  An anchor's estimate is never under its count, and that is never under the count of any window it
stands for, so pass 2, which groups exactly only windows whose anchor is estimated repeated, loses none.  The sketch has
a counter for every 20 bytes of text at least, so it lets no larger share through the larger the corpus is, and no part
of it is on the driver or in more than one task.

Windows are grouped by 128 bits of hash, of which words of up to 15 bytes enter by all their bytes.

Null and blank texts have no words and lose none; repeated rows count as separate places; an empty table gives an empty
one; a long text is worked on in overlapping pieces.  Other columns of ``keep`` pass through unchanged; where their names
clash with the operator's, the operator's replace them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange, ppm

WINDOW = 35
ANCHOR = 8
DEPTH = 2
SLICE_BITS = 18
PER_COUNTER = 20  # bytes of text


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` entries, by doubling."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(out) - (width - size)], out[width - size :])


class Windows(common.Words):
    """Words of some pieces of text, each with the words that follow up to ``width`` - 1, and the windows that start in a piece."""

    def __init__(self, pieces: list[bytes], limits: list[int], width: int):
        """``limits``: the bytes of each piece before the words that follow it."""
        super().__init__(pieces)
        self.width = width
        inside = np.arange(len(self)) - np.repeat(self.offsets[:-1], self.counts)
        borders = np.cumsum([0, *(len(x) + 1 for x in pieces)])[:-1]
        #: words of each piece, without those that follow
        self.own = np.searchsorted(self.starts, borders + limits) - self.offsets[:-1]
        base = np.cumsum(self.own) - self.own
        self.first = np.flatnonzero(inside + width <= np.repeat(self.counts, self.counts))
        #: for each window the number of its first word among all own words
        self.place = (np.repeat(base, self.counts) + inside)[self.first]
        self.is_own = inside < np.repeat(self.own, self.counts)

    def anchors(self, anchor: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each anchor run, and for each window of ``first`` its anchor's place."""
        runs = common.rolled(self.h[:, 0], anchor)
        if not len(self.first):
            return runs, self.first
        low = np.uint64((1 << 31) - 1)  # place in the low bits: among equal hashes the first counts
        least = sliding_least((runs & ~low) | np.arange(len(runs), dtype=np.uint64), self.width - anchor + 1)
        return runs, (least[self.first] & low).astype(np.int64)

    def windows(self, first: np.ndarray) -> np.ndarray:
        """128 bits of hash of each of these windows."""
        return np.stack([common.rolled(self.h[:, i], self.width)[first] for i in (0, 1)], axis=1) if len(first) else np.empty((0, 2), np.uint64)

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """The own words of each piece that aren't ``gone``, joined by one space."""
        n, stay = len(self.data), self.is_own.copy()
        stay[self.is_own] = ~gone
        some = np.flatnonzero(stay)
        edge = np.zeros(n + 1, np.int8)
        np.add.at(edge, self.starts[some], 1)
        np.add.at(edge, self.ends[some] + 1, -1)  # each word with one byte after it
        data = self.data.copy()
        data[self.ends] = 32
        mask = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        size = np.concatenate([[0], np.cumsum(np.where(stay, self.ends - self.starts + 1, 0))])[self.offsets]
        out = data[mask].tobytes()
        return [out[a : max(a, b - 1)] for a, b in zip(size[:-1].tolist(), size[1:].tolist(), strict=True)]


def spans(texts: list[bytes], width: int, size: int = 1 << 20) -> Iterator[tuple[list[int], Windows]]:
    """Runs of some ``size`` bytes: (the text of each piece, their windows)."""
    more = re.compile(rb"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){0,%d}" % (width - 1))
    owners, pieces, limits, n = [], [], [], 0
    for i, x in enumerate(texts):
        a = 0
        for piece in ppm.pieces(x, size):
            b = a + len(piece)
            owners.append(i)
            pieces.append(x[a : more.match(x, b).end()] if b < len(x) else piece)
            limits.append(len(piece))
            a, n = b, n + len(piece)
            if n >= size:
                yield owners, Windows(pieces, limits, width)
                owners, pieces, limits, n = [], [], [], 0
    if pieces:
        yield owners, Windows(pieces, limits, width)


class Spans:
    """The spans of a bundle with their anchors, made once if the bundle is of usual size, else anew each time."""

    def __init__(self, texts: list[bytes], width: int, anchor: int):
        self.make = lambda: ((owners, w, *w.anchors(anchor)) for owners, w in spans(texts, width))
        self.held = list(self.make()) if sum(map(len, texts)) <= 2 * common.BUNDLE_BYTES else None

    def __iter__(self) -> Iterator[tuple[list[int], Windows, np.ndarray, np.ndarray]]:
        return iter(self.make() if self.held is None else self.held)


def slots(runs: np.ndarray, row: int, bits: int) -> np.ndarray:
    return common.mixed(runs ^ np.uint64(0xA5A5A5A5 + 7919 * row)) >> np.uint64(64 - bits)


class Anchors:
    """The distinct anchors of a bundle, and what it asks about them: of shard -1 - (row, slice) whether its counters reach two."""

    def __init__(self, held: Spans, bits: int):
        found = [np.empty(0, np.uint64), *(runs[at[np.flatnonzero(np.diff(at, prepend=-1))]] for _, _, runs, at in held)]
        self.runs, places = np.unique(np.concatenate(found), return_counts=True)
        slice_bits = min(bits, SLICE_BITS)
        #: of each row, the number of each anchor's slot; and (row, shard, the slots' places in the row, in the slice, whether twice)
        self.numbers: list[np.ndarray] = []
        self.asked: list[tuple[int, int, int, int, np.ndarray, np.ndarray]] = []
        for row in range(DEPTH):
            slot, number = np.unique(slots(self.runs, row, bits), return_inverse=True)
            self.numbers.append(number)
            twice = np.bincount(number, weights=places, minlength=len(slot)) > 1
            part, low = (slot >> np.uint64(slice_bits)).astype(np.int64), (slot & np.uint64((1 << slice_bits) - 1)).astype("<u4")
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1)).tolist()
            self.asked += [(row, -1 - (row << bits - slice_bits) - int(part[a]), a, b, low[a:b], twice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def questions(self) -> Iterator[tuple[int, bytes]]:
        for _, shard, _, _, low, twice in self.asked:
            yield shard, exchange.dump(np.diff(low, prepend=low.dtype.type(0)), np.packbits(twice))

    def repeated(self, told: dict[int, bytes]) -> np.ndarray:
        """The anchors, ascending, that the sketch estimates at two or more."""
        high = [np.zeros(int(x.max()) + 1 if len(x) else 0, bool) for x in self.numbers]
        for row, shard, a, b, *_ in self.asked:
            high[row][a:b] = unpacked(told[shard], b - a)
        return self.runs[np.logical_and.reduce([x[n] for x, n in zip(high, self.numbers, strict=True)])]


def unpacked(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def merged(shard: int, bundles: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """A slice of the sketch: merges what the bundles add, and tells each which of its counters reach two."""
    counters, asked = np.zeros(1 << SLICE_BITS, np.uint8), []
    for x in data:
        step, twice = exchange.load(x)
        low = np.cumsum(step, dtype=np.int64)
        counters[low] = np.minimum(counters[low] + 1 + np.unpackbits(twice, count=len(low)), 2)
        asked.append(low)
    yield exchange.batch([(shard, b, np.packbits(counters[low] > 1).tobytes()) for b, low in zip(bundles, asked, strict=True)])


class Candidates:
    """The distinct windows of a bundle whose anchors may repeat, and what it asks about them: whether they do."""

    def __init__(self, held: Spans, anchors: np.ndarray, shards: int):
        found, self.places, base = [np.empty((0, 2), np.uint64)], [np.empty(0, np.int64)], 0
        for _, w, runs, at in held:
            hit = np.searchsorted(anchors, runs)
            may = anchors[np.minimum(hit, len(anchors) - 1)] == runs if len(anchors) else np.zeros(len(runs), bool)
            some = np.flatnonzero(may[at]) if len(at) else at
            found.append(w.windows(w.first[some]))
            self.places.append(w.place[some] + base)
            base += int(w.own.sum())
        h, self.places = np.concatenate(found), np.concatenate(self.places)
        order = np.lexsort((h[:, 1], h[:, 0]))
        h, self.places = h[order], self.places[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(axis=1)][: len(h)])
        self.n = np.diff(np.append(first, len(h)))
        self.h, shard = h[first], ((h[first, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        self.asked = [(int(shard[a]), a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def questions(self) -> Iterator[tuple[int, bytes]]:
        for shard, a, b in self.asked:
            yield shard, exchange.dump(self.h[a:b, 0], self.h[a:b, 1], np.packbits(self.n[a:b] > 1))

    def repeated(self, told: dict[int, bytes]) -> np.ndarray:
        """The first words of the windows that repeat, as numbers among all words of the bundle."""
        hit = np.zeros(len(self.h), bool)
        for shard, a, b in self.asked:
            hit[a:b] = unpacked(told[shard], b - a)
        return self.places[np.repeat(hit, self.n)]


def grouped(shard: int, bundles: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Groups the windows of a shard exactly, and tells each bundle which of its own start twice or more."""
    asked = [exchange.load(x) for x in data]
    h = np.stack([np.concatenate([x[i] for x in asked]) for i in (0, 1)], axis=1)
    n = np.concatenate([1 + np.unpackbits(x[2], count=len(x[0])).astype(np.int64) for x in asked])
    order = np.lexsort((h[:, 1], h[:, 0]))
    own = h[order]
    new = np.r_[True, (own[1:] != own[:-1]).any(axis=1)]
    total = np.add.reduceat(n[order], np.flatnonzero(new))
    twice = np.empty(len(h), bool)
    twice[order] = (total > 1)[np.cumsum(new) - 1]
    yield exchange.batch([(shard, b, np.packbits(x).tobytes()) for b, x in zip(bundles, ppm.split(twice, [len(x[0]) for x in asked]), strict=True)])


def dedup(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = WINDOW, anchor: int = ANCHOR, width_bits: int | None = None, stored: bool = True) -> DataFrame:
    """``keep`` columns, n_words, n_removed and kept_text: the words of each text, joined by one space, without
    those covered by a window of ``width`` words that also starts elsewhere.  ``width_bits``: of the sketch's rows, if not by
    the size of the texts; ``stored``: see ``common.Bundles``."""
    keep = tuple(c for c in keep if c not in ("n_words", "n_removed", "kept_text"))
    rows = docs.select(*keep, F.col(text).alias("__text"))
    bundles = common.Bundles(rows, "__text", stored=stored)
    size = bundles.bytes()
    bits, n_shards = width_bits or max(16, math.ceil(math.log2(size / PER_COUNTER + 1))), exchange.shards(size)
    held = lambda table: Spans(common.texts(table.column("__text")), width, anchor)

    adds = bundles.map(lambda number, table: exchange.rows(number, Anchors(held(table), bits).questions()), exchange.SCHEMA)
    high = common.checkpointed(exchange.each(exchange.dealt(adds, stored=False), merged))

    def ask(found: pa.Table, table: pa.Table) -> pa.Table:
        own, number = held(table), found.column("bundle")[0].as_py() if len(found) else 0
        asked = Candidates(own, Anchors(own, bits).repeated(exchange.told(found)), n_shards).questions()
        return pa.Table.from_batches(exchange.rows(number, asked), exchange.ARROW)

    windows = bundles.answered(high, ask, exchange.KIND)
    answers = high.union(exchange.each(exchange.dealt(windows, stored=False), grouped))
    kind = T.StructType([f for f in rows.schema.fields if f.name != "__text"] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def judge(found: pa.Table, table: pa.Table) -> pa.Table:
        own, told = held(table), exchange.told(found)
        first = Candidates(own, Anchors(own, bits).repeated(told), n_shards).repeated(told)
        n_words, removed = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        kept: list[list[bytes]] = [[] for _ in range(len(table))]
        first.sort()
        at, covered = 0, 0  # own words before the span; up to where the windows before it reach
        for owners, w, *_ in own:
            n = int(w.own.sum())
            starts = first[np.searchsorted(first, at) : np.searchsorted(first, at + n)] - at
            edge = np.zeros(n + width + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + width, -1)
            gone = np.cumsum(edge)[:n] > 0
            gone[: max(0, covered - at)] = True
            covered = max(covered, at + int(starts[-1]) + width if len(starts) else 0)
            at += n
            np.add.at(n_words, owners, w.own)
            np.add.at(removed, owners, np.diff(np.concatenate([[0], np.cumsum(gone)])[np.concatenate([[0], np.cumsum(w.own)])]))
            for i, x in zip(owners, w.kept(gone), strict=True):
                if x:
                    kept[i].append(x)
        columns = [pa.array(n_words), pa.array(removed), pa.array([b" ".join(x) for x in kept], pa.binary()).cast(pa.string())]
        return pa.table([*(table.column(c) for c in keep), *columns], names=kind.names)

    return bundles.answered(answers, judge, kind)
