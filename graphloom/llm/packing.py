"""Cost-balanced packing of token ids into sequences of a fixed length.

Each input partition is packed by itself, in blocks of at most ``block_tokens`` tokens, so nothing is
shuffled.  In a block every document gives its full sequences first; the rests are dealt, longest first, to
the sequence of lowest cost (linear plus quadratic in the length of each piece, as attention within a
document is) that has room for all of it; only if no sequence has is it cut, the lowest-cost one with any room taking
what fits.
The capacities of a block sum to its tokens: whole sequences, and powers of two for what is left, so no
token of padding is needed.

Null text is empty (only the end id); repeated rows are packed each on its own; an empty table gives no
piece; a very long text is cut over many sequences.  Of rests of equal length the earlier row comes first, of sequences
of equal cost the earlier one.  Columns other than the two that are named are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SEQUENCE = 1024
END_ID = 0
SPAN = 1 << 21  # bytes of text encoded together
LAST = 1e12  # beyond the cost of any whole sequence


class Encoder:
    """Ids of a byte-level BPE vocabulary.

    Before a single space between two non-spaces the vocabulary's pattern always starts anew.  So texts are cut
    there, each distinct piece of a span of texts is encoded once, and its ids are laid where it occurs.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # byte-level vocabularies print each byte as a character: visible ones as they are, the others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in piece): n for piece, n in spec["model"]["vocab"].items() if piece not in self.special}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.sizes = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Places of spaces between two characters that surely aren't white space."""
        at = np.flatnonzero(data == 32)
        at = at[(at >= 4) & (at + 1 < len(data))]
        before, after = data[at - 1], data[at + 1]
        visible = (before > 32) & (before < 127)
        for back, least in ((2, 0xC3), (3, 0xE4), (4, 0xF0)):  # a lead byte so far back, of no block that has white space
            lead = data[at - back]
            visible |= (before >= 128) & (lead >= least) & (lead < (0xE0, 0xF0, 0xF8)[back - 2])
        return at[visible & ((after > 32) & (after < 127) | (after >= 0xC3) & ~np.isin(after, (0xE1, 0xE2, 0xE3)))]

    def long(self, text: bytes, end_id: int, size: int = 1 << 21) -> np.ndarray:
        """The ids of one text of any length and the end id, worked out in pieces."""
        data, parts, a = np.frombuffer(text, np.uint8), [], 0
        while a < len(text):
            b = min(len(text), a + size)
            while b < len(text) and not len(cuts := self._cuts(data[a:b])):
                b = min(len(text), b + size)
            if b < len(text):
                b = a + int(cuts[-1])
            parts.append(self.batch([text[a:b]], end_id)[0][:-1])
            a = b
        return np.append(np.concatenate(parts), np.uint32(end_id))

    def batch(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and where each text's begin."""
        odd = {i: self.bpe.encode(x.decode(), allowed_special="all") for i, x in enumerate(texts) if any(s.encode() in x for s in self.special)}
        texts = [b"" if i in odd else x for i, x in enumerate(texts)]
        borders = np.cumsum([0, *map(len, texts)])
        blob = b"".join(texts)
        data = np.frombuffer(blob, np.uint8)
        border = np.zeros(len(data) + 1, bool)
        border[borders] = True
        all_starts, h = [], []
        for some in common.spans(texts, 2 << 20):  # hashes take 16 bytes for each byte, so a part at a time
            a, b = borders[some.start], borders[some.stop]
            cut = border[a:b].copy()
            cut[self._cuts(data[a:b])] = True
            own = np.flatnonzero(cut)
            h.append(common.hashed(data[a:b], own, np.append(own[1:], b - a).astype(np.int64)))
            all_starts.append(own + a)
        starts = np.concatenate(all_starts) if all_starts else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(data)).astype(np.int64) if len(starts) else starts
        first, number = common.distinct(np.concatenate(h)) if h else (starts, starts)
        for i in np.flatnonzero(ends - starts > 15).tolist():  # up to there hashes are of equal pieces only
            j = int(first[number[i]])
            if i != j and blob[starts[i] : ends[i]] != blob[starts[j] : ends[j]]:
                number[i], first = len(first), np.append(first, i)
        alone = border[starts[first]] | border[ends[first]]
        values, sizes = [], np.zeros(len(first) + 1, np.int64)
        if len(joint := first[~alone]):
            length = ends[joint] - starts[joint]
            where = np.repeat(starts[joint] - np.cumsum(length) + length, length) + np.arange(length.sum())
            ids = np.asarray(self.bpe.encode_to_numpy(data[where].tobytes().decode(), disallowed_special=()), np.uint32)
            upto = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(length)) + 1
            values.append(ids)
            sizes[:-1][~alone] = np.diff(upto, prepend=0)
        for i in np.flatnonzero(alone):
            values.append(np.array(self.bpe.encode_ordinary(blob[starts[first[i]] : ends[first[i]]].decode()), np.uint32))
            sizes[i] = len(values[-1])
        values.append(np.array([end_id], np.uint32))
        sizes[-1] = 1
        order = np.concatenate([np.flatnonzero(~alone), np.flatnonzero(alone), [len(first)]])  # as they lie in values
        begin = np.empty(len(sizes), np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        # the pieces of each text, then the end
        pieces = np.insert(number, np.searchsorted(starts, borders[1:]), len(first)) if len(texts) else np.empty(0, np.int64)
        n = sizes[pieces]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = np.concatenate(values)[np.repeat(begin[pieces] - upto[:-1], n) + np.arange(upto[-1])]
        offsets = np.concatenate([[0], upto[1:][pieces == len(first)]])
        if odd:
            parts = [ids[offsets[i] : offsets[i + 1]] if i not in odd else np.array([*odd[i], end_id], np.uint32) for i in range(len(texts))]
            ids, offsets = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return ids, offsets


def cost(length: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> float:
    """Estimated cost of a piece: the layers' linear part and attention's quadratic one."""
    return linear * length + quadratic * length * length


def capacities(tokens: int, sequence: int = SEQUENCE) -> list[int]:
    """Room of the sequences for ``tokens`` tokens: whole ones, then descending powers of two."""
    rest = tokens % sequence
    return [sequence] * (tokens // sequence) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


class Rooms:
    """Sequences by the room they have left: the cheapest with at least so much is found in a tree over the rooms."""

    def __init__(self, sequence: int):
        self.leaves = 1 << sequence.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(sequence + 1)]
        self.least = [(math.inf, -1, 0)] * (2 * self.leaves)

    def _top(self, room: int) -> None:
        at = self.leaves + room
        self.least[at] = (*self.heaps[room][0], room) if self.heaps[room] else (math.inf, -1, 0)
        while at > 1:
            at >>= 1
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def put(self, cost: float, i: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, i))
        self._top(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """(cost, sequence, room) of the cheapest with room of at least ``least``, which is taken out."""
        a, b, best = self.leaves + least, 2 * self.leaves - 1, (math.inf, -1, 0)
        while a <= b:
            if a & 1:
                best, a = min(best, self.least[a]), a + 1
            if not b & 1:
                best, b = min(best, self.least[b]), b - 1
            a, b = a >> 1, b >> 1
        if best[1] < 0:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._top(best[2])
        return best


def packed(lengths: list[int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece for documents of these lengths."""
    out, rests, n = [], [], 0
    for d, length in enumerate(lengths):
        for start in range(0, length - length % sequence, sequence):
            out.append((d, start, sequence, n, 0))
            n += 1
        if length % sequence:
            rests.append((length % sequence, d))
    rests.sort(key=lambda x: (-x[0], x[1]))
    room, rooms = capacities(sum(x for x, _ in rests), sequence), Rooms(sequence)
    for i, r in enumerate(room):
        rooms.put(0.0 if r == sequence else LAST, i, r)  # the short ones come last
    for length, d in rests:
        start = lengths[d] - length
        while length:
            c, i, left = rooms.take(length) or rooms.take(1)
            part = min(length, left)
            out.append((d, start, part, n + i, room[i] - left))
            start, length = start + part, length - part
            if left > part:
                rooms.put(c + cost(part), i, left - part)
    return out


@functools.lru_cache(maxsize=1)
def encoder_of(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def pack(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, block_tokens: int = 1 << 20, emit_ids: bool = False) -> DataFrame:
    """One row for each piece: the id column, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``emit_ids``."""
    kind = T.StructType([docs.schema[id_column], *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    if emit_ids:
        kind.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(vocabulary)
        first = TaskContext.get().partitionId() << 32
        keys, held, tokens = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, keys, held, tokens
            pieces = packed([len(x) for x in held], sequence)
            for at in range(0, len(pieces), 50_000):
                some = pieces[at : at + 50_000]
                columns = [
                    pa.array([keys[d] for d, *_ in some], id_type),
                    *(pa.array(x, pa.int64()) for x in ([s for _, s, *_ in some], [n for _, _, n, *_ in some])),
                    pa.array([zlib.crc32(held[d][s : s + n]) for d, s, n, *_ in some], pa.int64()),
                    pa.array([len(held[d]) for d, *_ in some], pa.int64()),
                    pa.array([first + q for *_, q, _ in some], pa.int64()),
                    pa.array([o for *_, o in some], pa.int64()),
                ]
                if emit_ids:
                    columns.append(pa.array([held[d][s : s + n].astype(np.int32) for d, s, n, *_ in some], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, kind.names)
            first += max((q for *_, q, _ in pieces), default=-1) + 1
            keys, held, tokens = [], [], 0

        for batch in batches:
            id_type = batch.column(0).type
            ids, own = batch.column(0).to_pylist(), common.texts(batch.column(1))
            for some in common.spans(own, SPAN):
                if len(own[some.start]) > SPAN:
                    made = [encoder.long(own[some.start], end_id)]
                else:
                    coded, offsets = encoder.batch(own[some], end_id)
                    made = [coded[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                keys += ids[some]
                held += made
                tokens += sum(map(len, made))
                if tokens >= block_tokens:
                    yield from flush()
        if keys:
            yield from flush()

    return docs.select(id_column, text).mapInArrow(run, kind)
