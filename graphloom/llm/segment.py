"""Sampling of segmentations into a vocabulary's pieces without replacement, and decoding.

A text's lattice has a node at each byte and an edge for each piece that matches there (and for each byte of a
character that is no piece).  A piece's weight follows its rank in the vocabulary, ``-log(rank + 2.7)`` times
``alpha``; the lattice then has a distribution over whole segmentations, whose backward sums say how much mass
lies behind each node.  Perturbed A*: the whole set of segmentations has a Gumbel-perturbed maximum; its argument
is an exact sample.  What is left after taking it splits into one region for each edge of the path (same path up to
there, another edge there), each with a Gumbel value truncated at the value just taken; a heap gives the next best
region, from which the next segmentation comes.  So the first ``k`` taken are the Gumbel top-k: distinct, drawn
without replacement.  The best region left gives the threshold for inclusion scores ``1 - exp(-exp(log_prob -
threshold))``.  Randomness is seeded by the row's key, so a row gives the same samples wherever it is computed.

Between two characters that stand side by side in no piece (such as a letter and a space) the lattice has a node
that every path meets, so a text's lattice is the chain of the lattices of the words between such places; each
distinct word of some 2 MB of texts is built once.

Null and empty texts have one segmentation, of no pieces; a text with fewer than k gives all it has.  Repeated
rows of one key get the same samples; a null key is a key of its own.  The character U+2581 in a text is encoded by its
bytes, so that every text comes back as it was.  An empty table gives an empty one; a text of any length is segmented
whole, which takes some 70 bytes of memory for each of its own.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLES = 3
ALPHA = 1.0
MARK = "▁"


SPAN = 1 << 18  # nodes whose edges are made together
SHARED = 1 << 21  # bytes of texts whose distinct words are built once
TOGETHER = 1 << 19  # bytes of texts that are sampled in step
STOP = 256  # in place of a byte: no piece goes on here
FIRST = 64  # places of a path whose masses bound those of its best regions


class Vocabulary:
    """The pieces of a SentencePiece model as bytes, with weights by rank."""

    def __init__(self, model: str, alpha: float = ALPHA):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=model)
        n = processor.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        pieces = {}
        for i in range(n):
            if processor.is_byte(i):
                b = int(processor.id_to_piece(i)[1:-1], 16)
                self.byte_ids[b], self.bytes[i] = i, bytes([b])
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.bytes[i] = processor.id_to_piece(i).replace(MARK, " ").encode()
                pieces[i] = self.bytes[i]
        rank = {i: r for r, i in enumerate(sorted(pieces, key=lambda i: (-processor.get_score(i), i)))}
        self.weight = np.full(n, -math.log(n + 2.7) * alpha)
        for i, r in rank.items():
            self.weight[i] = -math.log(r + 2.7) * alpha
        self._trie(pieces)
        #: whether two bytes stand side by side in some piece
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[[a << 8 | b for x in pieces.values() for a, b in zip(x, x[1:], strict=False)]] = True
        self.sizes = np.array(list(map(len, self.bytes)), np.int64)
        self.data, self.begins = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.sizes) - self.sizes
        self.array = pa.array(self.bytes, pa.large_binary())

    def _trie(self, pieces: dict[int, bytes]) -> None:
        """The pieces as a double array: a state is a place, its child by byte ``b`` is at ``base[state] + b`` if that place's ``parent`` is the state."""
        children: list[dict[int, int]] = [{}]
        last: dict[int, int] = {}
        for i, x in pieces.items():
            state = 0
            for b in x:
                state = children[state].setdefault(b, len(children))
                if state == len(children):
                    children.append({})
            last[state] = i
        size = 1 << (2 * len(children)).bit_length()
        taken, at = bytearray(size + 2 * STOP + 1), 0
        place, base = [0] * len(children), [0] * len(children)
        for state in sorted(range(len(children)), key=lambda x: -len(children[x])):
            own = children[state]
            while own and any(taken[STOP + 1 + at + b] for b in own):
                at = (at + 40503) % size
            base[state] = STOP + 1 + at if own else 0  # nobody's places
            for b, child in own.items():
                place[child] = base[state] + b
                taken[place[child]] = 1
        self.base, self.parent, self.piece = np.zeros(len(taken), np.int32), np.full(len(taken), -1, np.int32), np.full(len(taken), -1, np.int32)
        self.base[place] = base
        for state, own in enumerate(children):
            for child in own.values():
                self.parent[place[child]] = place[state]
        for state, i in last.items():
            self.piece[place[state]] = i

    def matches(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, ids) of the pieces in bytes (as integers, the last of them ``STOP``), by length."""
        at, state, length = np.arange(len(data), dtype=np.int32), np.zeros(len(data), np.int32), 0
        while len(at):
            state, before = self.base[state] + data[at + length], state
            on = np.flatnonzero(self.parent[state] == before)
            at, state, length = at[on], state[on], length + 1
            ids = self.piece[state]
            hit = np.flatnonzero(ids >= 0)
            yield length, at[hit], ids[hit]

    def joined(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of ids, one after the other, and where each begins and the last ends."""
        if not len(ids):
            return memoryview(b""), np.zeros(1, np.int64)
        own = self.array.take(pa.array(ids))
        return memoryview(own.buffers()[2]), np.frombuffer(own.buffers()[1], np.int64)[: len(ids) + 1]

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """The text of ids, without the blank that encoding puts first."""
        ids = np.asarray(ids, np.int64)
        size = self.sizes[ids]
        upto = np.cumsum(size)
        if not len(ids):
            return b""
        return self.data[np.repeat(self.begins[ids] - upto + size, size) + np.arange(upto[-1])].tobytes()[1:]


@functools.lru_cache(maxsize=1)
def vocabulary_of(model: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(model, alpha)


def decode(rows: DataFrame, model: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the text of each row's ids (null for null, and where an id is null or no piece's)."""
    keep = tuple(c for c in keep if c != text)
    kind = T.StructType([*(rows.schema[c] for c in keep), T.StructField(text, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(model)
        for batch in batches:
            own = batch.column(len(keep)).to_pylist()
            sound = [x is not None and all(i is not None and 0 <= i < len(v.sizes) for i in x) for x in own]
            out = [v.decode(x).decode("utf-8", "replace") if ok else None for x, ok in zip(own, sound, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.string())], kind.names)

    return rows.select(*keep, ids).mapInArrow(run, kind)


class Lattice:
    """The lattices of the distinct words of some texts (each text with a blank put first)."""

    def __init__(self, texts: list[bytes], vocabulary: Vocabulary):
        self.v = vocabulary
        texts = [b" " + x if x else b"" for x in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        borders = np.cumsum([0, *map(len, texts)])
        cut = np.zeros(len(data) + 1, bool)
        cut[borders] = True
        cut[1:-1] |= ~vocabulary.pairs[data[:-1].astype(np.int64) << 8 | data[1:]] & (data[1:] & 0xC0 != 0x80)
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data)).astype(np.int64) if len(starts) else starts
        first, self.number = distinct(common.hashed(data, starts, ends))
        blob = b"".join(texts)
        for i in np.flatnonzero(ends - starts > 15).tolist():  # up to there hashes are of equal words only
            j = int(first[self.number[i]])
            if i != j and blob[starts[i] : ends[i]] != blob[starts[j] : ends[j]]:
                self.number[i], first = len(first), np.append(first, i)
        self.offsets = np.searchsorted(starts, borders)
        size = ends[first] - starts[first]
        begins = np.cumsum(size + 1) - size - 1  # nodes of a word: its bytes and its end
        made = []
        runs = np.flatnonzero(np.diff(begins // SPAN, prepend=-1, append=-1))
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            begin, own = int(begins[a]), size[a:b]
            left = np.repeat(begins[a:b] + own - begin, own + 1) - np.arange(int(own.sum()) + b - a)  # bytes to the word's end
            bytes_ = np.full(len(left), 10, np.uint8)
            bytes_[left > 0] = data[np.repeat(starts[first[a:b]] - np.cumsum(own) + own, own) + np.arange(own.sum())]
            made.append(self._edges(bytes_, left, begin))
        count, dest, self.ids, self.log, self.upto = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.empty(0, t) for t in "iiidQ")
        self.first_edge = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.begin = self.first_edge[begins]  # first edge of each word
        self.next = np.where(count[dest] > 0, self.first_edge[dest], np.int32(-1))  # first edge of the node where an edge ends; none at the word's end
        self.start = np.repeat(np.arange(len(count), dtype=np.int32), count)
        self.alone = np.repeat(count <= 1, count)  # edges beside which their node has no other

    def _edges(self, data: np.ndarray, left: np.ndarray, begin: int) -> tuple[np.ndarray, ...]:
        """Of the nodes of some words, the first of which is ``begin``: how many edges each has, and the edges' ends, ids, logs of their conditional
        probability at the node, and sums of these probabilities up to each edge within the node (as 53-bit integers, exact wherever a word lies)."""
        v, n = self.v, len(data)
        inside = left > 0
        lead = np.flatnonzero(data & 0xC0 != 0x80)
        size = np.zeros(n, np.int64)  # bytes of the character that begins here, well-formed or not
        size[lead] = np.diff(lead, append=n)
        alone = inside & (size > 0)  # beginnings of characters that are no piece
        found = [(1, np.empty(0, np.int64), np.empty(0, np.int32))]
        for length, p, ids in v.matches(np.where(inside, data, np.int32(STOP))):
            found.append((length, p, ids))
            if length <= 4:
                alone[p[size[p] == length]] = False
        p = np.flatnonzero(alone)
        size = size[p]
        p = np.repeat(p - np.cumsum(size) + size, size) + np.arange(size.sum())
        found[0] = (1, p, v.byte_ids[data[p]])
        count = np.zeros(n, np.int32)
        for _, p, _ in found:
            count[p] += 1
        nodes = np.argsort(left.astype(np.min_scalar_type(left.max())), kind="stable")  # by the bytes left, so that what lies behind is known
        nodes = nodes[count[nodes] > 0]
        own = count[nodes]
        heads = np.concatenate([[0], np.cumsum(own)])
        free = np.empty(n, np.int64)
        free[nodes] = heads[:-1]
        ids, length = np.empty(heads[-1], np.int32), np.empty(heads[-1], np.int32)
        for n_bytes, p, its in found:
            to = free[p]
            ids[to], length[to] = its, n_bytes
            free[p] = to + 1
        del free
        start = np.repeat(nodes, own)
        dest = start + length
        back = np.full(n, -np.inf)
        back[~inside] = 0
        value = v.weight[ids]
        cuts = np.flatnonzero(np.diff(left[nodes], prepend=-1, append=-1)).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = heads[i], heads[j]
            x = value[a:b]
            x += back[dest[a:b]]
            at = heads[i:j] - a
            top = np.maximum.reduceat(x, at)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                back[nodes[i:j]] = safe + np.log(np.add.reduceat(np.exp(x - np.repeat(safe, own[i:j])), at))
        live = np.isfinite(value)
        if not live.all():
            start, dest, length, ids, value = start[live], dest[live], length[live], ids[live], value[live]
            count = np.bincount(start, minlength=n).astype(np.int32)
        ends = np.cumsum(count)
        begins = np.empty(n, np.int64)  # of the edges of each node, as they are
        begins[nodes] = np.cumsum(count[nodes]) - count[nodes]
        rank = np.clip(np.round((back[start] - value) * 4096), 0, (1 << 20) - 1).astype(np.int64)
        bits = len(found).bit_length()
        order = np.sort(start << 20 + bits | rank << bits | np.arange(len(start)) - begins[start])  # a node's likeliest edge first
        order = (order & (1 << bits) - 1) + np.repeat(begins[count > 0], count[count > 0])
        log = value[order] - np.repeat(back, count)
        upto = np.cumsum(np.round(np.exp(log) * 2.0**53).astype(np.uint64))  # modulo 2^64, as are their differences
        upto -= np.repeat(np.concatenate([np.zeros(1, np.uint64), upto])[ends - count], count)
        upto[ends[count > 0] - 1] = 1 << 60  # the last edge takes what rounding leaves
        return count, (dest[order] + begin).astype(np.int32), ids[order], log, upto

    def walk(self, edge: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one sampled path from each node, given by its first edge, to its word's end, one after the other, and how many each has."""
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        token, count = np.arange(len(edge), dtype=np.int32), np.zeros(len(edge), np.int64)
        while True:
            on = np.flatnonzero(edge >= 0)
            if len(on) < len(edge):
                edge, token, seed = edge[on], token[on], seed[on]
            if not len(edge):
                break
            u = drawn(seed, len(steps))
            miss = np.flatnonzero(u >= self.upto[edge])
            while len(miss):
                edge[miss] += 1
                miss = miss[u[miss] >= self.upto[edge[miss]]]
            steps.append((token, edge))
            count[token] += 1
            edge = self.next[edge]
        out, offset = np.empty(int(count.sum()), np.int32), np.cumsum(count) - count
        for i, (token, edge) in enumerate(steps):
            out[offset[token] + i] = edge
        return out, count

    def samples(self, seeds: np.ndarray, k: int, begin: int = 0) -> list[list[tuple[float, float, float, np.ndarray]]]:
        """For each text from ``begin`` on, one a seed, (log_prob, perturbed log_prob, log of inclusion, edges) of the Gumbel top-k segmentations.

        All these texts go in step: in each round every text takes its best region, and the paths are walked together.
        """
        offsets = self.offsets[begin : begin + len(seeds) + 1]
        n_words = np.diff(offsets)
        live = np.flatnonzero(n_words)
        taken: list[list] = [[] for _ in n_words]
        heaps: list[list] = [[] for _ in n_words]
        turn = 0
        # the round's regions: text, path and its words up to the place t, the edges barred there, the one taken instead, the mass before
        popped = [(int(i), None, None, 0, (), None) for i in live]
        value = -np.log(-np.log(uniform(seeds[live], -1)))
        for number in range(k):
            if not popped:
                break
            text = np.array([x[0] for x in popped])
            word = np.array([0 if x[1] is None else int(x[2][x[3]]) for x in popped])
            n = n_words[text] - word
            first = np.cumsum(n) - n
            token = np.repeat(offsets[:-1][text] + word - first, n) + np.arange(n.sum())
            inside = token - np.repeat(offsets[:-1][text], n)
            entry = self.begin[self.number[token]]
            for i, x in enumerate(popped):
                if x[1] is not None:
                    entry[first[i]] = self.next[x[5]]
            mixed_in = common.mixed(np.repeat(seeds[text], n) + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            edges, count = self.walk(entry, common.mixed(mixed_in + np.uint64(number + 1)))
            words = np.repeat(inside, count)
            cuts = np.concatenate([[0], np.cumsum(count)])[np.append(first, len(count))]
            paths, places = [], []
            for i, (_, path, at, t, _, edge) in enumerate(popped):
                new, its = edges[cuts[i] : cuts[i + 1]], words[cuts[i] : cuts[i + 1]]
                paths.append(new if path is None else np.concatenate([path[:t], np.array([edge], np.int32), new]))
                places.append(its if path is None else np.concatenate([at[: t + 1], its]))
            size = np.array([len(x) for x in paths])
            start = np.cumsum(size) - size
            flat = np.concatenate(paths)
            logs = self.log[flat]
            before = np.zeros(len(flat) + 1)
            for a, b in zip(start.tolist(), (start + size).tolist(), strict=True):  # each text's own sums, whatever stands beside it
                np.cumsum(logs[a:b], out=before[a + 1 : b + 1])
            total = before[start + size]
            before[start] = 0
            where, its = self._candidates(flat, before, start, size, np.array([x[3] for x in popped]), k - number)
            owner = np.repeat(np.arange(len(popped)), its)
            place = where - start[owner]
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                mass = before[where] + np.log(np.maximum(-np.expm1(logs[where]), 0))  # of the edges not taken at each node
                mass[self.alone[flat[where]] | (place < np.repeat([x[3] for x in popped], its))] = -np.inf
                for i, x in enumerate(popped):
                    if x[4]:
                        at = int(start[i]) + x[3]
                        free = self._free(int(self.start[flat[at]]), (*x[4], int(flat[at])))
                        mass[np.searchsorted(where, at)] = before[at] + math.log(sum(p for _, p in free)) if free else -np.inf
                seed = common.mixed(seeds[text][owner] + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                u = uniform(common.mixed(seed + np.uint64(number + 1)), -2)
                g = mass - np.log(-np.log(u))  # Gumbel of location mass
            for i, x in enumerate(popped):
                taken[x[0]].append((float(total[i]), float(value[i]), paths[i]))
            for _ in range(k - number):  # the best regions of each text; more can't come to their turn
                top = np.maximum.reduceat(g, np.cumsum(its) - its)
                hit = np.flatnonzero(g == np.repeat(top, its))
                hit = hit[np.diff(owner[hit], prepend=-1) > 0]
                below = -np.logaddexp(-value[owner[hit]], -g[hit])  # truncated, which leaves their order as it is
                for at, i, t, bound in zip(hit.tolist(), owner[hit].tolist(), place[hit].tolist(), below.tolist(), strict=True):
                    if g[at] > -np.inf:
                        barred = (int(paths[i][t]),)
                        if t == popped[i][3]:
                            barred = (*popped[i][4], *barred)
                        turn += 1
                        heapq.heappush(heaps[popped[i][0]], (-bound, turn, paths[i], places[i], t, barred))
                g[hit] = -np.inf
            if number == k - 1:
                break
            following, values = [], []
            draw = uniform(seeds[text], -3 - number)
            for i, x in enumerate(popped):
                if heaps[x[0]]:
                    negative, _, path, at, t, barred = heapq.heappop(heaps[x[0]])
                    free = self._free(int(self.start[path[t]]), barred)
                    left = draw[i] * sum(p for _, p in free)
                    for edge, p in free:
                        left -= p
                        if left < 0:
                            break
                    following.append((x[0], path, at, t, barred, edge))
                    values.append(-negative)
            popped, value = following, np.array(values)
        out = []
        for i, own in enumerate(taken):
            limit = -heaps[i][0][0] if heaps[i] else -math.inf
            out.append([(p, g, included(p, limit), edges) for p, g, edges in own] or [(0.0, 0.0, 0.0, np.empty(0, np.int64))])
        return out

    def _candidates(self, flat: np.ndarray, before: np.ndarray, start: np.ndarray, size: np.ndarray, t: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of paths, one path after the other, where one of its ``most`` best regions can begin, and how many each path has.

        A standard Gumbel value drawn here is between -3.7 and 37.5.  So with the ``most``-th greatest mass of a path's first places after ``t``, no
        region of a mass less by 42 can be among the best; and a region's mass is at most ``before``, which falls along the path.
        """
        near = t[:, None] + 1 + np.arange(FIRST)
        at = np.minimum(near, size[:, None] - 1) + start[:, None]
        with np.errstate(divide="ignore"):
            mass = before[at] + np.log(np.maximum(-np.expm1(self.log[flat[at]]), 0))
        mass[self.alone[flat[at]] | (near >= size[:, None])] = -np.inf
        least = np.sort(mass, axis=1)[:, -most] - 42 if most <= FIRST else np.full(len(t), -np.inf)
        on = before[:-1] >= np.repeat(least, size)
        return np.flatnonzero(on), np.add.reduceat(on, start, dtype=np.int64)

    def _free(self, node: int, barred: tuple[int, ...]) -> list[tuple[int, float]]:
        """(edge, probability) of a node's edges that aren't barred."""
        return [(e, math.exp(self.log[e])) for e in range(int(self.first_edge[node]), int(self.first_edge[node + 1])) if e not in barred]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``common.distinct``, numbered by first place, so that frequent words stand together."""
    number = pa.array(h[:, 0]).dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.diff(np.maximum.accumulate(number), prepend=-1)) if len(number) else np.empty(0, np.int64)
    return (first, number.copy()) if (h[first[number], 1] == h[:, 1]).all() else common.distinct(h)


def drawn(seed: np.ndarray, purpose: int) -> np.ndarray:
    """Integers of 53 bits that depend on the seeds and the purpose alone."""
    return common.mixed(seed ^ np.uint64((purpose * 0xAEF17502108EF2D9 + 0x632BE59BD9B4E019) % (1 << 64))) >> np.uint64(11)


def uniform(seed: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers between 0 and 1, neither included, that depend on the seeds and the purpose alone."""
    return (drawn(seed, purpose).astype(np.float64) + 0.5) * 2.0**-53


def included(log_prob: float, limit: float) -> float:
    """log of the inclusion score 1 - exp(-exp(log_prob - limit))."""
    if not math.isfinite(limit):
        return 0.0
    above = log_prob - limit
    return above if above < -30 else math.log(-math.expm1(-math.exp(min(above, 5.0))))


def sampled(texts: list[bytes], seeds: np.ndarray, vocabulary: Vocabulary, k: int) -> Iterator[tuple[slice, Lattice, list[list[tuple[float, float, float, np.ndarray]]]]]:
    """Runs of texts, the lattice of their words and those of the runs beside them, and their samples."""
    for group in common.spans(texts, SHARED):
        lattice = Lattice(texts[group], vocabulary)
        for some in common.spans(texts[group], TOGETHER):
            own = slice(group.start + some.start, group.start + some.stop)
            yield own, lattice, lattice.samples(seeds[own], k, some.start)


def sample(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = SAMPLES, seed: int = 0, alpha: float = ALPHA, emit_ids: bool = True) -> DataFrame:
    """``keep`` columns and, for each sampled segmentation: sample (from 1, best perturbed value first), n_pieces, ids_crc32
    (unsigned, of little-endian 32-bit ids), log_prob, log_inclusion (of its inclusion score), round_trip (whether the ids decode to the text), and ids if ``emit_ids``."""
    new = {"sample": T.IntegerType(), "n_pieces": T.LongType(), "ids_crc32": T.LongType(), "log_prob": T.DoubleType(), "log_inclusion": T.DoubleType(), "round_trip": T.BooleanType()}
    if emit_ids:
        new["ids"] = T.ArrayType(T.IntegerType())
    keep = tuple(c for c in keep if c not in new)
    rows = docs.select(*keep, F.col(text).alias("__text"), F.col(key).cast("string").alias("__key"))
    kind = T.StructType([f for f in rows.schema.fields if not f.name.startswith("__")] + [T.StructField(c, t) for c, t in new.items()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary_of(model, alpha)
        for batch in batches:
            own = common.texts(batch.column(len(keep)))
            keys = batch.column(len(keep) + 1).to_pylist()
            seeds = np.array([xxhash.xxh3_64_intdigest("\1" if name is None else name, seed) for name in keys], np.uint64)
            for some, lattice, made in sampled(own, seeds, v, k):
                out = [(i, rank, p, q) for i, found in enumerate(made, some.start) for rank, (p, _, q, _) in enumerate(found, 1)]
                paths = [edges for found in made for *_, edges in found]
                upto = np.cumsum([0, *map(len, paths)])
                ids = lattice.ids[np.concatenate(paths)].astype("<i4")
                held, (text, begins) = memoryview(ids.tobytes()), v.joined(ids)
                cuts, borders = upto.tolist(), begins[upto].tolist()
                where, rank, p, q = zip(*out, strict=True)
                crc = [zlib.crc32(held[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                same = [text[a + 1 : b].tobytes() == own[i] for i, a, b in zip(where, borders[:-1], borders[1:], strict=True)]
                arrays = [pa.array(c, t) for c, t in ((rank, pa.int32()), (np.diff(upto), pa.int64()), (crc, pa.int64()), (p, pa.float64()), (q, pa.float64()), (same, pa.bool_()))]
                if emit_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids.astype(np.int32))))
                taken = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in range(len(keep))), *arrays], kind.names)

    return rows.mapInArrow(run, kind)
