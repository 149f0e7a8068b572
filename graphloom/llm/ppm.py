"""Prediction by partial matching over bytes, and the base model of tokens it is held against.

A *pair* is ``ORDER`` bytes of context and the byte after them, packed with the nearest byte of context first, so that
the contexts of a trie node are a run of sorted pairs.  A byte is coded at the longest context known; if it was never
seen there, an escape is coded (method D: half a count for each distinct follower) and the next shorter context is
tried with the followers of the longer one excluded; below order 0 the bytes not excluded are equally likely.  With
update exclusion, a byte counts in a shorter context once for each longer one it follows.  Since every follower of a context also follows its suffix, what is excluded at each level is a fixed sum, so a byte's code
length depends on its pair alone and is worked out once for each distinct pair.

Pretrained: counts are gathered from all training texts and all stay.  The trie is sharded by the last ``BASE`` + 1 bytes
of context; each bundle asks the shards about its distinct pairs and tokens and tells them how often its training texts
have these (``exchange``).  Only the counts of the ``BASE`` + 1 last bytes, 256 ** (BASE + 1) at most, are of all shards
and broadcast.  Adaptive: the trie starts empty for each text and learns as it goes, on the worker.

Null text is empty: one end symbol.  Repeated rows are scored each by itself, ids play no part in scores; an
empty table gives an empty one; without training texts every byte is equally likely; a text of any length is read whole,
in overlapping stretches.  ``keep`` columns pass through; the operator's own columns replace any of the same name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange

ORDER = 6
BASE = 2
END = 0xFF  # never a byte of UTF-8: before and after each text
SYMBOLS = 256
STRETCH = 1 << 20
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def stretches(texts: list[bytes], order: int = ORDER, size: int = STRETCH) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Runs of some ``size`` bytes of (owners, stretches): each text and its end, cut where it is long; a stretch has ``order`` bytes of context first."""
    pad, owners, held, n = bytes([END]) * order, [], [], 0
    for i, x in enumerate(texts):
        whole = pad + x + bytes([END])
        for a in range(0, len(x) + 1, size):
            held.append(whole[a : a + size + order])
            owners.append(i)
            n += len(held[-1])
            if n >= size:
                yield np.array(owners), held
                owners, held, n = [], [], 0
    if held:
        yield np.array(owners), held


def pairs(held: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of some stretches, and how many each has."""
    data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
    n, size = len(data) - order, np.array([len(x) - order for x in held])
    key = data[order:].copy()
    for j in range(1, order + 1):
        key |= data[order - j : order - j + n] << np.uint64(8 * (order + 1 - j))
    inside = np.ones(n, bool)
    upto = np.cumsum(size + order)[:-1] - order
    for j in range(order):
        inside[upto + j] = False
    return key[inside], size


def counted(texts: list[bytes], learned: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some texts, ascending, and how often those to learn from have them."""
    keys, n = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for use in (True, False):
        for _, held in stretches([x for x, y in zip(texts, learned.tolist(), strict=True) if y == use], order, 2 * STRETCH):
            own = pairs(held, order)[0]
            own.sort()
            first = np.flatnonzero(np.diff(own, prepend=~own[:1]))
            keys.append(own[first])
            n.append(np.diff(np.append(first, len(own))) * use)
    return summed(np.concatenate(keys), np.concatenate(n), numbered=False)[:2]


def summed(keys: np.ndarray, n: np.ndarray, numbered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(distinct keys, sum of their n, number of each row's key)."""
    order = np.argsort(keys, kind="stable")
    own, number = keys[order], None
    new = np.diff(own, prepend=~own[:1]) != 0
    if numbered:
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return own[first], np.add.reduceat(n[order], first) if len(first) else n[:0], number


def shorter(keys: np.ndarray) -> np.ndarray:
    """Pairs without their farthest byte of context."""
    return keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(0xFF)


class Level:
    """The pairs of one order, ascending, with their counts, those of their contexts, and what an escape from there comes to."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, below: Level | None = None, link: np.ndarray | None = None):
        """``link``: the place of each pair's suffix in ``below``."""
        self.keys, self.n = keys, n
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
        size, seen = np.diff(np.append(first, len(keys))), n > 0
        over = lambda x: np.repeat(np.add.reduceat(x, first), size) if len(first) else x
        self.total, self.kinds = over(n), over(seen.astype(np.int64))
        if below is None:
            escaped, unknown = -np.log10(np.maximum(SYMBOLS - self.kinds, 1)), np.full(len(keys), -math.log10(SYMBOLS))
        else:
            n_below, unknown = below.n[link], below.log[link]
            left = below.total[link] - over(np.where(seen, n_below, 0))
            escaped = np.where(n_below > 0, np.log10(np.maximum(n_below - 0.5, 0.5) / np.maximum(left, 1)), escape(left, below.kinds[link] - self.kinds) + below.escaped[link])
        self.escaped = np.where(seen, 0, escaped)
        at_hand = np.log10(np.maximum(n - 0.5, 0.5) / np.maximum(self.total, 1))
        self.log = np.where(self.total == 0, unknown, np.where(seen, at_hand, escape(self.total, self.kinds) + self.escaped))


def escape(total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log10 of the probability of an escape."""
    return np.where(kinds < 2 * total, np.log10(np.maximum(kinds / 2, 0.5) / np.maximum(total, 1)), 0.0)


def base_level(keys: np.ndarray, n: np.ndarray, base: int = BASE) -> Level:
    """The level of order ``base`` from its counts."""
    levels = [(keys, n, None)]
    for _ in range(base):
        levels.append(summed(shorter(levels[-1][0]), (levels[-1][1] > 0).astype(np.int64)))
    own = link = None
    for keys, n, number in reversed(levels):
        own, link = Level(keys, n, own, link), number
    return own


def probabilities(keys: np.ndarray, n: np.ndarray, bottom: Level, order: int = ORDER, base: int = BASE) -> np.ndarray:
    """log10 of the probability of each pair's byte after its context, of all pairs of some shards (keys ascending, n: training counts)."""
    levels = [(keys, n, None)]
    for _ in range(order - base - 1):
        levels.append(summed(shorter(levels[-1][0]), (levels[-1][1] > 0).astype(np.int64)))
    own, link = bottom, np.searchsorted(bottom.keys, shorter(levels[-1][0]))
    for keys, n, number in reversed(levels):
        own, link = Level(keys, n, own, link), number
    return own.log


def adaptive(text: bytes, order: int = ORDER) -> float:
    """log10 of the probability of a text and its end by a trie that starts empty and learns each byte after coding it."""
    followers: dict[bytes, dict[int, int]] = {}
    history, total = bytes([END]) * order, 0.0
    for symbol in text + bytes([END]):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = followers.get(history[order - k :], {})
            left = {s: c for s, c in seen.items() if s not in excluded}
            n = sum(left.values())
            if symbol in left:
                total += math.log10((left[symbol] - 0.5) / n)
                break
            if left:
                total += math.log10(len(left) / (2 * n))
            excluded |= seen.keys()
        else:
            total -= math.log10(SYMBOLS - len(excluded))
        for k in range(order, -1, -1):
            own = followers.setdefault(history[order - k :], {})
            own[symbol] = own.get(symbol, 0) + 1
            if own[symbol] > 1:
                break
        history = (history + bytes([symbol]))[1:] if order else b""
    return total


def pieces(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text, cut at blanks into pieces of some ``size``; a longer word is a piece of its own."""
    a = 0
    while len(text) - a > size:
        b = next((m.start() for m in BLANK.finditer(text, a + size)), len(text))
        yield text[a:b]
        a = b
    yield text[a:]


class Asked:
    """What a bundle asks: of shards from 0 on about its pairs, of those from -1 down about its tokens."""

    def __init__(self, texts: list[bytes], learned: np.ndarray, shards: int, order: int, pairs: bool = True, tokens: bool = True):
        self.texts, self.order = texts, order
        count: Counter[bytes] = Counter()
        for x, use in zip(texts, learned.tolist(), strict=True) if tokens else ():
            for part in pieces(x):
                count.update(part.split()) if use else count.update(dict.fromkeys(part.split(), 0))
        by: dict[int, list[bytes]] = {}
        for word in count:
            by.setdefault(-1 - zlib.crc32(word) % shards, []).append(word)
        self.tokens, self.count = by, count
        self.keys = np.empty(0, np.uint64)
        if pairs:
            self.keys, self.n = counted(texts, learned, order)
            self.place, self.asked, self.borders = exchange.placed(self.keys >> np.uint64(8 * (order - BASE)), shards)

    def questions(self) -> Iterator[tuple[int, bytes]]:
        for shard, words in self.tokens.items():
            yield shard, exchange.dump(np.frombuffer(b" ".join(words), np.uint8), np.array([self.count[w] for w in words], "<u4"))
        if len(self.keys):
            for shard, a, b in zip(self.asked.tolist(), self.borders[:-1], self.borders[1:], strict=True):
                some = self.place[a:b]
                yield shard, exchange.dump(self.keys[some], self.n[some].astype("<u4"))

    def counts(self, told: dict[int, bytes]) -> dict[bytes, int]:
        """How often the training texts have each token."""
        return {w: n for shard, words in self.tokens.items() for w, n in zip(words, exchange.load(told[shard])[0].tolist(), strict=True)}

    def logs(self, told: dict[int, bytes]) -> np.ndarray:
        """log10 of the probability of each text and its end, of its pairs' answers."""
        log, out = np.empty(len(self.keys)), np.zeros(len(self.texts))
        for shard, a, b in zip(self.asked.tolist(), self.borders[:-1], self.borders[1:], strict=True):
            log[self.place[a:b]] = exchange.load(told[shard])[0]
        places = common.Places(self.keys)
        for owners, held in stretches(self.texts, self.order):
            own, size = pairs(held, self.order)
            upto = np.concatenate([[0], np.cumsum(log[places.of(own)])])
            np.add.at(out, owners, np.diff(upto[np.concatenate([[0], np.cumsum(size)])]))
        return out


def together(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of a shard's questions about pairs: the distinct pairs, their counts, the number of each one asked about, and how many each question has."""
    asked = [exchange.load(x) for x in data]
    keys, n, number = summed(np.concatenate([x[0] for x in asked]), np.concatenate([x[1] for x in asked]).astype(np.int64))
    return keys, n, number, [len(x[0]) for x in asked]


def split(values: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1])


def shared(data: list[bytes]) -> tuple[list[list[bytes]], Counter[bytes]]:
    """Of a shard's questions about tokens: each one's tokens, and how often all training texts have them."""
    each, count = [], Counter()
    for x in data:
        joined, n = exchange.load(x)
        each.append(joined.tobytes().split(b" "))
        for word, m in zip(each[-1], n.tolist(), strict=True):
            count[word] += m
    return each, count


def score(docs: DataFrame, learn: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mode: str = "pretrained", order: int = ORDER, stored: bool = True) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every whole text (A-Z in lower case),
    learning from the rows that ``learn`` selects.  ``stored``: see ``common.Bundles``."""
    new = {"n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    keep = tuple(c for c in keep if c not in new)
    rows = docs.select(*keep, F.col(text).alias("__text"), F.coalesce(learn, F.lit(False)).alias("__learn"))
    bundles, pretrained, spark = common.Bundles(rows, "__text", stored=stored), mode == "pretrained", docs.sparkSession
    n_shards = exchange.shards(bundles.bytes())

    def asked(table: pa.Table) -> Asked:
        own = [x.lower() for x in common.texts(table.column("__text"))]
        return Asked(own, table.column("__learn").to_numpy(zero_copy_only=False), n_shards, order, pairs=pretrained)

    questions = exchange.dealt(bundles.map(lambda number, table: exchange.rows(number, asked(table).questions()), exchange.SCHEMA))

    def summary(shard: int, _: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        """(-1, n) the tokens of a shard, (-2, n) the distinct ones, and the counts of its pairs of order BASE."""
        if shard < 0:
            count = shared(data)[1].values()
            key, n = np.array([-1, -2]), np.array([sum(count), sum(c > 0 for c in count)])
        else:
            own, n, *_ = together(data)
            for _ in range(order - BASE):
                own, n, _ = summed(shorter(own), (n > 0).astype(np.int64))
            key = own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = exchange.each(questions, summary, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")  # 256 ** (BASE + 1) rows at most
    key, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    ends = rows.where("__learn").count()
    n_all, n_kinds = int(n[key == -1].sum()) + ends, int(n[key == -2].sum()) + (ends > 0)
    bottom = spark.sparkContext.broadcast(base_level(key[key >= 0].astype(np.uint64), n[key >= 0]))

    def answer(shard: int, numbers: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if shard < 0:
            each, count = shared(data)
            values = [np.array([count[w] for w in words], "<i8") for words in each]
        else:
            keys, n, number, sizes = together(data)
            values = split(probabilities(keys, n, bottom.value, order)[number].astype("<f4"), sizes)
        for i in range(0, len(numbers), 64):
            yield exchange.batch([(shard, b, exchange.dump(x)) for b, x in zip(numbers[i : i + 64], values[i : i + 64], strict=True)])

    kind = T.StructType([f for f in rows.schema.fields if not f.name.startswith("__")] + [T.StructField(k, v) for k, v in new.items()])
    below = math.log10(n_all + 0.5 * (n_kinds + 1))

    def judge(found: pa.Table, table: pa.Table) -> pa.Table:
        told, own = exchange.told(found), asked(table)
        log = {w: math.log10(c + 0.5) - below for w, c in own.counts(told).items()}
        unknown = math.log10(0.5) - below
        n_tokens, n_known, base = [], [], []
        for x in own.texts:
            sums = [0, 0, 0.0]
            for part in pieces(x):
                values = [log[w] for w in part.split()]
                sums[0] += len(values)
                sums[1] += len(values) - values.count(unknown)
                sums[2] += math.fsum(values)
            n_tokens.append(sums[0] + 1)
            n_known.append(sums[1] + (ends > 0))
            base.append(sums[2] + math.log10(ends + 0.5) - below)
        model = own.logs(told) if pretrained else [adaptive(x, order) for x in own.texts]
        values = zip((n_tokens, n_known, [n_all] * len(base), base, model), kind.fields[len(keep) :], strict=True)
        return pa.table([*(table.column(c) for c in keep), *(pa.array(x, pa.int64() if f.dataType == T.LongType() else pa.float64()) for x, f in values)], names=kind.names)

    return bundles.answered(exchange.each(questions, answer), judge, kind)
