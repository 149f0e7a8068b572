"""Language identification with bit-sliced Bloom filters over letter n-grams.

A slot of a filter is a bitmask with one bit for each learned language.  The AND of the slots of an n-gram
is the set of all languages that (may) contain it.  For each language the hits of a text are its popcount
over the text's n-grams; a share ``f`` of false positives, known from how full the language's slice is, is
taken out of each: ``(hit - f) / (1 - f)``.  The language with the largest corrected count is the answer.

Every n-gram of the training texts counts, however rare.  It enters a language's slice when its share of the language's
n-grams is at least ``LEAST`` of its share in the language where that is largest, so what a large corpus holds of foreign
words doesn't fill the slices.  The filter is sharded: each bundle asks the shards about its distinct n-grams and tells
them how often its training texts of each language have these; a shard sizes its filter by its own members and answers
with the bitmasks (``exchange``).  Scripts of many letters (Han, kana, Hangul), whose longer n-grams are nearly all rare,
go by n-grams shorter by ``SHORTER``.

Null, empty and letterless texts are ``und`` with score 0.  Ties go to the language first in sort order.  With
no language learned (empty table, no labels) every text is ``und``.  Repeated rows are judged each by itself;
a text is read whole, however long, in pieces cut where a letter ends.  ``keep`` columns pass through; new columns replace
any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, exchange, ppm

ORDERS = (3, 4)
SHORTER = 2
LEAST = 0.1
PER_MEMBER = 16  # slots
HASHES = 3
UNDETERMINED = "und"
SPAN = 1 << 20  # characters looked at together

#: scripts of many letters: kana, Han and Hangul, by code point
MANY = ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x323AF))
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_keys(texts: list[str], orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams of each run of letters, in lower case and with its borders, and the number of each one's text.
    Runs in scripts of many letters have n-grams shorter by ``SHORTER``, without borders."""
    low = [x.lower() for x in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    inside = letters()[code]
    code = whole_code = np.where(inside, code, 0).astype(np.uint64)
    many = np.zeros(len(code), bool)
    if (code >= MANY[0][0]).any():
        for a, b in MANY:
            many |= inside & (code >= a) & (code <= b)
    owner = np.repeat(np.arange(len(low)), [len(x) + 1 for x in low])  # the blank before a text is its own
    keys, owners = [], []
    few, mixed_scripts = inside & ~many, bool(many.any())
    code = np.where(many, 0, code) if mixed_scripts else code  # a border to other letters
    for n, own, use in [(n, code, few) for n in orders] + ([(max(1, n - SHORTER), whole_code, many) for n in orders] if mixed_scripts else []):
        last = len(own) - n + 1
        if last <= 0:
            continue
        edge = 0 if use is many else 1
        whole = np.ones(last, bool) if edge else use[:last].copy()
        h = own[:last] + np.uint64(n)
        for j in range(1, n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + own[j : j + last]
            if j < n - edge:
                whole &= use[j : j + last]
        at = np.flatnonzero(whole)
        keys.append(common.mixed(h[at]))
        owners.append(owner[at])
    return np.concatenate(keys) if keys else np.empty(0, np.uint64), np.concatenate(owners) if owners else np.empty(0, np.int64)


def spans(texts: list[str], size: int = SPAN) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Runs of some ``size`` characters of (owners, pieces): long texts are cut before a character that is no letter."""
    owners, held, n = [], [], 0
    for i, x in enumerate(texts):
        a = 0
        while True:
            b = min(len(x), a + size)
            while b < len(x) and x[b].isalpha():
                b += 1
            owners.append(i)
            held.append(x[a:b])
            n += b - a
            if n >= size:
                yield np.array(owners), held
                owners, held, n = [], [], 0
            a = b
            if a >= len(x):
                break
    if held:
        yield np.array(owners), held


def places(keys: np.ndarray, slot_bits: int, hashes: int = HASHES) -> list[np.ndarray]:
    """The slots of n-grams, by double hashing."""
    a, b = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    return [(a + np.uint64(i) * b & np.uint64((1 << slot_bits) - 1)).astype(np.int64) for i in range(hashes)]


@dataclass
class BitSliced:
    """Learned languages, and for each slot the words of its bitmask."""

    languages: list[str]
    slots: np.ndarray  # [1 << slot_bits, (languages + 63) // 64] of uint64
    false_share: np.ndarray  # of each language

    @classmethod
    def of(cls, members: dict[object, np.ndarray], hashes: int = HASHES) -> BitSliced:
        """From the keys of each language's n-grams, with ``PER_MEMBER`` slots for each of the largest language."""
        slot_bits = (max([64, *map(len, members.values())]) * PER_MEMBER - 1).bit_length()
        languages = sorted(members)
        slots = np.zeros((1 << slot_bits, max(1, (len(languages) + 63) // 64)), np.uint64)
        false = np.zeros(len(languages))
        for i, language in enumerate(languages):
            word, mask = i // 64, np.uint64(1 << i % 64)
            for at in places(members[language].view(np.uint64), slot_bits, hashes):
                slots[at, word] |= mask
            false[i] = (np.count_nonzero(slots[:, word] & mask) / (1 << slot_bits)) ** hashes
        return cls(languages, slots, false)

    def languages_of(self, keys: np.ndarray, hashes: int = HASHES) -> np.ndarray:
        """For each n-gram the bitmask of all languages that may contain it: the AND of its slots."""
        out = None
        for at in places(keys, (len(self.slots) - 1).bit_length(), hashes):
            out = self.slots[at] if out is None else out & self.slots[at]
        return out


def numbers(masks: np.ndarray, languages: int) -> np.ndarray:
    """Bitmasks as the smallest numbers that hold them, row by row."""
    return masks.astype(f"<u{next(b for b in (1, 2, 4, 8) if 8 * b >= languages)}")[:, 0] if languages <= 64 else masks.reshape(-1)


class Asked:
    """The distinct n-grams of a bundle, ascending, and what it asks of each shard."""

    def __init__(self, texts: list[str], language: np.ndarray, languages: int, shards: int, orders: tuple[int, ...]):
        """``language``: the number of each text's language to learn, -1 for none."""
        self.orders, self.texts = orders, texts
        keys, n, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(-1, languages):
            for _, some in spans([x for x, own in zip(texts, language.tolist(), strict=True) if own == i]):
                own, times = np.unique(gram_keys(some, orders)[0], return_counts=True)
                keys.append(own)
                n.append(times)
                of.append(np.full(len(own), i))
        every, n, of = np.concatenate(keys), np.concatenate(n), np.concatenate(of)
        self.keys, number = np.unique(every, return_inverse=True)
        learned = of >= 0
        both, m, _ = ppm.summed((number[learned] * languages + of[learned]).astype(np.uint64), n[learned])
        self.entries, self.n = both.astype(np.int64), m
        self.shard = ((self.keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ascends, as keys do
        cuts = np.flatnonzero(np.diff(self.shard, prepend=-1, append=-1)).tolist()
        self.asked = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.languages = languages

    def questions(self) -> Iterator[tuple[int, bytes]]:
        for a, b in self.asked:
            i, j = np.searchsorted(self.entries, [a * self.languages, b * self.languages])
            own = self.entries[i:j] - a * self.languages
            yield int(self.shard[a]), exchange.dump(self.keys[a:b], (own // self.languages).astype("<u4"), (own % self.languages).astype("<u2"), self.n[i:j].astype("<u4"))

    def hits(self, told: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams, and how many of them each language contains, corrected for false positives."""
        weight = np.zeros((self.languages, len(self.keys)), np.float32)
        for a, b in self.asked:
            masks, false = exchange.load(told[int(self.shard[a])])
            masks = masks.reshape(b - a, -1)
            for i, f in enumerate(false.tolist()):
                held = masks[:, i // 64] >> masks.dtype.type(i % 64) & masks.dtype.type(1)
                weight[i, a:b] = (held - f) / (1 - f)
        total, hits = np.zeros(len(self.texts), np.int64), np.zeros((len(self.texts), self.languages))
        places = common.Places(self.keys)
        for owners, some in spans(self.texts):
            keys, owner = gram_keys(some, self.orders)
            at = places.of(keys)
            np.add.at(total, owners, np.bincount(owner, minlength=len(some)))
            for i in range(self.languages):
                np.add.at(hits[:, i], owners, np.bincount(owner, weights=weight[i][at], minlength=len(some)))
        return total, hits


def identify(docs: DataFrame, language: str = "lang", text: str = "text", learn: Column | None = None, keep: tuple[str, ...] = ("doc_id",), orders: tuple[int, ...] = ORDERS, least: float = LEAST, stored: bool = True, fold: Column | None = None) -> DataFrame:
    """``keep`` columns, lang_pred, score (share of the text's n-grams that the language holds, corrected, 0 to 1),
    n_grams, and margin (by how much of the n-grams it leads the next language), learned from all rows that ``learn``
    selects and whose language is not null.  ``stored``: see ``common.Bundles``.  With ``fold``, a number for each row, a row
    is judged by filters of the other folds' rows alone, the one that holds most for each language."""
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "n_grams": T.LongType(), "margin": T.DoubleType()}
    keep = tuple(c for c in keep if c not in new)
    taught = F.when(F.lit(True) if learn is None else learn, F.col(language).cast("string"))
    apart, part = fold is not None, F.lit(0) if fold is None else fold.cast("int")
    rows = docs.select(*keep, F.col(text).alias("__text"), taught.alias("__taught"), part.alias("__fold"))
    bundles = common.Bundles(rows, "__text", stored=stored)
    named = rows.where("__taught is not null").select("__taught", "__fold").distinct().orderBy("__taught", "__fold").collect()  # the labels' values
    names, folds = [x[0] for x in named], np.array([x[1] for x in named], np.int64)
    number, n_shards = {tuple(x): i for i, x in enumerate(named)}, exchange.shards(bundles.bytes())

    def asked(table: pa.Table) -> Asked:
        taught = np.array([number.get(x, -1) for x in zip(table.column("__taught").to_pylist(), table.column("__fold").to_pylist(), strict=True)], np.int64)
        return Asked([x or "" for x in table.column("__text").to_pylist()], taught, len(names), n_shards, orders)

    questions = exchange.dealt(bundles.map(lambda number, table: exchange.rows(number, asked(table).questions()), exchange.SCHEMA))

    def together(data: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The n-grams of each question, the distinct ones, and how often each language's training texts have them."""
        found = [exchange.load(x) for x in data]
        every, place = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
        count, at = np.zeros((len(every), len(names)), np.int64), 0
        for own, row, of, n in found:
            np.add.at(count, (place[at + row.astype(np.int64)], of), n)
            at += len(own)
        return [x[0] for x in found], every, count

    def summary(_: int, __: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        total = together(data)[2].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(total)], ["language", "n"])

    totals = np.zeros(len(names))
    for x in exchange.each(questions, summary, "language long, n long").groupBy("language").agg(F.sum("n").alias("n")).collect():  # a row for each language
        totals[x.language] = x.n

    def answer(shard: int, numbers_: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        own, every, count = together(data)
        share = count / np.maximum(totals, 1)
        best = np.zeros_like(share)
        for f in np.unique(folds):  # of the filters of one fold
            best[:, folds == f] = share[:, folds == f].max(axis=1, initial=0)[:, None]
        member = (count > 0) & (share >= least * best)
        model = BitSliced.of({i: every[member[:, i]] for i in range(len(names))})
        for b, keys in zip(numbers_, own, strict=True):
            yield exchange.batch([(shard, b, exchange.dump(numbers(model.languages_of(keys), len(names)), model.false_share))])

    kind = T.StructType([f for f in rows.schema.fields if not f.name.startswith("__")] + [T.StructField(k, v) for k, v in new.items()])

    def judge(found: pa.Table, table: pa.Table) -> pa.Table:
        n, hits = asked(table).hits(exchange.told(found))
        share = np.clip(np.concatenate([hits / np.maximum(n, 1)[:, None], np.zeros((len(n), 2))], axis=1), 0, 1)  # two columns at least
        known = np.ones(len(n), bool)
        if apart:
            other = folds != table.column("__fold").to_numpy()[:, None]
            share[:, : len(names)] = np.where(other, share[:, : len(names)], -1)
            for name in dict.fromkeys(names):  # a language's folds are one candidate
                own = np.flatnonzero([x == name for x in names])
                top = own[np.argmax(share[:, own], axis=1)]
                rest = own[None, :] != top[:, None]
                share[:, own] = np.where(rest, -1, share[:, own])
            known = other.any(axis=1)
        best = np.argmax(share, axis=1) if names else np.zeros(len(n), np.int64)
        two = np.maximum(np.sort(share, axis=1)[:, -2:], 0)
        known &= share[np.arange(len(n)), best] >= 0
        found = [names[b] if m and names and k and b < len(names) else UNDETERMINED for b, m, k in zip(best.tolist(), n.tolist(), known.tolist(), strict=True)]
        columns = [pa.array(found, pa.string()), pa.array(np.where(n > 0, two[:, 1], 0.0)), pa.array(n), pa.array(np.where(n > 0, two[:, 1] - two[:, 0], 0.0))]
        return pa.table([*(table.column(c) for c in keep), *columns], names=kind.names)

    return bundles.answered(exchange.each(questions, answer), judge, kind)
