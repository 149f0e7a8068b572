"""Quality rules whose thresholds follow the data: mergeable quantile sketches for each language and source.

Each measure of a document is sketched in logarithmic buckets: a value x > 0 counts in bucket
``ceil(log(x) / log(GAMMA))`` and 0 in its own, so a quantile is right to within 1 % of its value.  Sketches are
added bucket by bucket, so partial sketches merge in any order and a group of any size is a bounded number of counts.

A group's fence stands where its sketch shows a class of documents apart: at the lowest cut (above the median) of which
the ``FEW`` quantile of what lies above is ``WIDTH`` spreads from the 1 - ``FEW`` / 5 quantile of what lies below.  A
spread is the deviation of those below and the sampling error of the measure in a document of the group's median length.
Shares are looked at by their square roots, whose sampling error doesn't depend on their size, lengths by their
logarithms.  So up to half of a group may be bad, and a group without bad documents loses none.  Where a group has no
class apart, the fence of its language and then of all documents holds, if no more than half of the group lies beyond;
if these have none, it is as far from the median as ``REACH`` times the distance from there to the ``FEW`` quantile (no
fence if that is 0).  Lower fences are the same, mirrored.  A group of fewer than ``MIN_GROUP`` documents has no fence of
its own.  A document fails when a measure lies beyond its fence; equal values are judged alike.

Null text has no words (so it fails the base rules); a null language or source is a group of its own; repeated
rows are judged and counted each; an empty table gives an empty one; a text of any length is measured whole.
Columns other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

GAMMA = 1.02
MIN_GROUP = 200
WIDTH = 2.5
FEW = 0.05
REACH = 3.0
NONE = -(1 << 20)  # the bucket of 0
#: measure -> (expression, words that one event counts for, scale, whether there is a lower fence)
MEASURES: dict[str, tuple[str, int, str, bool]] = {
    "word_length": ("try_divide(word_chars, n_words)", 1, "log", True),
    "symbol_share": ("try_divide(n_symbols, n_words)", 1, "sqrt", False),
    "dup_line_share": ("try_divide(n_dup_lines, n_words)", 1, "sqrt", False),
    "repeat_share": ("try_divide(n_repeat_words, n_words)", 6, "sqrt", False),
}
SYMBOLS = re.compile(rb"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more in ``words``."""
    runs = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(runs)) == len(runs):
        return 0
    n = Counter(runs)
    start = np.fromiter((n[x] > 1 for x in runs), bool, len(runs))
    covered = np.zeros(len(words), bool)
    for i in range(size):
        covered[i : i + len(start)] |= start
    return int(covered.sum())


def measured(text: bytes) -> tuple[int, int, int, int, int]:
    """COUNTS of a text."""
    words = text.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(words), chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeat_words(words)


def features(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` columns and COUNTS of every whole text."""
    keep = tuple(c for c in keep if c not in COUNTS)
    rows = docs.select(*keep, F.col(text).alias("__text"))
    kind = T.StructType([f for f in rows.schema.fields if f.name != "__text"] + [T.StructField(c, T.LongType()) for c in COUNTS])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(measured, common.texts(batch.column(len(keep)))), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x, pa.int64()) for x in found)], kind.names)

    return rows.mapInArrow(run, kind)


def bucket(value: Column, gamma: float = GAMMA) -> Column:
    """The sketch's bucket of a value of 0 or more."""
    return F.when(value > 0, F.ceil(F.log(value) / math.log(gamma)).cast("int")).otherwise(NONE)


def middle(buckets: np.ndarray, gamma: float = GAMMA) -> np.ndarray:
    """The values that stand for buckets."""
    return np.where(buckets == NONE, 0.0, 2 * gamma ** buckets.astype(np.float64) / (gamma + 1))


def sketches(rows: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(groups, measure, bucket, n): one sketch of each measure, and of n_words, for each group."""
    sides = F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.expr(e)).alias("bucket")) for m, e in [("n_words", "n_words"), *((m, e) for m, (e, *_) in MEASURES.items())]))
    return rows.where("n_words > 0").select(*groups, F.explode(sides).alias("x")).groupBy(*groups, "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def quantile(y: np.ndarray, n: np.ndarray, q: float) -> float:
    """The first value up to which the share ``q`` lies."""
    upto = np.cumsum(n)
    return float(y[np.searchsorted(upto, q * upto[-1])])


def cut(y: np.ndarray, n: np.ndarray, error: float, width: float = WIDTH) -> int | None:
    """The place of the last of ascending values before a class apart (None: there is no such class)."""
    upto, total = np.cumsum(n).astype(np.float64), float(n.sum())
    i = np.flatnonzero(upto[:-1] >= total / 2)
    if not len(i):
        return None
    mean = np.cumsum(n * y)[i] / upto[i]
    spread = np.sqrt(np.maximum(np.cumsum(n * y * y)[i] / upto[i] - mean**2, 0) + error**2)
    above = y[np.searchsorted(upto, upto[i] + FEW * (total - upto[i]))]
    below = y[np.searchsorted(upto, (1 - FEW / 5) * upto[i])]
    apart = np.flatnonzero(above - below >= width * spread)
    return int(i[apart[0]]) if len(apart) else None


#: of a measure: its median, the cut above it, the fence where there is no cut, and those below
FENCES = ("q50", "cut", "rest", "low_cut", "low_rest")


def fence(buckets: np.ndarray, n: np.ndarray, error: float, scale: str, width: float = WIDTH) -> list[float | None]:
    """FENCES of a merged sketch (buckets in any order)."""
    order = np.argsort(buckets)
    buckets, n = buckets[order], n[order]
    x = middle(buckets)
    y = np.sqrt(x) if scale == "sqrt" else np.log(np.maximum(x, 1e-9))
    up, low = cut(y, n, error, width), cut(-y[::-1], n[::-1], error, width)
    q50, few, most = (quantile(y, n, q) for q in (0.5, FEW, 1 - FEW))
    back = (lambda v: max(v, 0.0) ** 2) if scale == "sqrt" else math.exp
    edge = lambda b: 0.0 if b == NONE else GAMMA**b
    rest = back(q50 + REACH * (q50 - few)) if q50 > few else None
    low_rest = back(q50 - REACH * (most - q50)) if most > q50 else None
    return [quantile(x, n, 0.5), None if up is None else edge(float(buckets[up])), rest, None if low is None else edge(float(buckets[len(n) - 1 - low]) - 1), low_rest]


def fences(merged: DataFrame, groups: tuple[str, ...], measures: dict = MEASURES, width: float = WIDTH) -> DataFrame:
    """(groups, rows, and for each measure a struct of FENCES) of sketches (groups, measure, bucket, n), partial or whole."""
    merged = merged.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
    own = T.StructType([T.StructField(c, T.DoubleType()) for c in FENCES])
    kind = T.StructType([*(merged.schema[g] for g in groups), T.StructField("rows", T.LongType()), *(T.StructField(m, own) for m in measures)])
    struct = common.arrow_schema(own)

    def stand(group: pa.Table) -> pa.Table:
        measure, buckets, n = np.array(group.column("measure").to_pylist()), group.column("bucket").to_numpy(), group.column("n").to_numpy()
        words = measure == "n_words"
        size = quantile(middle(np.sort(buckets[words])), n[words][np.argsort(buckets[words])], 0.5) if words.any() else None
        found = []
        for m, (_, unit, scale, _) in measures.items():
            at = measure == m
            found.append(dict(zip(FENCES, fence(buckets[at], n[at], math.sqrt(unit / size) / 2 if size else math.log(GAMMA), scale, width), strict=True)))
        rows = int(n[measure == next(iter(measures))].sum())
        return pa.table([*(group.column(g).slice(0, 1) for g in groups), pa.array([rows]), *(pa.array([x], pa.struct(list(struct))) for x in found)], names=kind.names)

    return merged.groupBy(*groups).applyInArrow(stand, kind)  # a group is a sketch of each measure: buckets, not documents


def standing(levels: list[Column], rows: list[Column], side: str, min_group: int) -> Column:
    """The fence of a measure from its FENCES at the levels, the narrowest first: the first cut beyond which no half of the group lies, else the rest's."""
    low = side == "low_"
    large = lambda i: F.coalesce(rows[i] >= min_group, F.lit(False)) if i < len(levels) - 1 else F.lit(True)
    own = F.coalesce(*(x["q50"] for x in levels))
    cuts = [F.when(large(i) & (own >= x[f"{side}cut"] if low else own <= x[f"{side}cut"]), x[f"{side}cut"]) for i, x in enumerate(levels)]
    return F.coalesce(*cuts, *(F.when(large(i), x[f"{side}rest"]) for i, x in enumerate(levels)))


def literal(row, names: tuple[str, ...]) -> Column:
    """A struct of doubles as a constant."""
    return F.struct(*(F.lit(None if row is None else row[c]).cast("double").alias(c) for c in names))


def judged(counted: DataFrame, language: str = "lang", source: str = "source", min_group: int = MIN_GROUP, width: float = WIDTH) -> DataFrame:
    """``counted`` with base_failed, and kept: whether neither the base rules nor its group's fences reject it."""
    names = {"__lang": language, "__source": source}
    own = common.checkpointed(sketches(counted.withColumnsRenamed({v: k for k, v in names.items()}), tuple(names)))
    every = fences(own, (), width=width).first()  # one row
    out = counted
    for i, groups in enumerate((tuple(names), ("__lang",))):
        side = fences(own, groups, width=width)
        side = side.select(*groups, F.struct("rows", *MEASURES).alias(f"__level{i}"))
        on = [F.col(names[g]).eqNullSafe(side[g]) for g in groups]
        out = out.join(side, on, "left").drop(*groups)
    failed = F.lit(False)
    for m, (expression, *_, lower) in MEASURES.items():
        levels = [F.col("__level0")[m], F.col("__level1")[m], literal(every and every[m], FENCES)]
        rows = [F.col(f"__level{i}")["rows"] for i in range(2)]
        failed = failed | F.coalesce(F.expr(expression) > standing(levels, rows, "", min_group), F.lit(False))
        if lower:
            failed = failed | F.coalesce(F.expr(expression) <= standing(levels, rows, "low_", min_group), F.lit(False))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", base).withColumn("kept", ~base & ~failed)
    return out.drop("__level0", "__level1")
