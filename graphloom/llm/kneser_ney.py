"""Quality by the perplexity of an interpolated modified Kneser-Ney model of byte n-grams.

The model is trained on the texts of all documents named.  Which these are is found by a join of ids: bundles give the ids of
their rows, and get back the places of those named, once with the text to ask and once with the answers.  An n-gram is packed like a pair of ``ppm``, and its tables (counts of the highest order, continuation counts of
the lower ones, totals and numbers of followers by context) are sharded by the nearest ``BASE`` + 1 bytes of context.
Each bundle asks the shards about its distinct n-grams and tells them how often its trusted texts have these
(``exchange``); a shard joins the counts of all bundles, works out the probability of each n-gram order by order, and
answers; each document gets its perplexity over all its bytes.  Only the continuation counts of the last BASE + 1
bytes, 256 ** (BASE + 1) at most, and the discounts are of all shards and broadcast.  A document is kept if its log
perplexity is at most its language's fence (``rules.fence``), from mergeable quantile sketches of all documents' log
perplexities; languages of fewer than ``MIN_GROUP`` documents use the sketch of all.

Null and blank texts have no perplexity (null) and aren't kept; a null language is a group of its own; repeated
rows are scored each; without trusted text every byte is equally likely, so all that have words are kept; an
empty table gives an empty one; a text of any length is read whole, in overlapping stretches; equal perplexities are
judged alike.  ``keep`` columns pass through; new ones replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import dealt
from . import common, exchange, ppm, rules

ORDER = 5  # bytes of an n-gram
BASE = ppm.BASE
MIN_GROUP = 200
SYMBOLS = 256


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
    return [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]


def often(n: np.ndarray) -> list[int]:
    """How many n-grams occur 1 to 4 times."""
    return [int((n == i).sum()) for i in (1, 2, 3, 4)]


def level(keys: np.ndarray, n: np.ndarray, d: list[float], lower: np.ndarray) -> np.ndarray:
    """The probabilities of the n-grams of one order, ascending, from their counts and the probabilities of their suffixes."""
    context = keys >> np.uint64(8)
    first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
    size = np.diff(np.append(first, len(keys)))
    over = lambda x: np.repeat(np.add.reduceat(x, first), size) if len(first) else x
    spared = np.array([0.0, *d])[np.minimum(n, 3)]
    total = over(n)
    return np.where(total > 0, (n - spared + over(spared) * lower) / np.maximum(total, 1), lower)


def longer(keys: np.ndarray, n: np.ndarray, steps: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(keys, counts, number of each longer n-gram's key): the n-grams, then with each step their suffixes and continuation counts."""
    levels = [(keys, n, None)]
    for _ in range(steps):
        levels.append(ppm.summed(ppm.shorter(levels[-1][0]), (levels[-1][1] > 0).astype(np.int64)))
    return levels


def raised(levels: list, d: list[list[float]], p: np.ndarray | float, link: np.ndarray | None) -> np.ndarray:
    """The probabilities of the first of some levels, from those below the last."""
    for (keys, n, number), own in zip(reversed(levels), d, strict=True):
        p, link = level(keys, n, own, p if link is None else p[link]), number
    return p


def perplexities(docs: DataFrame, trusted: DataFrame, text: str = "text", id_column: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), order: int = ORDER, stored: bool = True) -> DataFrame:
    """``keep`` columns, is_trusted, n_bytes and perplexity of every whole text; ``trusted`` holds ids to learn from.
    ``stored``: see ``common.Bundles``."""
    new = {"is_trusted": T.BooleanType(), "n_bytes": T.LongType(), "perplexity": T.DoubleType()}
    keep, context, spark = tuple(c for c in keep if c not in new), order - 1, docs.sparkSession
    named = dealt(trusted.select(F.col(id_column).alias("id")).where("id is not null").distinct())
    rows = docs.select(*keep, F.col(text).alias("__text"), F.col(id_column).alias("__id"))
    bundles = common.Bundles(rows, "__text", stored=stored, level=9)
    n_shards = exchange.shards(bundles.bytes())

    def places(number: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids = table.column("__id").combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), number)), pa.array(np.arange(len(ids), dtype=np.int32)), ids], ["bundle", "row", "id"])

    at = T.StructType([T.StructField("bundle", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", docs.schema[id_column].dataType)])
    chosen = common.checkpointed(bundles.map(places, at).join(named, "id").select("bundle", "row"))

    def asked(table: pa.Table, learned: np.ndarray) -> ppm.Asked:
        return ppm.Asked(common.texts(table.column("__text")), learned, n_shards, context, tokens=False)

    def learned(rows: pa.ChunkedArray, table: pa.Table) -> np.ndarray:
        out = np.zeros(len(table), bool)
        out[rows.drop_null().to_numpy()] = True
        return out

    def ask(number: int, found: pa.Table, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(exchange.rows(number, asked(table, learned(found.column("row"), table)).questions()), exchange.ARROW)

    questions = exchange.dealt(bundles.met(chosen, ask, exchange.KIND))

    def summary(_: int, __: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        """(order, n-gram or count, n): how many n-grams of the higher orders occur 1 to 4 times, and the counts of those of BASE + 1 bytes."""
        own, n, *_ = ppm.together(data)
        levels = longer(own, n, context - BASE)
        keys = [np.arange(1, 5)] * (len(levels) - 1) + [levels[-1][0].astype(np.int64)]
        counts = [np.array(often(n)) for _, n, _ in levels[:-1]] + [levels[-1][1]]
        orders = np.repeat(order - np.arange(len(levels)), list(map(len, keys)))
        yield pa.RecordBatch.from_arrays([pa.array(orders), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["order", "key", "n"])

    found = exchange.each(questions, summary, "order long, key long, n long").groupBy("order", "key").agg(F.sum("n").alias("n")).toArrow()  # 256 ** (BASE + 1) rows and a few at most
    k, key, n = (found.column(c).to_numpy() for c in ("order", "key", "n"))
    d = [discounts([int(n[(k == i) & (key == j)].sum()) for j in (1, 2, 3, 4)]) for i in range(BASE + 2, order + 1)]
    at = np.flatnonzero(k == BASE + 1)
    at = at[np.argsort(key[at])]
    low = longer(key[at].astype(np.uint64), n[at], BASE)
    p = raised(low, [discounts(often(n)) for _, n, _ in reversed(low)], 1 / SYMBOLS, None)
    bottom = spark.sparkContext.broadcast((low[0][0], p))

    def answer(shard: int, numbers: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        own, n, number, sizes = ppm.together(data)
        levels, (keys, p) = longer(own, n, context - BASE - 1), bottom.value
        p = raised(levels, d, p, np.searchsorted(keys, ppm.shorter(levels[-1][0])))
        for b, x in zip(numbers, ppm.split(np.log10(p)[number].astype("<f4"), sizes), strict=True):
            yield exchange.batch([(shard, b, exchange.dump(x))])

    kind = T.StructType([f for f in rows.schema.fields if not f.name.startswith("__")] + [T.StructField(c, t) for c, t in new.items()])

    def judge(found: pa.Table, table: pa.Table) -> pa.Table:
        own, answers = asked(table, use := learned(found.column("row"), table)), found.filter(pc.is_valid(found.column("shard")))
        logs = own.logs(exchange.told(answers))
        value = [10 ** (-x / (len(t) + 1)) if t.strip() else None for x, t in zip(logs.tolist(), own.texts, strict=True)]
        columns = [pa.array(use), pa.array(list(map(len, own.texts)), pa.int64()), pa.array(value, pa.float64())]
        return pa.table([*(table.column(c) for c in keep), *columns], names=kind.names)

    told = exchange.each(questions, answer).unionByName(chosen, allowMissingColumns=True)
    return bundles.answered(told, judge, kind)


#: see rules.MEASURES
MEASURE = {"perplexity": ("perplexity", 1, "log", False)}


def judged(scored: DataFrame, language: str = "lang", min_group: int = MIN_GROUP, width: float = rules.WIDTH) -> DataFrame:
    """``scored`` with threshold and kept."""
    own = scored.where("perplexity is not null").select(F.col(language).alias("__lang"), rules.bucket(F.col("perplexity")).alias("bucket"))
    own = common.checkpointed(own.groupBy("__lang", "bucket").agg(F.count("*").alias("n")).withColumn("measure", F.lit("perplexity")))
    every = rules.fences(own, (), MEASURE, width).first()  # one row
    by = rules.fences(own, ("__lang",), MEASURE, width).select("__lang", F.struct("rows", "perplexity").alias("__own"))
    out = scored.join(by, scored[language].eqNullSafe(by["__lang"]), "left").drop("__lang")
    levels = [F.col("__own.perplexity"), rules.literal(every and every["perplexity"], rules.FENCES)]
    out = out.withColumn("threshold", rules.standing(levels, [F.col("__own.rows")], "", min_group)).drop("__own")
    beyond = F.coalesce(F.col("perplexity") > F.col("threshold"), F.lit(False))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & ~beyond)
