"""Near-duplicate join on the Jaccard similarity of word n-grams, with a MinHash LSH forest.

Texts of equal shingle sets are one class from the start (by 128 bits of hash); the rest works on one
representative of each class.  A signature has ``TREES`` labels of ``DEPTH`` MinHash values; a tree is the
prefix trie of its labels, whose nodes are the groups of labels with a common prefix.  Every class starts with whole
labels.  The share of trees in which it has company at a depth estimates the probability that a tree joins it with
those like it, so 1 - (1 - share) ** TREES estimates the forest's recall at that depth; where it falls short of
``TARGET``, the class's prefixes are shortened by one value and looked at again.  At ``prefix_length`` values even a pair
at the threshold is met with probability TARGET, so no class goes further.  Others with longer prefixes stay in the
nodes of shorter ones, so a pair is met at the shorter depth of its two.

Members of a node hang on its least member, never on each other, so a node of any size gives as many candidate links as
it has members.  Connected candidates form clusters; inside a cluster every pair of representatives is compared
exactly, in blocks, as products of incidence matrices; a block pair returns its members' counts of links and one root
each, not its pairs.  So no pair of a cluster is missed.  A cluster of m different texts goes through the comparison in
m / 128 blocks, 16 at most up to 16 * ``BLOCK`` texts and m / BLOCK beyond, and each text is sent once for each of
them; its arithmetic is quadratic, as are its links.  Groups are the connected components of exact links.

A shingle is ``WORDS`` words; a text of fewer words is one shingle of all of them; null and blank texts have
none and are linked to nothing.  Rows that repeat id and text are copies like any other.  An empty table gives
an empty one.  Other columns are ignored; ids may be null or repeat; of equal ids that of the first row by key is taken
for least.  A long text is read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components, dealt, salted
from . import common

WORDS = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
TARGET = 0.999
BLOCK = 1024
SMALL = 128

_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, target: float = TARGET) -> int:
    """The longest prefix with which pairs at the threshold are met with probability ``target``."""
    k = depth
    while k > 1 and 1 - (1 - threshold**k) ** trees < target:
        k -= 1
    return k


def enough(trees: int = TREES, target: float = TARGET) -> int:
    """The least number of trees with company at a depth for which the forest's estimated recall there reaches the target."""
    return next(n for n in range(trees + 1) if 1 - (1 - n / trees) ** trees >= target)


def shingles(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = common.Words(texts)
    runs, out = common.rolled(w.h[:, 0], words), []
    for a, b in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            out.append(common.rolled(w.h[a:b, 0], b - a) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[text, tree, depth] of 16-bit MinHash values of sets that aren't empty."""
    borders = np.cumsum([0, *map(len, sets)])[:-1]
    flat, out = np.concatenate(sets), np.empty((len(sets), TREES * DEPTH), np.uint16)
    for i, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(flat * factor, borders)
        out[:, i] = common.mixed(least) & np.uint64(0xFFFF)
    return out.reshape(len(sets), TREES, DEPTH)


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Whether the Jaccard similarity of each set of ``a`` with each of ``b`` reaches the threshold; sets aren't empty."""
    both = a if a is b else [*a, *b]
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), list(map(len, both)))
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    use = n[column] > 1  # others are in one set alone
    kept, column = np.unique(column[use], return_inverse=True)
    owner = owner[use]
    common_ = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, len(kept), 4096):
        i, j = np.searchsorted(column, [start, start + 4096])
        m = np.zeros((len(both), min(4096, len(kept) - start)), np.float32)
        m[owner[i:j], column[i:j] - start] = 1
        common_ += m[: len(a)] @ (m if a is b else m[len(a) :]).T
    size = lambda x: np.array(list(map(len, x)), np.float64)
    union = size(a)[:, None] + size(b)[None] - common_
    return common_ >= threshold * union - 1e-6


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as these, of which each ``a`` has a few: each a and all it hangs on are hung on the
    least of them, so a large group whose members hang on the same few has one link for each member."""
    own = links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.collect_set("b").alias("all"))
    own = own.select(F.explode(F.array_append("all", F.col("a"))).alias("a"), F.col("least").alias("b"))
    return own.where("a <> b").distinct()


def groups(docs: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = WORDS, threshold: float = THRESHOLD, block: int = BLOCK, roots: bool = False) -> DataFrame:
    """For each row: the id, __row (a key of id and text), class_id (least id of its group of near duplicates), copy_id (least id
    of texts with its shingle set), n_copies (rows with that set), n_links (other sets linked to it); with ``roots`` also
    __root, the key of its group (ids may be null or repeat, so class_id may be that of several groups; null without words)."""
    prefix = prefix_length(threshold)
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("\1")), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(text).alias("__text"), F.col(id_column).alias("__id"), F.unhex(F.md5(key)).alias("__row"))
    id_field = rows.schema["__id"]

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = common.texts(batch.column(0))
            for some in common.spans(own, 2 << 20):
                sets = shingles(own[some], words)
                node = [common.xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                label: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, x in zip(full, signatures([sets[i] for i in full]), strict=True):
                        label[i] = x.tobytes()
                part = batch.slice(some.start, some.stop - some.start)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(node, pa.binary()), pa.array(label, pa.binary())], ["__id", "__row", "node", "label"])

    described = rows.mapInArrow(describe, T.StructType([id_field, T.StructField("__row", T.BinaryType()), T.StructField("node", T.BinaryType()), T.StructField("label", T.BinaryType())]))
    described = common.checkpointed(described)
    classes = described.where("node is not null").groupBy("node").agg(F.min(F.struct("__id", "__row", "label")).alias("least"), F.count("*").alias("n_copies"))
    classes = common.checkpointed(classes.select("node", F.col("least.__id").alias("copy_id"), F.col("least.__row").alias("__row"), F.col("least.label").alias("label"), "n_copies"))

    def nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), TREES, DEPTH)
            for tree in range(TREES):
                at = [common.xxhash.xxh3_128_digest(bytes([tree]) + x.tobytes()) for x in np.ascontiguousarray(label[:, tree, :prefix])]
                rest = np.zeros(len(batch), np.int64)
                for j in range(prefix, DEPTH):
                    rest = rest << 16 | label[:, tree, j]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.binary()), pa.array(rest), batch.column(0)], ["trie", "rest", "node"])

    members = classes.select("node", "label").mapInArrow(nodes, "trie binary, rest long, node binary")
    joint = members.groupBy("trie").agg(F.count("*").alias("n")).where("n > 1").select("trie")
    company = common.checkpointed(salted(members, joint, "trie"))
    # the nodes of each depth: the shortest prefix and the values after it
    levels = F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("rest", 16 * (DEPTH - d)).alias("more")) for d in range(prefix, DEPTH + 1)))
    levels = company.select("trie", "node", F.inline(levels)).select(F.struct("trie", "depth", "more").alias("at"), "node", "depth")
    shared = levels.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at")
    matched = salted(levels, shared, "at").groupBy("node", "depth").agg(F.count("*").alias("trees")).where(F.col("trees") >= enough())
    reached = matched.groupBy("node").agg(F.max("depth").alias("reached"))
    levels = levels.join(dealt(reached), "node", "left").withColumn("reached", F.coalesce("reached", F.lit(prefix)))
    tops = levels.groupBy("at", "depth").agg(F.min("node").alias("top"), F.min("reached").alias("least"), F.count("*").alias("n")).where("n > 1 and least <= depth").select("at", "top")
    # in each tree a class hangs on the top of the shortest prefix that some class there has come down to
    hung = salted(levels.select("at", "node", F.col("at.trie").alias("trie")), tops, "at").groupBy("trie", "node").agg(F.min_by("top", "at.depth").alias("top"))
    candidates = contracted(hung.where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")))
    clusters = components(candidates)
    each = F.greatest(F.lit(min(block, SMALL)), F.least(F.lit(block), F.col("n") / 16))
    sizes = clusters.groupBy("root").agg(F.count("*").alias("n")).select("root", F.ceil(F.col("n") / each).cast("int").alias("blocks"))
    placed = salted(clusters, sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(dealt(classes.select("node", "__row")), "node")
    texts = rows.select("__row", "__text").dropDuplicates(["__row"]).join(dealt(placed), "__row").select("__text", "root", "node", "own", "blocks")

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, blocks, mine = common.texts(batch.column(0)), batch.column(4).to_pylist(), batch.column(3).to_pylist()
            for some in common.spans(own, 1 << 20):
                sets = [x.tobytes() for x in shingles(own[some], words)]
                where = [(some.start + i, min(mine[some.start + i], j), max(mine[some.start + i], j), s) for i, s in enumerate(sets) for j in range(blocks[some.start + i])]
                at = pa.array([x[0] for x in where], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), pa.array([x[1] for x in where], pa.int32()), pa.array([x[2] for x in where], pa.int32()), batch.column(2).take(at), batch.column(3).take(at), pa.array([x[3] for x in where], pa.binary())], ["root", "i", "j", "node", "own", "sets"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None

        def result() -> pa.RecordBatch:
            _, i, j = current
            sides = [[(n, np.frombuffer(s, np.uint64)) for n, o, s in held if o == side] for side in dict.fromkeys((i, j))]
            names = [n for side in sides for n, _ in side]
            if len(sides) == 1:
                m = linked(x := [s for _, s in sides[0]], x, threshold)
                np.fill_diagonal(m, False)
                n, (a, b) = m.sum(axis=1), np.nonzero(np.triu(m))
            elif all(sides):
                m = linked(*([s for _, s in side] for side in sides), threshold)
                n, (a, b) = np.concatenate([m.sum(axis=1), m.sum(axis=0)]), np.nonzero(m)
                b = b + len(sides[0])
            else:
                n, a, b = np.zeros(len(names), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            order = np.array(sorted(range(len(names)), key=names.__getitem__))
            place = np.argsort(order)
            names, n, a, b, top = [names[k] for k in order], n[order], place[a], place[b], np.arange(len(names))
            while len(a):  # the least of what is linked here
                before = top.copy()
                np.minimum.at(top, a, top[b])
                np.minimum.at(top, b, top[a])
                top = top[top]
                if (top == before).all():
                    break
            some = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.binary()), pa.array(n[some].astype(np.int64)), pa.array([names[top[k]] for k in some], pa.binary())], ["node", "n", "top"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "node", "own", "sets")]
            for root, i, j, node, own, s in zip(*columns, strict=True):
                if (root, i, j) != current:
                    if len(held) > 1:
                        yield result()
                    held, current = [], (root, i, j)
                held.append((node, own, s))
        if len(held) > 1:
            yield result()

    spread_kind = "root binary, i int, j int, node binary, own int, sets binary"
    found = texts.mapInArrow(spread, spread_kind).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compare, "node binary, n long, top binary")
    found = common.checkpointed(found)
    links = found.groupBy("node").agg(F.sum("n").alias("n_links"))
    near = components(contracted(found.select(F.col("node").alias("a"), F.col("top").alias("b"))))
    grouped = classes.join(dealt(near), "node", "left").join(dealt(links), "node", "left").select("node", "copy_id", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    least = grouped.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    root = [F.col("root").alias("__root")] if roots else []
    grouped = salted(grouped, least, "root").select("node", "class_id", "copy_id", "n_copies", "n_links", *root)
    alone = described.where("node is null").select("__id", "__row", F.col("__id").alias("class_id"), F.col("__id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"), *([F.col("node").alias("__root")] if roots else []))
    out = salted(described.where("node is not null").select("__id", "__row", "node"), grouped, "node").select("__id", "__row", "class_id", "copy_id", "n_copies", "n_links", *(["__root"] if roots else []))
    return out.union(alone).withColumnRenamed("__id", id_column)


def kept(docs: DataFrame, text: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps one row: that of least id (then text).
    Of rows that repeat id and text one stays; rows without words are in no group and all stay."""
    key = F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("\1")), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))
    found = groups(docs, text, id_column, roots=True, **options).select("__row", F.col(id_column).alias("__id"), "__root", "n_copies", "n_links")
    found = common.checkpointed(found.distinct())
    alone = (F.col("n_links") == 0) & (F.col("n_copies") == 1)
    first = found.where(~alone).groupBy("__root").agg(F.min(F.struct("__id", "__row")).alias("first")).select("first.__row")
    stay = found.where(alone).select("__row").union(first)
    rows = docs.withColumn("__row", F.unhex(F.md5(key)))
    wordless = ~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return rows.where(~wordless).join(dealt(stay.distinct()), "__row", "left_semi").dropDuplicates(["__row"]).drop("__row").unionByName(docs.where(wordless))
