"""Nearest neighbours by multi-index hashing.

Codes: vectors are centred, turned by rotations learned on a bounded sample (iterative quantisation of the
principal axes) and cut to signs.  A code is split into 16-bit substrings, and each shard of the table keeps one
directory for each substring.  By the pigeonhole principle a code within Hamming radius ``r`` of a query's differs
from it by at most ``r // substrings`` bits in one of the first ``r % substrings + 1`` substrings, or by one bit less in
one of the others; so probing every directory to that depth retrieves every code within the radius.  Those that are
within it are ranked by exact distance on the original vectors.

The radius is calibrated: for ``calibration`` sampled vectors the true neighbours among all rows are found by a
linear scan, and the radius is the quantile ``target`` of their Hamming distances.  A query with fewer than k
codes in a shard's radius has it widened there until there are k (or all), so nothing is cut by the radius alone.
Where neighbours are hardly nearer than other vectors the radius is wide and probing retrieves most of a shard
(``reach`` tells how much); results are the same, but the ranking by code is then what saves work.

Queries go to the shards in blocks: every task holds one shard and one block of queries, both of bounded size.

Vectors that are null, zero, or hold null or non-finite components take no part; vectors of different lengths are no
candidates of each other; ties go to the smaller id; rows of the query's own id are not its candidates; repeated rows
are candidates each; of query rows that repeat an id the one of the least vector asks, entry by entry.  An empty table gives an empty one.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 256
SAMPLE = 4096
CALIBRATION = 64
TARGET = 0.97
SHARD = 1 << 15
BLOCK = 1 << 14
_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
_MASKS = [np.array([sum(1 << b for b in bits) for n in range(r + 1) for bits in combinations(range(16), n)], np.uint16) for r in range(5)]


class Codes:
    """Learned rotated binary codes."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 7):
        d = sample.shape[1]
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        z = sample - self.mean
        axes = np.linalg.eigh(z.T @ z / len(z))[1][:, ::-1]
        z, self.rotations = z @ axes, []
        for _ in range(-(-bits // d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(z.T @ np.where(z @ r >= 0, 1.0, -1.0))
                r = u @ vt
            self.rotations.append(axes @ r)
        self.bits = bits

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """[row, substring] of 16 bits each."""
        z = vectors - self.mean
        signs = np.concatenate([z @ r >= 0 for r in self.rotations], axis=1)[:, : self.bits]
        return np.ascontiguousarray(np.packbits(signs, axis=1)).view(np.uint16)


class Index:
    """A shard: ids, vectors, codes, and a directory of each substring's values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.codes = ids[order], vectors[order], codes[order]
        self.directory = []
        for j in range(codes.shape[1]):
            rows = np.argsort(self.codes[:, j], kind="stable")
            values, starts = np.unique(self.codes[rows, j], return_index=True)
            self.directory.append((values, np.append(starts, len(rows)), rows))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within the radius."""
        found = self.probed(code, radius)
        return found[_POPCOUNT[self.codes[found] ^ code].sum(axis=1, dtype=np.int64) <= radius]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows that probing the directories retrieves for the radius."""
        hit, (whole, more) = np.zeros(len(self.ids), bool), divmod(radius, len(code))
        for j, ((values, starts, rows), own) in enumerate(zip(self.directory, code, strict=True)):
            depth = whole if j <= more else whole - 1
            if depth < 0:
                break
            if depth < len(_MASKS) and len(_MASKS[depth]) < len(values):  # the ball is smaller than the directory
                probes = np.sort(_MASKS[depth] ^ own)
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                at = at[values[at] == probes]
            else:
                at = np.flatnonzero(_POPCOUNT[values ^ own] <= depth)
            if len(at):
                n = starts[at + 1] - starts[at]
                hit[rows[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return np.flatnonzero(hit)

    def nearest(self, own_id: int, vector: np.ndarray, code: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest of the codes within the radius, which widens until it holds k or all."""
        bits = 16 * len(code)
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != own_id]
            if len(rows) >= k or radius >= bits:
                break
            radius = min(bits, radius + max(2, bits // 32))
        distance = np.sqrt(((self.vectors[rows].astype(np.float64) - vector) ** 2).sum(axis=1))
        best = np.lexsort((self.ids[rows], distance))[:k]
        return self.ids[rows][best], distance[best]


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def search(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): each query's k nearest found."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = rows.where(F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sound = sound.select(F.col(id_column).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("q")).where("q > 0").orderBy("d").collect()  # a row for each length of vectors
    for x in lengths:
        found = found.union(among(sound.where(F.size("v") == x.d), x.d, x.n, x.q, k, **options))
    return found


def among(sound: DataFrame, dimension: int, total: int, asking: int, k: int, bits: int = BITS, sample: int = SAMPLE, calibration: int = CALIBRATION, target: float = TARGET, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The search among vectors (id, v, q) of one length."""
    drawn = sound.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect()
    codes = Codes(np.array([x.v for x in drawn], np.float64), bits)
    probes = (np.array([x.id for x in drawn[:calibration]]), np.array([x.v for x in drawn[:calibration]], np.float64))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codes.of(probes[1])
        best: list[np.ndarray] = [np.empty((0, 3))] * len(probes[0])
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1), dimension).astype(np.float64)
            c = codes.of(x)
            for i, (a, q) in enumerate(zip(*probes, strict=True)):
                d = ((x - q) ** 2).sum(axis=1)
                near = np.argpartition(d, min(k, len(d) - 1))[: k + 1]
                near = near[ids[near] != a]
                new = np.stack([d[near], ids[near], _POPCOUNT[c[near] ^ own[i]].sum(axis=1)], axis=1)
                both = np.concatenate([best[i], new])
                best[i] = both[np.lexsort((both[:, 1], both[:, 0]))[:k]]
        found = [(i, *x) for i, own_best in enumerate(best) for x in own_best]
        if found:
            i, d, a, h = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(d, pa.float64()), pa.array(a, pa.float64()), pa.array(h, pa.float64())], ["i", "d", "a", "h"])

    near = sound.select("id", "v").mapInArrow(scan, "i int, d double, a double, h double")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "a"))).where(F.col("rank") <= k)
    radius = near.agg(F.percentile("h", target)).first()[0]
    radius = int(np.ceil(bits // 2 if radius is None else radius))
    shards, blocks = -(-total // shard), -(-asking // block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = sound.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "id", "v")
    asked = sound.where("q").groupBy("id").agg(F.min("v").alias("v")).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"), "id", "v")

    def probe(own: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(own) and len(queries):
            x = matrix(own.column("v"), dimension)
            index = Index(own.column("id").to_numpy(), x, codes.of(x.astype(np.float64)))
            q = matrix(queries.column("v"), dimension).astype(np.float64)
            for a, vector, code in zip(queries.column("id").to_pylist(), q, codes.of(q), strict=True):
                ids, distance = index.nearest(a, vector, code, radius, k)
                found.append((np.full(len(ids), a), ids, distance))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    best = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(probe, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))  # k rows of each shard
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def reach(vectors: np.ndarray, queries: np.ndarray, k: int = 10, bits: int = BITS, target: float = TARGET) -> tuple[int, float, float]:
    """(radius, share of rows that probing retrieves, share within the radius) of some vectors for some of them as queries."""
    codes = Codes(vectors[:SAMPLE], bits)
    index = Index(np.arange(len(vectors)), vectors, codes.of(vectors))
    far = []
    for q in queries[:CALIBRATION]:
        near = np.argsort(((vectors - q) ** 2).sum(axis=1))[1 : k + 1]
        far += _POPCOUNT[index.codes[near] ^ codes.of(q[None])[0]].sum(axis=1).tolist()
    radius = int(np.ceil(np.quantile(far, target)))
    own = [(len(index.probed(c, radius)), len(index.within(c, radius))) for c in codes.of(queries)]
    return radius, *(float(np.mean(x)) / len(vectors) for x in zip(*own, strict=True))
