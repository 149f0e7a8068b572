"""Whitening of vectors by the leading eigenvectors of their covariance, found by block Lanczos without a covariance matrix.

Entries are made integers, x = floor(64 * c) + 1000000.  The *fit list* holds each distinct x vector once; its number n and
sums S are exact, and every entry is centred before it is multiplied: (n * x - S) / n, one rounding of an exact integer.

Each step multiplies a block of ``BLOCK`` orthonormal vectors by the covariance in one pass over the fit list: a task sums
Yᵀ(Y Q) over its rows, a few tasks sum what tasks say, and the driver adds these up: ``REDUCERS`` matrices of d x BLOCK
whatever the rows.  The new block is orthogonalised against all before it, twice; directions that vanish (breakdown:
the space found is invariant) are replaced by random ones orthogonal to all, so that multiple eigenvalues and those
that the start can't see are found; a block is at least as wide as the number of components, so an eigenvalue is found as
often as it counts.  Ritz vectors come from the products kept (Rayleigh-Ritz on the whole basis), and the
residuals |V q - e q| of the leading ones decide: at most ``TOLERANCE`` times the largest eigenvalue, or the basis spans all.  A
basis of more than ``BASIS`` vectors is restarted from its leading Ritz vectors.  The trace, which explained shares are of, is the
sum of the fit list's squared deviations.

Rows whose vector is null, empty, or holds null or non-finite entries, or entries beyond +-2**34, which long sums can't hold,
take no part, nor do those of another dimension than most have (of equally many, the least).  A deviation beyond 64 bits
is null.  Components of a variance below 1e-12 of the largest can't be scaled to 1 and are left out, so equal vectors, a single
row and an empty table give no rows.  Repeated rows are rows each, though one of the fit list; ``keep`` columns pass through, and
new ones replace any of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COMPONENTS = 16
BLOCK = 16
BASIS = 512
PASSES = 200
TOLERANCE = 1e-14
REDUCERS = 8
LIMIT = float(1 << 34)


def integers(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(``rows`` that take part, with __x; their dimension)."""
    sound = F.forall(vector, lambda c: F.abs(c.cast("double")) <= LIMIT)  # false for NaN, which is above all numbers; null for null
    sound = rows.where(sound & (F.size(vector) > 0))
    most = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0].d if most else 0
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * 64).cast("long") + 1000000)
    return sound.where(F.size(vector) == d).withColumn("__x", x), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def summed(fit: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """``f`` of all rows' matrices, summed up to a few: an array for each of at most ``REDUCERS`` tasks."""

    def total(parts: Iterable[np.ndarray], kind: str) -> Iterator[pa.RecordBatch]:
        out = None
        for x in parts:
            out = x if out is None else out + x
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([out.tobytes()], pa.binary())], ["kind", "part"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (f(matrix(b.column(0).slice(i, 4096), d)) for b in batches for i in range(0, len(b), 4096))
        first = next(parts, None)
        if first is not None:
            yield from total((x for y in ([first], parts) for x in y), first.dtype.str)

    def tasks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind in batches:
            first = kind.column(0)[0].as_py()
            rest = (np.frombuffer(x.as_buffer(), first) for b in ([kind], batches) for y in b for x in y.column(1))
            yield from total(rest, first)

    schema = "kind string, part binary"
    found = fit.select("__x").mapInArrow(rows, schema).repartition(REDUCERS).mapInArrow(tasks, schema).collect()  # REDUCERS rows at most
    return [np.frombuffer(r.part, r.kind) for r in found]


class Centre:
    """n and the sums S of a fit list, and what is far from its mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64-bit integers, or Python's if these are too short."""
        t = x - self.base
        if self.n * (int(np.abs(t).max(initial=0)) + 1) >= 1 << 62:
            t = t.astype(object)
        return t * self.n - self.rest

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n * x - S) ** 2, exactly, for each row."""
        y = self.scaled(x)
        if y.dtype != object and x.shape[1] * (int(np.abs(y).max(initial=0)) + 1) ** 2 >= 1 << 63:
            y = y.astype(object)
        return (y * y).sum(axis=1)


def orthogonal(w: np.ndarray, basis: np.ndarray, floor: float) -> np.ndarray:
    """Orthonormal vectors of the span of ``w`` off that of ``basis``, without directions shorter than ``floor``."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, s, _ = np.linalg.svd(w, full_matrices=False)
    u = u[:, s > floor]
    for _ in range(2):  # short directions lose their orthogonality when they are scaled up
        u, _ = np.linalg.qr(u - basis @ (basis.T @ u))
    return u


def lanczos(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, limit: int = BASIS, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the k leading eigenvalues of a symmetric matrix known by its products, their eigenvectors, their residuals)."""
    random, k = np.random.default_rng(seed), min(k, d)
    basis, image, block = np.empty((d, 0)), np.empty((d, 0)), min(max(block, k), d)
    following = random.standard_normal((d, block))
    for _ in range(passes):
        scale = np.linalg.norm(image, axis=0).max(initial=0.0)
        new = orthogonal(following, basis, tolerance * scale)[:, : d - basis.shape[1]]
        while new.shape[1] < min(block, d - basis.shape[1]):  # breakdown: what is left is looked for from a random start
            held = np.hstack([basis, new])
            fresh = orthogonal(random.standard_normal((d, min(block, d - basis.shape[1]) - new.shape[1])), held, 1e-8)
            new = np.hstack([new, fresh])
        following = multiply(new)
        basis, image = np.hstack([basis, new]), np.hstack([image, following])
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        own = basis @ y[:, :k]
        residuals = np.linalg.norm(image @ y[:, :k] - own * values[:k], axis=0)
        if basis.shape[1] == d or basis.shape[1] >= k and (residuals <= tolerance * values[0]).all():
            break
        if basis.shape[1] + block > max(limit, k + 2 * block):  # restart
            following = (image @ y - (basis @ y) * values)[:, :block]
            held = max(k + block, limit // 2)
            basis, image = basis @ y[:, :held], image @ y[:, :held]
    return values[:k], own / np.linalg.norm(own, axis=0), residuals


def whiten(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS, **options) -> DataFrame:
    """(keep, component, n, deviation, whitened, explained, identity_error) of each row that takes part and each component, from 1."""
    own, d = integers(rows, vector)
    fit = common.stored(own.select("__x").distinct())
    halves = lambda x: np.concatenate([(x >> 20).sum(axis=0), (x & (1 << 20) - 1).sum(axis=0), [len(x)]])  # noqa: E731  sums of halves stay within 64 bits
    moments = summed(fit, d, halves) if d else []
    n = sum(int(m[-1]) for m in moments)
    schema = T.StructType([*(f for f in own.select(*keep).schema if f.name not in NEW), T.StructField("deviation", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))])
    centre = Centre(n, [sum((int(m[j]) << 20) + int(m[d + j]) for m in moments) for j in range(d)]) if n else None
    if n:
        multiply = lambda q: sum(summed(fit, d, lambda x: ((y := centre.apart(x)).T @ (y @ q)).ravel())).reshape(d, -1) / n
        trace = sum(float(p[0]) for p in summed(fit, d, lambda x: np.array([float(centre.deviations(x).sum())]))) / n**3
        values, vectors, _ = lanczos(multiply, d, components, **options)
        sound = values > 1e-12 * values[0]
        values, vectors = values[sound], vectors[:, sound]
    k = len(values) if n else 0
    if not k:
        empty = own.select(*(f.name for f in schema[:-2])).where("false")
        return empty.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in NEW.items()))
    scaled = vectors / np.sqrt(values)

    def second(x: np.ndarray) -> np.ndarray:
        z = centre.apart(x) @ scaled
        return np.vstack([z.T @ z, z.sum(axis=0)]).ravel()

    moments = sum(summed(fit, d, second)).reshape(k + 1, k) / n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    names = [f.name for f in schema[:-2]]

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(len(names)), d)
            far = centre.deviations(x)
            far = pa.array([int(v) if v < 1 << 63 else None for v in far], pa.int64()) if far.dtype == object else pa.array(far)
            z = (centre.apart(x) @ scaled).ravel()
            z = pa.ListArray.from_arrays(pa.array(np.arange(0, len(z) + 1, k, dtype=np.int32)), pa.array(z))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], far, z], schema=common.arrow_schema(schema))

    out = own.select(*names, "__x").mapInArrow(project, schema).select("*", F.posexplode("z").alias("at", "whitened"))
    share = F.element_at(F.array(*(F.lit(float(e / trace)) for e in values)), F.col("at") + 1)
    new = {"component": F.col("at") + 1, "n": F.lit(n), "deviation": F.col("deviation"), "whitened": F.col("whitened"), "explained": share, "identity_error": F.lit(error)}
    return out.select(*names, *(new[name].cast(kind).alias(name) for name, kind in NEW.items()))


NEW = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
