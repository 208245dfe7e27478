"""Whitening of embeddings by matrix-free block Lanczos with full reorthogonalisation.

The covariance is never formed.  Each step multiplies it with a block of vectors in one distributed pass over the
centred rows, X'(XQ): a task keeps a matrix of dimension x block for all its rows, and Spark adds these up.  New
directions are made orthogonal to the whole basis, twice; one that the basis holds already (breakdown)
is replaced by a random one, and a basis that has reached its bound starts again from its best vectors.  The steps
end when the residuals of the wanted components, taken from the data in a pass of their own, are small.

Rows are whole numbers floor(256 c), so that sums and squared deviations are exact; the trace of the
covariance comes from the deviations and gives each component's share.  The driver holds vectors of the dimension only.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import staged, unstage

#: Steps of an entry of a vector in one.
SCALE = 256
COMPONENTS = 4
#: Vectors of a block, and of the basis at which it starts again.
BLOCK, MOST_BASIS = 16, 512
#: Largest residual of a component, as a share of the largest eigenvalue, and passes at most.
TOLERANCE, MOST_PASSES = 1e-13, 200
#: Eigenvalues up to this share of the trace for each dimension are rounding, not components.
NOISE = 1e-14
_ROWS = 4096
_LONG = 1 << 62


def _whole(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): vectors without null, NaN or infinite entries, as whole numbers."""
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    finite = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))  # a NaN is above all
    return rows.where(finite).select("key", F.transform(v, lambda c: F.floor(SCALE * c).cast("long")).alias("x"))


def _matrices(batches, column: int = 0, rows: int = _ROWS):
    """(slice of a batch, its vectors as a matrix of whole numbers), some thousand rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            x = part.column(column)
            yield part, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """x in a type in which numbers up to `most` do not overflow."""
    return x if most < _LONG else x.astype(object)


def _sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """(rows, exact sum of each dimension) of the fit list."""

    def add(batches):
        n, total = 0, [0] * dimension
        for _, x in _matrices(batches):
            n += len(x)
            total = [a + int(b) for a, b in zip(total, _exact(x, _most(x) * len(x)).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array([Decimal(t) for t in [n, *total]], pa.decimal128(38, 0))], ["i", "total"])

    rows = fit.mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()  # one for each dimension
    found = {r["i"]: int(r["total"]) for r in rows}
    return found.get(-1, 0), [found.get(i, 0) for i in range(dimension)]


class _Centred:
    """The fit list without its mean, as a linear operator."""

    def __init__(self, fit: DataFrame, n: int, sums: list[int]):
        self.fit, self.n, self.sums = fit, n, sums
        self.mean = np.array([s / n for s in sums])
        #: Passes over the rows so far.
        self.passes = 0

    def _added(self, of, shape: tuple[int, int]) -> np.ndarray:
        """Sum over all rows of of(centred rows), a matrix of this shape; one partial sum for each task."""
        mean = self.mean
        high, wide = shape

        def work(batches):
            total, some = np.zeros(shape), False
            for _, x in _matrices(batches):
                total += of(x - mean)
                some = True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(range(high), pa.int32()), *(pa.array(total[:, j]) for j in range(wide))], ["i", *(f"v{j}" for j in range(wide))])

        self.passes += 1
        parts = self.fit.mapInArrow(work, ", ".join(["i int", *(f"v{j} double" for j in range(wide))]))
        rows = parts.groupBy("i").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(wide))).collect()  # one for each row of the matrix
        out = np.zeros(shape)
        for r in rows:
            out[r["i"]] = r[1:]
        return out

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times a block of vectors."""
        return self._added(lambda x: x.T @ (x @ q), q.shape) / self.n

    def covariance_of(self, projection: np.ndarray) -> np.ndarray:
        """Covariance of the centred rows after a projection, centred anew."""
        k = projection.shape[1]

        def moments(x):
            y = x @ projection
            return np.vstack([y.T @ y, y.sum(axis=0)])

        total = self._added(moments, (k + 1, k)) / self.n
        return total[:k] - np.outer(total[k], total[k])


def _orthonormal(block: np.ndarray, basis: np.ndarray, wide: int, random: np.random.Generator) -> np.ndarray:
    """`wide` orthonormal vectors that are orthogonal to the basis and span the block as far as they can.

    Where the block has fewer directions of its own (breakdown), random ones take their place; fewer are given only if
    the basis and they fill the space.
    """
    dimension, room = basis.shape[0], min(wide, basis.shape[0] - basis.shape[1])
    out = np.zeros((dimension, 0))
    norms = np.linalg.norm(block, axis=0)
    candidates = [v / size for v, size in zip(block.T, norms, strict=True) if size > 1e-14 * norms.max(initial=0)]
    for _ in range(len(candidates) + 10 * wide):
        if out.shape[1] == room:
            break
        v = candidates.pop(0) if candidates else random.standard_normal(dimension) / np.sqrt(dimension)
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v - out @ (out.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-11:  # else rounding is all that is left of it
            v = v / left
            v = v - basis @ (basis.T @ v)
            v = v - out @ (out.T @ v)
            out = np.column_stack([out, v / np.linalg.norm(v)])
    return out


def block_lanczos(times, dimension: int, k: int, block: int = BLOCK, most_basis: int = MOST_BASIS, tolerance: float = TOLERANCE, most_passes: int = MOST_PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, eigenvectors in columns, largest residual) of the k largest of a symmetric operator.

    times(q) gives the operator times a block of vectors.  The projected matrix is that of all products with
    the basis, which full reorthogonalisation makes block tridiagonal up to rounding.
    """
    random = np.random.default_rng(seed)
    k, block = min(k, dimension), min(max(block, k), dimension)
    most_basis = max(most_basis, 3 * block)
    basis, images = np.zeros((dimension, 0)), np.zeros((dimension, 0))
    fresh = _orthonormal(random.standard_normal((dimension, block)), basis, block, random)
    for _ in range(most_passes):
        image = times(fresh)
        basis, images = np.column_stack([basis, fresh]), np.column_stack([images, image])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        wanted = inner[:, order[:k]]
        vectors = basis @ wanted
        residual = images @ wanted - vectors * values[order[:k]]
        worst = float(np.linalg.norm(residual, axis=0).max(initial=0))
        if basis.shape[1] >= dimension or basis.shape[1] >= k and worst <= tolerance * max(abs(values).max(), 1e-300):
            break
        if basis.shape[1] + block > most_basis:  # start again with the best vectors, whose images are known
            keep = order[: 2 * block]
            basis, images = basis @ inner[:, keep], images @ inner[:, keep]
            image = images - basis * values[keep]
        fresh = _orthonormal(image, basis, block, random)
        if not fresh.shape[1]:
            break
    return values[order[:k]], vectors, worst


class Whitening:
    """What was fitted: n and sums of the fit list, components by falling eigenvalue, their shares, and the error of the identity."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, identity_error: float, residual: float, passes: int):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        self.explained = values / trace if trace else values
        self.identity_error, self.residual, self.passes = identity_error, residual, passes

    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over the dimensions of (n x - S)**2, for each row."""
    most = n * _most(x) + max(map(abs, sums), default=0)
    wide = _exact(x, max(most * most * max(1, len(sums)), most))
    d = wide * n - np.array(sums, wide.dtype)
    return (d * d).sum(axis=1).tolist()


def _trace(fit: DataFrame, n: int, sums: list[int]) -> float:
    """Trace of the covariance, from the exact sum of the deviations."""

    def add(batches):
        total = sum(sum(_deviations(x, n, sums)) for _, x in _matrices(batches))
        low = 10**30  # sums of two parts, as a decimal has 38 digits
        yield pa.RecordBatch.from_arrays([pa.array([Decimal(total // low)], pa.decimal128(38, 0)), pa.array([Decimal(total % low)], pa.decimal128(38, 0))], ["high", "low"])

    r = fit.mapInArrow(add, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).first()
    return (int(r["high"] or 0) * 10**30 + int(r["low"] or 0)) / n**3


def fit_whitening(whole: DataFrame, k: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The whitening of the distinct vectors of whole (x array<long>); None without vectors."""
    fit = staged(whole.select("x").distinct(), "whitening-fit")
    sizes = fit.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if sizes["high"] is None:
        unstage(fit)
        return None
    if sizes["low"] != sizes["high"]:
        unstage(fit)
        raise ValueError(f"vectors have from {sizes['low']} to {sizes['high']} entries")
    dimension = sizes["high"]
    n, sums = _sums(fit, dimension)
    trace = _trace(fit, n, sums)
    centred = _Centred(fit, n, sums)
    values, vectors, residual = block_lanczos(centred.times, dimension, k, block)
    good = values > NOISE * dimension * trace
    values, vectors = values[good], vectors[:, good]
    error = 0.0
    if len(values):
        error = float(np.abs(centred.covariance_of(vectors / np.sqrt(values)) - np.eye(len(values))).max())
    unstage(fit)
    return Whitening(n, sums, values, vectors, trace, error, residual, centred.passes)


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """One row per remaining row of vectors and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped.  The fit list has each distinct vector
    once, so that copies weigh nothing, but every remaining row gets its own rows.  Components are numbered from
    1 by falling eigenvalue; an eigenvalue of 0 (fewer independent directions than k, or one distinct vector) is no
    component, so a table of equal vectors, like an empty one, gives no rows.  Vectors of equal eigenvalues are any
    orthonormal ones, the same for all rows.  Vectors of different lengths are an error.  deviation is null where it does
    not fit a long.  Other columns are ignored.
    """
    whole = _whole(vectors, key, vector)
    model = fit_whitening(whole, k, block)
    kind = vectors.select(key).schema[0].dataType.simpleString()
    names = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], names)
    n, sums, shares, error, found = model.n, model.sums, model.explained, model.identity_error, len(model.values)
    mean, projection = np.array([s / n for s in sums]), model.projection()

    def project(batches):
        for part, x in _matrices(batches, 1):
            y = (x - mean) @ projection
            times = np.repeat(np.arange(len(x)), found)
            deviation = pa.array([d if d < 1 << 63 else None for d in _deviations(x, n, sums)], pa.int64())
            columns = [part.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), len(x))), pa.array(np.full(len(times), n)), deviation.take(pa.array(times))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(y.reshape(-1)), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(times), error))], [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.select(F.col("key").alias(key), "x").mapInArrow(project, names)
