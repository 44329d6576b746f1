"""Whitening of embeddings onto their leading principal components.

Randomised range finder: a random block of more directions than components asked for is multiplied by the covariance again
and again, each time in one pass over all centred rows, and made orthonormal between passes. Rayleigh-Ritz in its span gives
components, whose residuals are then measured; if one isn't an eigenvector to double precision, the block grows to all
dimensions, where the span is everything and Rayleigh-Ritz is exact.

A pass adds up, in each task, a matrix of dimensions by directions, whatever the number of rows; Spark sums these by
dimension. The driver sees sums of this size only. Entries are whole numbers near 1,000,000: they are centred by the whole
number nearest to their mean first, so that products stay small and exact, and the fraction that is left is taken off the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMPONENTS, OVERSAMPLING, PASSES = 32, 10, 3
SCALE, OFFSET = 64, 1_000_000
#: A component's error, residual by distance to the next eigenvalue, up to which it counts as exact.
TOLERANCE = 1e-10
#: Eigenvalues below this share of the largest are noise of rounding: there is nothing to scale up.
RANK = 1e-12
#: Entries that a whole number holds exactly.
_MOST = float(2**53)
#: Rows that are multiplied at a time, so that no batch grows with the row's dimensions.
ROWS = 4096


def whole_vectors(vectors: Column) -> Column:
    """floor(64 c) + 1000000 of each entry."""
    return F.transform(vectors, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(OFFSET).cast("long"))


def _usable(vectors: Column) -> Column:
    inside = lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < _MOST, F.lit(False)) & ~F.isnan(c)
    return vectors.isNotNull() & (F.size(vectors) > 0) & F.forall(vectors, inside)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            yield batch.slice(i, ROWS)


@dataclass
class Fit:
    """Length, rows n, exact sums S, the whole number nearest to each mean and what is left of it; components in columns."""

    length: int
    n: int
    sums: list[int]
    near: np.ndarray
    rest: np.ndarray
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0
    block: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.rest


def _summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of matrices of ``width`` columns; ``part`` gives that of a batch of whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in _batched(batches):
            if len(batch):
                one = part(_matrix(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select("x").mapInArrow(run, "i int, v array<double>")
    sums = parts.groupBy("i").agg(F.array(*(F.sum(F.col("v")[j]) for j in range(width))).alias("v"))
    return np.array([r["v"] for r in sums.orderBy("i").collect()])  # a row a dimension


def _moments(rows: DataFrame) -> Fit | None:
    """The commonest length (of equally common ones the largest), its rows and their exact sums, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in _batched(batches):
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            for d in set(sizes.tolist()):
                x = _matrix(batch.column(0).filter(pa.array(sizes == d)))
                # Halves of the numbers can't overflow, whatever they are.
                low, high = (x & 0xFFFFFFFF).sum(axis=0).tolist(), (x >> 32).sum(axis=0).tolist()
                n, sums = found.get(d, (0, [0] * d))
                found[d] = n + len(x), [s + a + (b << 32) for s, a, b in zip(sums, low, high, strict=True)]
        for d, (n, sums) in found.items():
            yield pa.RecordBatch.from_pydict({"length": [d] * d, "i": [*range(d)], "n": [n] * d, "s": [str(s) for s in sums]})

    parts = rows.select("x").mapInArrow(run, "length long, i long, n long, s string")
    sums = parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    top = sums.where("i = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if top is None:
        return None
    own = [int(r["s"]) for r in sums.where(F.col("length") == top["length"]).orderBy("i").collect()]
    near = [(2 * s + top["n"]) // (2 * top["n"]) for s in own]
    rest = [(s - top["n"] * m) / top["n"] for s, m in zip(own, near, strict=True)]
    return Fit(top["length"], top["n"], own, np.array(near, np.int64), np.array(rest))


def _times(rows: DataFrame, fit: Fit, q: np.ndarray | None) -> np.ndarray:
    """Covariance times ``q`` (None: the covariance itself), in one pass; the last column has each dimension's variance."""
    near = fit.near

    def part(x: np.ndarray) -> np.ndarray:
        y = (x - near).astype(np.float64)
        return np.column_stack((y.T @ (y if q is None else y @ q), (y * y).sum(axis=0)))

    total = _summed(rows, (fit.length if q is None else q.shape[1]) + 1, part) / fit.n
    left = fit.rest if q is None else fit.rest @ q
    return np.column_stack((total[:, :-1] - np.outer(fit.rest, left), total[:, -1] - fit.rest**2))


def _ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and vectors in the span of ``q``, and the length of each one's residual."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = q @ turn
    return values, vectors, np.linalg.norm(vq @ turn - vectors * values, axis=0)


def fitted(rows: DataFrame, components: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES, seed: int = 11) -> Fit | None:
    """The fit of the whole vectors ``x`` of ``rows``, None if there is none."""
    fit = _moments(rows)
    if fit is None:
        return None
    rows, d = rows.where(F.size("x") == fit.length), fit.length
    block = min(d, components + oversampling)
    if block < d:
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
        for _ in range(passes):
            q = np.linalg.qr(_times(rows, fit, q)[:, :-1])[0]
        product = _times(rows, fit, q)
        values, vectors, residual = _ritz(q, product[:, :-1])
        gap = np.abs(values[:components, None] - values[None, :])
        gap[np.arange(components), np.arange(components)] = np.inf
        real = values[:components] > RANK * max(values[0], 0)
        if (residual[:components] > TOLERANCE * gap.min(axis=1))[real].any():
            block = d
    if block == d:
        product = _times(rows, fit, None)
        values, vectors, _ = _ritz(np.eye(d), product[:, :-1])
    keep = np.flatnonzero(values[:components] > RANK * max(values[0], 0))
    fit.values, fit.components, fit.trace, fit.block = values[keep], vectors[:, keep], float(product[:, -1].sum()), block
    if len(keep):
        fit.identity_error = _identity_error(rows, fit)
    return fit


def _projected(fit: Fit, x: np.ndarray) -> np.ndarray:
    return fit.centred(x) @ fit.components / np.sqrt(fit.values)


def _identity_error(rows: DataFrame, fit: Fit) -> float:
    """Measured on all rows: the means of whitened columns are taken off their products."""
    k = len(fit.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = _projected(fit, x)
        return np.vstack((w.T @ w, w.sum(axis=0)))

    total = _summed(rows, k, part) / fit.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _deviations(fit: Fit, x: np.ndarray) -> list[int]:
    """Sum of (n x - S)^2 of each row, exact."""
    sums = fit.sums
    most = max(max(abs(fit.n * int(a) - s), abs(fit.n * int(b) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), sums, strict=True))
    if len(sums) * most * most < 2**63 and max(map(abs, sums)) < 2**62 and fit.n * int(np.abs(x).max()) < 2**62:
        far = x * fit.n - np.array(sums, np.int64)
        return (far * far).sum(axis=1).tolist()
    return [sum((fit.n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, **fit_options: int) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null, empty, or hold null, NaN, infinite entries or such of more than 2^53 / 64 are left out, and so are
    those whose length isn't the table's commonest. Repeated rows count and are returned as often as they stand there; a null key
    stays. There are at most as many components as V has eigenvalues above RANK of its largest; equal vectors only, one vector
    or none give no rows. A deviation beyond a long fails the job instead of giving another number. Other columns aren't read.
    """
    rows = vectors.where(_usable(F.col(vector))).select(F.col(key).alias("key"), whole_vectors(F.col(vector)).alias("x"))
    kind = vectors.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    fit = fitted(rows, components, **fit_options)
    if fit is None or not len(fit.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(fit.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batched(batches):
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            m = len(x)
            places = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(places), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n), pa.array(_deviations(fit, x), pa.int64()).take(places),
                _projected(fit, x).reshape(-1), np.tile(fit.values / fit.trace, m), np.full(m * k, fit.identity_error),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema.names)

    return rows.where(F.size("x") == fit.length).mapInArrow(run, schema)
