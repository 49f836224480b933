"""Embedding whitening by Chebyshev-filtered subspace iteration.

Method: the leading eigenvectors of the covariance V are found without forming V. A pass over the data multiplies V by a narrow matrix:
every block of rows is centred and adds ``Xc'(Xc Q)``, and Spark sums these. A polynomial recurrence over such passes filters an
orthonormal block of ``components + guard`` columns: the scaled Chebyshev polynomial of [0, a] stays small on the unwanted end of
the spectrum (a: the block's least Ritz value) and grows fast above it. QR and Rayleigh-Ritz follow, and
rounds go on until every wanted pair is certified: ``|V q - e q| <= tolerance * e1``. Pairs are certified from the first on; the others are
filtered in the complement of those, by a degree that grows no direction by more than ``GROWTH``, so that rounding errors along
much larger eigenvalues stay small. Where the residuals have reached the rounding floor of such
sums before, they are accepted below ``100 * tolerance``; a failure to get there is an error, never a result.

A pass reads blocks of whole numbers from a table in the shared folder; what tasks send is one matrix of dimensions x block columns each, summed
entry by entry in a shuffle, so the driver holds such a matrix and nothing that grows with the rows. Sums of components are exact
(halves of 26 bits, added as decimals), and rows are centred as ``(n x - S) / n`` from exact numerators, so the shift costs no digits.

Edge cases: vectors that are null or hold null or non-finite entries take no part; shorter vectors count as if their missing entries were 0;
entries beyond 2**46 in magnitude count as that; repeated rows, null and repeated ids are rows of their own; components whose eigenvalue is not above
``1e-11`` of the first are left out (there is nothing to scale), so equal vectors, a single vector and empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, saved, ship_by_value, small_batches

#: Bytes of a block of rows.
BLOCK_BYTES = 2 << 20
LARGEST = 1 << 52
#: Eigenvalues not above this share of the first count as zero.
NOTHING = 1e-11
#: How much more than the unwanted end of the spectrum a filter may grow a direction.
GROWTH = 1e8


def whole_rows(vectors: DataFrame, scale: int, shift: int, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, vector of longs) of the rows that take part."""
    column = quoted(vector_column)
    usable = F.col(column).isNotNull() & ~F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x: Column) -> Column:
        scaled = F.lit(float(scale)) * x.cast("double")
        return F.floor(F.greatest(F.least(scaled, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))) + F.lit(shift).cast("long")

    return vectors.where(usable).select(F.col(quoted(id_column)).cast("long").alias("vec_id"), F.transform(column, whole).alias("vector"))


def _pack(dims: int, fill: int):
    """Blocks of at most BLOCK_BYTES: ids, and a matrix of longs as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_BYTES // (8 * max(1, dims)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                vectors = part.column("vector")
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                rows = np.full((len(lengths), dims), fill, np.int64)
                rows[np.arange(dims) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([rows.tobytes()], pa.binary())], ["ids", "body"])

    return pack


def _summed(blocks: DataFrame, dims: int, size: int, add: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> list:
    """The sum over all blocks of ``add(rows)``, an array of ``size`` numbers; tasks add up their own blocks first."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for body in batch.column("body"):
                found = add(np.frombuffer(body.as_buffer(), np.int64).reshape(-1, dims))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64() if kind == "double" else pa.int64()))], ["parts"])

    entries = blocks.select("body").mapInArrow(partial, f"parts array<{kind}>").select(F.posexplode("parts").alias("at", "part"))
    exact = F.col("part") if kind == "double" else F.col("part").cast("decimal(38,0)")
    out = [0] * size
    for at, value in entries.groupBy("at").agg(F.sum(exact)).collect():  # one row per entry
        out[at] = value
    return out


def _halves(rows: np.ndarray) -> np.ndarray:
    """Exact column sums as high and low halves."""
    high = rows >> 26
    return np.concatenate((high.sum(axis=0), (rows - (high << 26)).sum(axis=0)))


@dataclass
class Whitening:
    """Sums and eigenpairs of a fit; ``components`` has a column per eigenvector, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    passes: int = 0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.values]


def numerators(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n x - S``: longs, or Python's whole numbers where these do not fit."""
    most = max(int(rows.max(initial=0)), -int(rows.min(initial=0)))
    if n * most < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return rows * np.int64(n) - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return numerators(rows, n, sums).astype(np.float64) / n


def deviations(rows: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of squares of the numerators as decimals; null where these exceed 38 digits."""
    found = numerators(rows, n, sums)
    if found.dtype != object and float(np.abs(found).max(initial=0)) ** 2 * max(1, found.shape[1]) < 2.0 ** 62:
        return pa.array((found * found).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0), safe=False)
    squares = [sum(v * v for v in row) for row in found.astype(object).tolist()]
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in squares], pa.decimal128(38, 0))


def growth(value: float, cut: float) -> float:
    """By how much each degree of the Chebyshev polynomial of [0, cut] grows a direction of this eigenvalue."""
    t = 2 * value / cut - 1
    return t + np.sqrt(max(t * t - 1, 0.0))


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, cut: float, first: float, degree: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of V on ``q``, small on [0, cut]; ``vq`` is V q and ``first`` about the largest eigenvalue."""
    half = cut / 2
    sigma = half / (first - half)
    tau = 2 / sigma
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (tau - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - (sigma * following) * before
        sigma = following
    return now


def outside(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y`` without its part in the span of the orthonormal ``q``."""
    return y - q @ (q.T @ y)


def fit(blocks: DataFrame, dims: int, components: int = 32, guard: int = 16, degree: int = 12, tolerance: float = 1e-14,
        max_rounds: int = 60, seed: int = 11) -> Whitening | None:
    """The whitening of all rows of ``blocks``; None where there is nothing to whiten."""
    n = blocks.agg(F.sum(F.size("ids").cast("long"))).first()[0] or 0
    if not n or not dims:
        return None
    halves = [int(v) for v in _summed(blocks, dims, 2 * dims, _halves, "bigint")]
    sums = [(h << 26) + low for h, low in zip(halves[:dims], halves[dims:])]
    trace = _summed(blocks, dims, 1, lambda rows: np.array([np.square(centred(rows, n, sums)).sum()]))[0] / n
    if not trace:
        return None
    passes = 0

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(rows: np.ndarray) -> np.ndarray:
            x = centred(rows, n, sums)
            return (x.T @ (x @ q)).ravel()

        return np.array(_summed(blocks, dims, q.size, product)).reshape(q.shape) / n

    width = min(dims, components + guard)
    wanted = min(dims, components)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    least = np.inf
    for _ in range(max_rounds):
        vq = times(q)
        ritz = q.T @ vq
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted] / values[0]
        residual = float(residuals.max())
        if residual <= tolerance or (residual <= 100 * tolerance and residual > least / 2):
            break
        least = min(least, residual)
        done = int(np.argmax(residuals > tolerance))  # certified, from the first on
        rest, cut = q[:, done:], float(values[-1])
        if cut <= NOTHING * values[0]:  # a block beyond the rank of V has its whole range after one product
            rest = vq[:, done:]
        else:
            most = int(np.log(GROWTH) / np.log(max(growth(values[done], cut), 1 + 1e-9)))
            rest = filtered(lambda y: outside(q[:, :done], times(y)), rest, vq[:, done:], cut, float(values[done]), max(1, min(degree, most)))
        q = np.linalg.qr(np.hstack((q[:, :done], outside(q[:, :done], rest))))[0]
    else:
        raise RuntimeError(f"residual {least} after {max_rounds} rounds")
    kept = int((values[:wanted] > NOTHING * values[0]).sum())
    model = Whitening(n, sums, q[:, :kept], values[:kept], trace, passes=passes)
    scaled = model.components / np.sqrt(model.values)

    def covariance(rows: np.ndarray) -> np.ndarray:
        w = centred(rows, n, sums) @ scaled
        return (w.T @ w).ravel()

    found = np.array(_summed(blocks, dims, kept * kept, covariance)).reshape(kept, kept) / n
    model.identity_error = float(np.abs(found - np.eye(kept)).max())
    return model


def project(blocks: DataFrame, dims: int, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal) and whitened (array) of every row of the blocks."""
    n, sums, scaled = model.n, model.sums, model.components / np.sqrt(model.values)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, body in zip(batch.column("ids"), batch.column("body")):
                rows = np.frombuffer(body.as_buffer(), np.int64).reshape(-1, dims)
                w = centred(rows, n, sums) @ scaled
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([ids.values, deviations(rows, n, sums), lists], ["vec_id", "deviation", "whitened"])

    return blocks.mapInArrow(apply, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_column: str = "vec_id",
           vector_column: str = "embedding", **options) -> tuple[DataFrame, Whitening | None]:
    """vec_id, deviation and whitened of every vector that takes part, and the fit (``options``: those of ``fit``).

    Components become ``floor(scale * c) + shift``; n, sums and deviations are exact in these.
    """
    small_batches(vectors.sparkSession)
    rows = whole_rows(vectors, scale, shift, id_column, vector_column)
    dims = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    blocks = saved(rows.mapInArrow(_pack(dims, shift), "ids array<long>, body binary"), "whitening-blocks")
    model = fit(blocks, dims, components, **options)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, deviation decimal(38,0), whitened array<double>"), None
    return project(blocks, dims, model), model


ship_by_value(__name__)
