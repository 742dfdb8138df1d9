"""Whitening of vectors on their leading principal components by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass over the vectors gives XᵀXQ for a narrow block Q, X centred, summed over all
partitions by Spark. A Chebyshev recurrence over such passes damps the unwanted spectrum, then a QR and a
Rayleigh-Ritz step on the driver, which only holds blocks of the dimensions by some thirty columns, give the Ritz
pairs. This goes on until the residuals certify the wanted pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import slices
from twinsift.stash import Stash

#: Columns of the block beyond the wanted components, Lanczos steps for the lower end of the spectrum, and passes of a filter.
GUARD, LANCZOS, DEGREE = 28, 8, 12
#: Growth of the wanted part in one filter, beyond which rounding would drown the others, and filters before giving up.
GROWTH, FILTERS = 1e8, 200
#: Entries of a block of vectors that a task multiplies at once, and of one that is stored as one value.
ENTRIES, STORED = 4_000_000, 250_000


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``basis`` has the components as columns, ``values`` their variances; nothing here grows with the rows."""

    dims: int
    n: int
    sums: tuple[int, ...]
    basis: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(vector: str, scale: float = 256.0) -> Column:
    """``floor(scale * c)`` of every entry c as double, as longs; null where the vector is null, empty or not finite throughout."""
    entry = F.col(vector).cast("array<double>")
    usable = (F.size(entry) > 0) & F.forall(entry, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    return F.when(usable, F.transform(entry, lambda c: F.floor(c * F.lit(float(scale)))))


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _packed(vectors: DataFrame, dims: int) -> DataFrame:
    """``(kind, block)``: blocks of vectors as bytes of the narrowest whole numbers, as every pass reads them again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, STORED // dims)):
            x = _rows(batch.column(0), dims)
            if len(x):
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([x.astype(kind).tobytes()])], ["kind", "block"])

    return vectors.select("x").mapInArrow(run, "kind string, block binary")


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, block in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(block.as_buffer(), kind).reshape(-1, dims).astype(np.int64)


def _sums(fit: DataFrame, dims: int, width: int, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``work(block)`` over all vectors; partitions send ``width`` numbers each, which Spark adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for x in _blocks(batches, dims):
            total += work(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["key", "value"])

    rows = fit.mapInArrow(run, "key int, value double").groupBy("key").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r.key] = r.value
    return out


def _counts(fit: DataFrame, dims: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dims + 1)
        for x in _blocks(batches, dims):
            small = max(abs(int(x.min())), abs(int(x.max()))) < 2**40
            for i, s in enumerate(x.sum(0) if small else x.astype(object).sum(0)):
                total[i] += int(s)
            total[dims] += len(x)
        value = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), value], ["key", "value"])

    rows = fit.mapInArrow(run, "key int, value decimal(38,0)").groupBy("key").agg(F.sum("value").alias("value")).collect()
    by_key = {r.key: int(r.value) for r in rows}
    return by_key.get(dims, 0), tuple(by_key.get(i, 0) for i in range(dims))


def least_value(apply: Callable[[np.ndarray], np.ndarray], dims: int, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """A value that hardly an eigenvalue lies below: the least of some Lanczos steps less the last residual, 0 at least."""
    basis = np.zeros((dims, 0))
    v = rng.standard_normal(dims)
    v /= np.linalg.norm(v)
    diagonal, beside = [], []
    for _ in range(min(steps, dims)):
        basis = np.column_stack([basis, v])
        w = apply(v[:, None])[:, 0]
        diagonal.append(float(v @ w))
        for _ in range(2):
            w -= basis @ (basis.T @ w)
        beside.append(float(np.linalg.norm(w)))
        if beside[-1] <= 1e-12 * max(map(abs, diagonal)):
            break
        v = w / beside[-1]
    t = np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - beside[-1])


def leading_pairs(
    apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, guard: int = GUARD, seed: int = 11
) -> tuple[np.ndarray, np.ndarray, float]:
    """Leading eigenvectors, their eigenvalues and the largest residual of a symmetric operator without negative ones.

    ``apply(Q)`` is one pass. Pairs are certified from the first on: their residual is at the level of rounding or,
    once below 1e-10 of the largest value, falls no more. Certified pairs are kept and projected out of the others, so
    that a filter's degree can follow the spread of those that remain. The columns of the random block beyond the
    wanted ones show that no larger pair was missed. A block as wide as the space needs no filter.
    """
    rng = np.random.default_rng(seed)
    k = min(dims, wanted + guard)
    q = np.linalg.qr(rng.standard_normal((dims, k)))[0]
    y = apply(q)
    low = least_value(apply, dims, rng) if k < dims else 0.0
    done, before = 0, np.full(k, np.inf)
    for _ in range(FILTERS):
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, y = q @ turn, y @ turn
        residual = np.linalg.norm(y - q * values, axis=0)
        top = max(abs(values[0]), np.finfo(float).tiny)
        exact = residual <= 16 * np.finfo(float).eps * top
        stuck = (residual <= 1e-10 * top) & (residual > before / 2)
        done = 0
        while done < wanted and (exact[done] or stuck[done]):
            done += 1
        if done == wanted or k == dims:
            return q[:, :wanted], values[:wanted], float(residual[:wanted].max())
        before = residual
        sure = int(np.argmin(np.append(residual <= 1e-10 * top, False)))  # leading pairs to project out
        fixed, free = q[:, :sure], slice(sure, k)
        first, last = values[min(sure, wanted - 1)], values[wanted - 1]
        high = min(values[k - 1], last - 0.02 * (last - low))
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-12 * top)
        far = max((first - centre) / half, 1 + 1e-6)
        degree = int(np.clip(np.log(2 * GROWTH) / np.arccosh(far), 1, DEGREE))
        old, new = q[:, free], (y[:, free] - centre * q[:, free]) / half
        for _ in range(degree - 1):
            new -= fixed @ (fixed.T @ new)
            old, new = new, 2 * (apply(new) - centre * new) / half - old
        new -= fixed @ (fixed.T @ new)
        q = np.linalg.qr(np.column_stack([fixed, np.linalg.qr(new)[0]]))[0]
        y = apply(q)
    raise RuntimeError("the leading components could not be certified")


def fit(vectors: DataFrame, components: int = 4, vec_col: str = "embedding", scale: float = 256.0, guard: int = GUARD) -> Whitening | None:
    """Fits on each distinct quantised vector once; ``None`` if no vector is usable.

    Vectors that are null, empty or hold null or non-finite entries are left out, and so are those that have not the
    commonest number of dimensions (of equally common ones the largest). Repeated vectors count once, so no mass of
    copies moves the components. Components are numbered by falling variance; their largest entry is positive.
    """
    stash = Stash(vectors.sparkSession)
    listed = vectors.select(quantised(vec_col, scale).alias("x")).where(F.col("x").isNotNull())
    written = stash.put(listed.distinct(), "fit")
    sizes = written.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    dims = sizes.d
    listed = stash.put(_packed(written.where(F.size("x") == dims), dims), "blocks")
    stash.drop(written)
    n, sums = _counts(listed, dims)
    mean = np.array([s / n for s in sums])
    passes = 0

    def apply(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def work(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return _sums(listed, dims, q.size, work).reshape(q.shape) / n

    def square(x: np.ndarray) -> np.ndarray:
        c = x - mean
        return np.array([np.einsum("ij,ij->", c, c)])

    trace = float(_sums(listed, dims, 1, square)[0]) / n
    m = min(components, dims)
    basis, values, residual = leading_pairs(apply, dims, m, guard) if trace > 0 else (np.eye(dims)[:, :m], np.zeros(m), 0.0)
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), range(m)])
    values = np.where(values > 64 * np.finfo(float).eps * trace, values, 0.0)
    spread = np.flatnonzero(values)
    error = None
    if len(spread):
        to = basis[:, spread] / np.sqrt(values[spread])

        def gram(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ to
            return w.T @ w

        error = float(np.abs(_sums(listed, dims, len(spread) ** 2, gram).reshape(len(spread), -1) / n - np.eye(len(spread))).max())
    stash.drop(listed)
    return Whitening(dims, n, sums, basis, values, trace, error, residual, passes)


def transform(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """One row for every usable vector, repeated ones too, and every component of the model.

    Columns: ``vec_id, component`` (from 1), ``n`` (vectors of the fit), ``deviation`` (sum over dimensions of
    (n x - S)², exact; null beyond a long), ``whitened`` (null for a component without variance), ``explained`` (null
    if nothing varies) and ``identity_error``. Vectors that :func:`fit` leaves out have no rows, null ids are kept,
    and other columns are not read. Without a model there are no rows.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, dims, m = model.n, model.dims, len(model.values)
    mean, sums, biggest = model.mean, model.sums, max(map(abs, model.sums))
    shares = [v / model.trace if model.trace > 0 else None for v in model.values.tolist()]
    to = model.basis / np.sqrt(np.where(model.values > 0, model.values, 1.0))
    flat, error = model.values == 0, model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        bound = n * max(abs(int(x.min())), abs(int(x.max()))) + biggest
        d = x * n - np.array(sums) if bound * bound * dims < 2**62 else x.astype(object) * n - np.array(sums, object)
        return [v if v < 2**63 else None for v in map(int, (d * d).sum(1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(1, ENTRIES // dims // 4)):
            x = _rows(batch.column(1), dims)
            rows = len(x)
            if not rows:
                continue
            w = (x - mean) @ to
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), m))),
                pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * m, n, np.int64)),
                pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), m))),
                pa.array(w.ravel(), mask=np.tile(flat, rows)),
                pa.array(shares * rows, pa.float64()),
                pa.array([error] * (rows * m), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema_names)

    schema_names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = vectors.select(F.col(id_col).alias("vec_id"), quantised(vec_col, scale).alias("x"))
    return rows.where(F.col("x").isNotNull() & (F.size("x") == dims)).mapInArrow(run, schema)


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """:func:`fit` and :func:`transform` on the same table; an empty table gives no rows."""
    return transform(vectors, fit(vectors, components, vec_col, scale), id_col, vec_col, scale)
