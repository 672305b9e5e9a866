"""Whitening of vectors by shifted Cholesky QR.

Of the centred vectors X, one a row, ``X = Q R`` is found by passes that each measure the products of the columns (the Gram matrix) of what the
triangular solves so far have made of X. Its Cholesky factor is the next solve; in the first pass the matrix is shifted, so that
it has one whatever X is. When the columns are nearly orthonormal, the last factor makes them so. The factors composed are R, and the
singular values and right vectors of R, which is as small as a vector is long, are those of X.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
UNIT = float(np.finfo(float).eps)
CLOSE = 1e-9  # of the Gram matrix to the identity; the factor of one so close leaves an error of its square
PASSES = 12
ROWS = 4096  # vectors taken at a time
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
          "deviation_wide decimal(38,0)")


def _whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and scaled entries, as longs, of the vectors that are there and finite; one group for each length."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.nonzero(sizes == size)[0]
        rows = values[starts[at][:, None] + np.arange(size)]
        good = np.isfinite(rows).all(axis=1)
        scaled = np.floor(SCALE * rows[good])
        if (np.abs(scaled) > 1 << 52).any():
            raise ValueError("an entry is too large to be scaled")
        yield at[good], scaled.astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            for at, x in _whole(part.column(column)):
                if len(x):
                    yield part, at, x


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for _, _, x in _blocks(batches, 0):
        held = found.setdefault(x.shape[1], [0, 0])
        held[0] += len(x)
        held[1] = held[1] + x.sum(axis=0)
    for size, (n, sums) in found.items():
        yield pa.RecordBatch.from_pydict({"size": np.full(size + 1, size), "at": np.arange(-1, size), "value": np.append(n, sums)})


def _solved(x: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """``x`` times the inverses of upper triangular factors, one after the other."""
    for r in factors:
        q = np.empty_like(x)
        for j in range(len(r)):
            q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        x = q
    return x


def _gram(vectors: DataFrame, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums of the products of the columns that ``prepare`` makes of scaled vectors. A task hands on one matrix; Spark adds them up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, x in _blocks(batches, 0):
            y = prepare(x)
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "value": total[i, j]})

    rows = vectors.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (rows.column(c).to_numpy() for c in ("i", "j", "value"))
    whole = np.zeros((i.max() + 1, i.max() + 1))
    whole[i, j] = whole[j, i] = value
    return whole


def _root(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def triangular(gram_of: Callable[[list[np.ndarray]], np.ndarray], n: int) -> tuple[np.ndarray, int]:
    """R of the rows whose Gram matrix, after triangular solves, is ``gram_of``; and the passes it took.

    Columns that depend on each other never become orthonormal. Then, after ``PASSES``, the root of what they have become closes R.
    """
    factors: list[np.ndarray] = []
    composed = None
    for number in range(PASSES):
        gram = gram_of(factors)
        size = len(gram)
        composed = np.eye(size) if composed is None else composed
        apart = np.abs(gram - np.eye(size)).max()
        shift = 11 * (n * size + size * (size + 1)) * UNIT * np.trace(gram) if number == 0 else 0.0
        try:
            factor = np.linalg.cholesky(gram + min(shift, 0.01 * np.trace(gram)) * np.eye(size)).T
        except np.linalg.LinAlgError:
            if np.trace(gram) <= 0:
                return np.zeros((size, size)), number + 1
            factor = np.linalg.cholesky(gram + 1e-8 * np.trace(gram) * np.eye(size)).T
        else:
            if number and apart <= CLOSE:
                return factor @ composed, number + 1
        factors.append(factor)
        composed = factor @ composed
    return _root(gram_of(factors)) @ composed, PASSES + 1


@dataclass
class Whitening:
    """``components`` has a unit vector a column, by falling eigenvalue; ``deviations`` are the roots of the eigenvalues, zero where rows
    don't differ; ``passes`` over the vectors found them."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The whitened components of scaled vectors; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.deviations > 0, self.centred(x) @ self.components / self.deviations, np.nan)


def fit(vectors: DataFrame, components: int = 8) -> Whitening | None:
    """The whitening of the one column of ``vectors``; None without any. Vectors of several lengths are an error."""
    rows = vectors.mapInArrow(_count, "size long, at long, value long").groupBy("size", "at").agg(F.sum("value").alias("value"))
    sizes = rows.where("at = -1").limit(2).collect()
    if not sizes:
        return None
    if len(sizes) > 1:
        raise ValueError("the vectors differ in length")
    n = sizes[0]["value"]
    sums = np.zeros(sizes[0]["size"], np.int64)
    for row in rows.where("at >= 0").collect():
        sums[row["at"]] = row["value"]
    centred = lambda x: (n * x - sums) / n
    r, passes = triangular(lambda factors: _gram(vectors, lambda x: _solved(centred(x), factors)), n)
    _, singular, right = np.linalg.svd(r)
    spread = np.where(singular > len(sums) * 1e-14 * max(singular[0], 1e-300), singular, 0.0)
    total = (singular ** 2).sum()
    k = min(components, len(sums))
    return Whitening(n, sums, right[:k].T, spread[:k] / np.sqrt(n), spread[:k] ** 2 / total if total else np.zeros(k), passes)


def identity_error(vectors: DataFrame, fitted: Whitening) -> float:
    """How far the covariance of the whitened vectors, over all of them, is from the identity at most; components without variance left out."""
    live = fitted.deviations > 0
    if not live.any():
        return 0.0
    whole = _gram(vectors, lambda x: np.column_stack([np.ones(len(x)), fitted.whiten(x)[:, live]])) / fitted.n
    mean = whole[0, 1:]
    return float(np.abs(whole[1:, 1:] - np.outer(mean, mean) - np.eye(live.sum())).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    apart = n * x - sums
    if np.abs(apart).max() ** 2.0 * x.shape[1] < 2.0 ** 62:
        return (apart * apart).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in apart.tolist()]


def _whitened(fitted: Whitening, error: float):
    k = len(fitted.deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at, x in _blocks(batches, 1):
            found = fitted.whiten(x)
            far = np.repeat(np.array(_deviations(x, fitted.n, fitted.sums), object), k).tolist()
            each = lambda values: np.tile(values, len(x))
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(at, k))), pa.array(each(np.arange(1, k + 1)).astype(np.int32)),
                pa.array(np.full(len(far), fitted.n)), pa.array([v if v < 1 << 63 else None for v in far], pa.int64()),
                pa.array(found.ravel(), from_pandas=True), pa.array(each(fitted.explained)), pa.array(np.full(len(far), error)),
                pa.array(far, pa.decimal128(38, 0))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"])

    return run


def whiten(vectors: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide)`` of every vector and its first ``components``.

    Vectors that are NULL or empty, or hold a NULL, a NaN or an infinity, are left out; repeated rows and NULL ids count like others, other
    columns are not read. An entry c is taken as floor(1024 c) + 100000. ``deviation`` is the sum over the entries x of (n x - S)^2, NULL where 64
    bits don't hold it; ``deviation_wide`` always has it. ``whitened`` is NULL in a component without variance (fewer
    different vectors than components). An empty table gives an empty result. Runs jobs when called.
    """
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    only = read.select("vector")
    fitted = fit(only, components)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    return read.mapInArrow(_whitened(fitted, identity_error(only, fitted)), SCHEMA)
