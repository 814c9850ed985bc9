"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers; the fit list has each distinct one once. Rows, centred, are made orthogonal in passes:
each pass sums the Gram matrix of the rows over all tasks, factors it on the driver (d x d, whatever the rows), and the
next one reads the rows again and takes them through the triangular solves of all factors so far. The product of the
factors is the R of the centred rows; its singular values and vectors are the components.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import session, stored

#: Parts of a unit that entries are rounded down to.
SCALE = 256
COMPONENTS = 4
#: Entries beyond this are held to it: further whole numbers have no doubles of their own.
LARGEST = float(1 << 53)
#: Rows are orthogonal when no entry of their Gram matrix is further from the identity's.
NEAR = 1e-12
MOST_PASSES = 8
#: Singular values below this share of the largest, times the dimension, are those of no component.
RANK_SHARE = 2.0**-50


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): vectors as whole numbers x = floor(scale * entry), without null vectors and those with null or non-finite entries."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    kept = rows.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(fine(c), F.lit(False))))
    within = lambda c: F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST))
    return kept.select("id", F.transform("v", lambda c: F.floor(within(c))).alias("x"))


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _exact(a: np.ndarray, most: int) -> np.ndarray:
    """The same whole numbers, as Python's own where results up to `most` don't fit 63 bits."""
    return a if most < 1 << 62 else a.astype(object)


def _summed(parts: DataFrame, kind: str) -> dict:
    """Sums by place over all tasks; each task gives one row a place, so what comes to the driver has as many rows as places."""
    return dict(parts.groupBy("place").agg(F.sum("value").cast(kind).alias("value")).collect())


def moments(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums of each dimension."""
    import pyarrow as pa

    def run(batches):
        n, total = 0, [0] * dim
        for b in batches:
            x = _matrix(b.column(0), dim)
            if len(x):
                n += len(x)
                own = _exact(x, int(np.abs(x).max()) * len(x)).sum(axis=0)
                total = [a + int(s) for a, s in zip(total, own, strict=True)]
        yield pa.RecordBatch.from_pydict({"place": pa.array(range(-1, dim), pa.int32()), "value": pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))})

    got = _summed(fit.select("x").mapInArrow(run, "place int, value decimal(38,0)"), "decimal(38,0)")
    return int(got.get(-1, 0)), [int(got.get(k, 0)) for k in range(dim)]


def _solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular matrix, a column after the other."""
    out = np.empty_like(rows)
    for j in range(r.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def gram(fit: DataFrame, mean: np.ndarray, dim: int, through) -> np.ndarray:
    """The sum over all rows of through(x - mean) times itself; `through` gives rows of some width."""
    import pyarrow as pa

    width = through(np.zeros((1, dim))).shape[1]
    upper = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            own = through(_matrix(b.column(0), dim) - mean)
            total += own.T @ own
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(upper[0])), pa.int32()), "value": pa.array(total[upper], pa.float64())})

    got = _summed(fit.select("x").mapInArrow(run, "place int, value double"), "double")
    out = np.zeros((width, width))
    out[upper] = [got.get(k, 0.0) for k in range(len(upper[0]))]
    return out + np.triu(out, 1).T


def triangular(fit: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    """A matrix R with RᵀR = AᵀA for the centred rows A, to the precision of doubles also where A is badly conditioned.

    The first factor, and any whose Gram matrix has no Cholesky factor, is that of the matrix shifted by little; further
    passes mend what the shift left. What rows of less than full rank never reach is taken up by the root of the last
    Gram matrix.
    """
    dim = len(mean)
    factors: list[np.ndarray] = []
    r, g = np.eye(dim), np.eye(dim)
    for k in range(MOST_PASSES):
        done = list(factors)

        def through(a: np.ndarray) -> np.ndarray:
            for f in done:
                a = _solve(a, f)
            return a

        g = gram(fit, mean, dim, through)
        if not np.trace(g) or (k and np.abs(g - np.eye(dim)).max() < NEAR):
            break
        if k == MOST_PASSES - 1:
            break
        shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * np.trace(g)
        try:
            if k == 0:
                raise np.linalg.LinAlgError
            f = np.linalg.cholesky(g).T
        except np.linalg.LinAlgError:
            f = np.linalg.cholesky(g + min(shift, np.trace(g)) * np.eye(dim)).T
        factors.append(f)
        r = f @ r
    value, vector = np.linalg.eigh(g)
    return np.sqrt(np.maximum(value, 0))[:, None] * (vector.T @ r)


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (rows), eigenvalues and shares of the variance of the largest components of R; the largest entry of a direction is positive."""
    _, s, v = np.linalg.svd(r)
    k = min(most, int((s > s[0] * len(s) * RANK_SHARE).sum()) if s[0] > 0 else 0)
    v = v[:k]
    if k:
        v = v * np.sign(v[np.arange(k), np.abs(v).argmax(axis=1)])[:, None]
    e = s**2 / n
    return v, e[:k], e[:k] / e.sum() if k else e[:k]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    Rows with a null vector, or a null or non-finite entry, are dropped; so are empty vectors and those of another length
    than most have (of lengths equally common the largest counts). A component without variance isn't given: equal
    vectors, or an empty table, give no rows. Rows with null or repeated ids are given like others. Entries are held to
    2^53 after scaling. `deviation` is exact, as a decimal of 38 digits (null beyond). Extra columns are not read.
    """
    import pyarrow as pa

    session(rows)
    every = whole_vectors(rows, id_col, vector_col, scale)
    kind = dict(every.dtypes)["id"]
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    length = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    none = every.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    if length is None:
        return none
    dim = length.d
    every = every.where(F.size("x") == dim)
    fit = stored(every.select("x").distinct(), "fit")
    n, total = moments(fit, dim)
    mean = np.array([s / n for s in total])
    v, e, share = components(triangular(fit, n, mean), n, most)
    if not len(v):
        return none
    project = (v / np.sqrt(e)[:, None]).T
    error = float(np.abs(gram(fit, mean, dim, lambda a: a @ project) / n - np.eye(len(v))).max())
    kept, far = len(v), max(map(abs, total))

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), dim)
            if not len(x):
                continue
            most_off = n * int(np.abs(x).max()) + far
            # n * x - S fits 63 bits or is worked out in whole numbers without bound
            off = _exact(x, max(most_off, most_off**2 * dim)) * n - np.array(total, dtype=object if most_off**2 * dim >= 1 << 62 else np.int64)
            deviation = (off * off).sum(axis=1)
            if deviation.dtype == object:
                deviation = pa.array([Decimal(int(d)) if d < 10**38 else None for d in deviation], pa.decimal128(38, 0))
            else:
                deviation = pa.array(deviation, pa.int64()).cast(pa.decimal128(38, 0))
            white = (x - mean) @ project
            at = pa.array(np.repeat(np.arange(len(x)), kept))
            size = len(x) * kept
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, kept + 1), len(x)), pa.int32()), pa.array(np.full(size, n), pa.int64()), deviation.take(at),
                    pa.array(white.reshape(-1), pa.float64()), pa.array(np.tile(share, len(x)), pa.float64()), pa.array(np.full(size, error), pa.float64()),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return every.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def fits_long(value: Column) -> Column:
    """A decimal as a long, null where it doesn't fit."""
    return value.try_cast("bigint")
