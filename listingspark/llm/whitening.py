"""Whitening of embeddings, with covariances from variances alone (polarisation).

Entries become whole numbers x = floor(scale * c). Over the distinct x vectors, the exact squares of the centred
values are summed for every dimension and for the sum of every two dimensions; cov(i, j) = (var(i + j) - var(i) - var(j)) / 2. To stay
in whole numbers, values are centred at the whole number m nearest to their mean: with u = x - m and the rest
r = n * m - S, the centred n * x - S is n * u + r, so that its squares sum up to n^2 sum(u^2) + 2 n r sum(u) + n r^2,
put together in numbers of any length. What travels between tasks is one row for each dimension or pair and task, whatever
the number of vectors; only the sums reach the driver, d * (d + 1) / 2 of them. The symmetric d x d matrix goes to ``eigh``.

Rows whose vector is null, empty, or holds a null or an entry that is not finite are dropped. Vectors of another length than the most
frequent one (of two, the shorter) are dropped as well. Entries beyond 2^60 / scale, which no long could hold centred, count as that bound. Repeated vectors count once in the fit and are each returned; a row without an id is returned without one. An
empty table gives an empty result. Components whose variance is 0, or below ``d`` roundings of the whole, are not returned, so fewer
than asked for may come. ``deviation`` is null where it is beyond a long. Of further columns only those named ``vec_id`` and ``embedding`` are
read. Texts play no part. The distinct vectors are a table in the shared folder, which both passes read.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .texts import written

#: Bound of a whole number; sums and differences of two still fit a long.
BOUND = 1 << 60
_SAFE = 1 << 62
#: Sums travel in parts below this, as they may be beyond a long.
_LIMB = 10**18


@dataclass(frozen=True)
class Fitted:
    """What whitening needs: distinct vectors, sums, the leading components with their variances, and the trace."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray  # one component a column
    variances: np.ndarray
    trace: float


def _rows(df: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows whose entries are all there and finite, one at least."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return df.select(F.col("vec_id").cast("bigint"), "embedding").filter(finite & (F.size("embedding") > 0))


def _whole(vector: Column, scale: int) -> Column:
    """The vector as whole numbers."""
    held = lambda c: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), c.cast("double") * scale))
    return F.transform(vector, lambda c: F.floor(held(c)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """The vectors of a batch, one a row."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _squares(u: np.ndarray) -> list[int]:
    """Exact sums of squares of each row of ``u``."""
    if not u.size or float(np.abs(u).max()) ** 2 * u.shape[1] < _SAFE:
        return [int(v) for v in np.einsum("ij,ij->i", u, u)]
    return [sum(v * v for v in row) for row in u.tolist()]


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Distinct vectors and their sums a dimension."""
    parts = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = sorted(parts.collect())
    return (int(rows[0].n), [int(r.s) for r in rows]) if rows else (0, [0] * d)


def _second(fit: DataFrame, d: int, middle: list[int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Sum and sum of squares of the centred values of dimension i, and of i + j; keyed ``(i, i)`` and ``(i, j)``."""
    centre = np.array(middle, dtype=np.int64)

    def gather(batches):
        total: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            u = np.ascontiguousarray((_matrix(batch.column("x"), d) - centre).T)
            ones = _row_sums(u)
            for i in range(d):
                squares = _squares(u[i : i + 1]) + _squares(u[i + 1 :] + u[i])
                for j, square in zip(range(i, d), squares):
                    held = total.setdefault((i, j), [0, 0])
                    held[0] += ones[i] if i == j else ones[i] + ones[j]
                    held[1] += square
        if total:
            keys = pa.array([k[0] for k in total], pa.int32()), pa.array([k[1] for k in total], pa.int32())
            limbs = [_limbs(v[0], 2) + _limbs(v[1], 3) for v in total.values()]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int64()) for c in zip(*limbs))], ["i", "j", *_PARTS])

    schema = "i int, j int, " + ", ".join(f"{c} bigint" for c in _PARTS)
    parts = fit.mapInArrow(gather, schema).groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _PARTS])
    return {(r.i, r.j): (int(r.s1) * _LIMB + int(r.s0), (int(r.q2) * _LIMB + int(r.q1)) * _LIMB + int(r.q0)) for r in parts.collect()}


_PARTS = ("s1", "s0", "q2", "q1", "q0")


def _limbs(v: int, many: int) -> list[int]:
    """Parts of a number, the highest first; only that one may be negative."""
    parts = []
    for _ in range(many - 1):
        v, low = divmod(v, _LIMB)
        parts.append(low)
    return [v, *parts[::-1]]


def _row_sums(u: np.ndarray) -> list[int]:
    if not u.size or float(np.abs(u).max()) * u.shape[1] < _SAFE:
        return u.sum(axis=1).tolist()
    return [sum(row) for row in u.tolist()]


def _covariance(n: int, sums: list[int], middle: list[int], second: dict[tuple[int, int], tuple[int, int]]) -> np.ndarray:
    """Covariances over the fit list, divisor n, from exact squares of n * x - S."""
    d = len(sums)
    rest = [n * m - s for m, s in zip(middle, sums)]

    def squares(i: int, j: int) -> int:
        r = rest[i] if i == j else rest[i] + rest[j]
        s, q = second[i, j]
        return n * n * q + 2 * n * r * s + n * r * r

    own = [squares(i, i) for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(own[i] if i == j else squares(i, j) - own[i] - own[j], (1 if i == j else 2) * n**3)
            out[i, j] = out[j, i] = float(exact)
    return out


def fitted(fit: DataFrame, d: int, components: int) -> Fitted | None:
    """The leading components of the distinct vectors ``x``; None without any."""
    n, sums = _sums(fit, d)
    if not n:
        return None
    middle = [(2 * s + n) // (2 * n) for s in sums]
    covariance = _covariance(n, sums, middle, _second(fit, d, middle))
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    trace = float(np.trace(covariance))
    order = [k for k in order if values[k] > trace * d * np.finfo(float).eps][:components]
    return Fitted(n, tuple(sums), vectors[:, order], values[order], trace)


def _deviation(u: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S)^2, exact; None beyond a long."""
    most = float(np.abs(u).max(initial=0)) * n + max(map(abs, rest), default=0)
    if most * most * max(1, u.shape[1]) < _SAFE:
        v = u * n + np.array(rest, dtype=np.int64)
        return np.einsum("ij,ij->i", v, v).tolist()
    found = (sum((n * v + r) ** 2 for v, r in zip(row, rest)) for row in u.tolist())
    return [v if v < 1 << 63 else None for v in found]


def _projected(x: np.ndarray, model: Fitted) -> np.ndarray:
    centre = np.array([(2 * s + model.n) // (2 * model.n) for s in model.sums], dtype=np.int64)
    shift = np.array([float(Fraction(int(m) * model.n - s, model.n)) for m, s in zip(centre, model.sums)])
    return ((x - centre) + shift) @ model.axes / np.sqrt(model.variances)


def _identity_error(fit: DataFrame, model: Fitted, d: int) -> float:
    """Largest entry by which the covariance of the whitened distinct vectors differs from the identity."""
    k = len(model.variances)

    def gather(batches):
        total, ones = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            z = _projected(_matrix(batch.column("x"), d), model)
            total, ones = total + z.T @ z, ones + z.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([total.ravel(), ones])), pa.array(np.arange(k * k + k, dtype=np.int32))], ["v", "i"])

    rows = sorted(fit.mapInArrow(gather, "v double, i int").groupBy("i").agg(F.sum("v").alias("v")).collect())
    sums = np.array([r.v for r in rows])
    mean = sums[k * k :] / model.n
    return float(np.abs(sums[: k * k].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """One row for each row of ``vec_id, embedding`` that is not dropped and each component, largest variance first.

    ``n`` is the number of distinct vectors, ``deviation`` the squared distance n * x - S from the mean, ``explained`` the
    component's share of the whole variance.
    """
    spark = df.sparkSession
    rows = _rows(df)
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], _OUT)
    d = lengths.d
    rows = rows.filter(F.size("embedding") == d).select("vec_id", _whole(F.col("embedding"), scale).alias("x"))
    fit = written(rows.select("x").distinct(), "distinct-vectors")
    model = fitted(fit, d, components)
    k = len(model.variances)
    if not k:
        return spark.createDataFrame([], _OUT)
    error = _identity_error(fit, model, d)
    n, share = model.n, model.variances / model.trace
    middle = [(2 * s + n) // (2 * n) for s in model.sums]
    rest = [n * m - s for m, s in zip(middle, model.sums)]
    centre = np.array(middle, dtype=np.int64)

    def project(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            many = len(x)
            deviation = pa.array(_deviation(x - centre, n, rest), pa.int64())
            at = np.repeat(np.arange(many), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), deviation.take(pa.array(at)),
                 pa.array(_projected(x, model).ravel()), pa.array(np.tile(share, many)), pa.array(np.full(many * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, _OUT)
