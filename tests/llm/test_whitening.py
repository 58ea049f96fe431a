import math
from fractions import Fraction

import numpy as np
import pytest

from listingspark.llm import queries, whitening as W


def table(spark, vectors, **more):
    rows = [(i, v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS x", "0 AS n", "1 AS component", "2 AS label", "3 AS s")


def whole(vector):
    return tuple(math.floor(256 * float(np.float32(c))) for c in vector)


def by_hand(vectors):
    """n, sums and covariances, in fractions."""
    fit = sorted({whole(v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = [[n * x[i] - sums[i] for i in range(d)] for x in fit]
    cov = [[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)]
    return n, sums, np.array(cov)


def check(rows, vectors, k):
    n, sums, cov = by_hand(vectors)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    assert len(rows) == len(vectors) * k
    signs = {}
    for r in rows:
        v = whole(vectors[r.vec_id])
        i = order[r.component - 1]
        z = float(np.dot(np.array(v) - np.array([s / n for s in sums]), axes[:, i])) / math.sqrt(values[i])
        sign = signs.setdefault(r.component, 1 if r.whitened * z > 0 or abs(z) < 1e-7 else -1)
        assert r.whitened * sign == pytest.approx(z, abs=1e-8)
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, sums))
        assert r.explained == pytest.approx(values[i] / np.trace(cov), rel=1e-9) and 0 <= r.identity_error < 1e-9


def test_equals_by_hand(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 7)) * [1, 5, 0.2, 3, 1, 0.5, 2] + 4).astype(np.float32).tolist()
    vectors += [vectors[0]] * 50 + vectors[:20]  # copies count once
    check(W.whitened(table(spark, vectors).repartition(5)).collect(), vectors, 4)


def test_large_and_shifted_values(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(40, 3)) * [1e3, 1.0, 1e4] + [0, 1e6, -1e7]).astype(np.float32).tolist()
    check(W.whitened(table(spark, vectors), components=2).collect(), vectors, 2)


def test_dropped_rows(spark):
    good = [[1.0, 2.0], [2.0, 1.0], [4.0, 4.0]]
    vectors = [*good, None, [], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0, 2.0, 3.0], [1.0]]
    rows = W.whitened(table(spark, vectors)).collect()
    assert {r.vec_id for r in rows} == {0, 1, 2} and {r.n for r in rows} == {3}
    check(rows, good, 2)


def test_few_components(spark):
    assert W.whitened(table(spark, [])).collect() == []
    assert W.whitened(table(spark, [None, [float("nan")]])).collect() == []
    assert W.whitened(table(spark, [[1.0, 2.0]] * 5)).collect() == []  # no variance
    line = W.whitened(table(spark, [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]])).collect()
    assert {r.component for r in line} == {1} and {round(r.explained, 12) for r in line} == {1.0}


def test_beyond_a_long(spark):
    vectors = [[3.0e38, 1.0], [-3.0e38, 2.0], [1.0, 3.0], [0.5, 0.25]]
    rows = W.whitened(table(spark, vectors)).collect()
    assert len(rows) == 4 and all(r.deviation is None for r in rows if r.vec_id < 2) and all(math.isfinite(r.whitened) for r in rows)


def test_exact_parts():
    for v in (0, 5, -5, 10**18, -(10**18) - 1, 10**40 + 7):
        parts = W._limbs(v, 3)
        assert (parts[0] * W._LIMB + parts[1]) * W._LIMB + parts[2] == v and all(0 <= p < W._LIMB for p in parts[1:])
    wide = np.array([[2**61, -(2**61)], [3, 4]])
    assert W._squares(wide) == [2**123, 25] and W._row_sums(wide) == [0, 7]
    assert W._deviation(np.array([[2, 3]]), 10, [1, -1]) == [21**2 + 29**2] and W._deviation(np.array([[2**40, 0]]), 10, [0, 0]) == [None]


def test_query(spark):
    rows = queries.op11_embedding_whitening(spark, "/root/testdata/sf0.001").collect()
    vectors = {r.vec_id: list(r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert sorted(vectors) == list(range(len(vectors)))
    check(rows, [vectors[i] for i in range(len(vectors))], 4)
