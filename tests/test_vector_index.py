import numpy as np
import pytest

from listingspark.operators import vector_index as V


def table(spark, vectors, name="vec_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], f"{name} long, embedding array<float>")


def by_hand(vectors, queries, k):
    ids, rows = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], dtype=np.float32).astype(float)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    out = {}
    for i, q in queries:
        q = np.array(q, dtype=np.float32).astype(float)
        near = np.round(rows @ (q / np.linalg.norm(q)), 9)
        out[i] = [int(ids[j]) for j in np.lexsort((ids, -near))[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 16))
    vectors = [(i, middles[i % 30] + 0.35 * rng.normal(size=16)) for i in range(1500)]
    vectors += [(5000 + i, vectors[7][1]) for i in range(600)]  # copies, the larger part of one list
    return vectors, [(i, v + 0.1 * rng.normal(size=16)) for i, v in vectors[::25]]


def test_exact_search_equals_all_products(spark, points, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 100)  # lists and their queries fall into blocks
    vectors, queries = points
    index = V.build_index(table(spark, vectors), lists=24, sample=500)
    assert sum(index.counts.values()) == len(vectors)
    got = found(V.nearest(index, table(spark, queries, "query_id"), 10, probe=1, exact=True))
    assert got == by_hand(vectors, queries, 10)


def test_recall_of_probed_lists(spark, points):
    vectors, queries = points
    index = V.build_index(table(spark, vectors), lists=24, sample=500)
    want = by_hand(vectors, queries, 10)
    got = found(V.nearest(index, table(spark, queries, "query_id"), 10, probe=4))
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.95


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, float("nan")]), (5, [1.0]), (6, [0.0, 2.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = V.build_index(df, lists=5)
    assert sum(index.counts.values()) == 2
    got = found(V.nearest(index, df.withColumnRenamed("vec_id", "query_id"), 3, probe=1, exact=True))
    assert got == {1: [1, 6], 6: [6, 1]}
    assert V.build_index(df.filter("vec_id in (2, 3, 4)")) is None
    assert V.nearest(index, df.limit(0).withColumnRenamed("vec_id", "query_id"), 3).collect() == []
