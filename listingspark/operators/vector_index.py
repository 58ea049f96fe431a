"""Nearest vectors over all vectors: a partitioned index of lists around centroids, searched list by list.

The centroids are fitted on a bounded sample; every vector is in the list of its nearest one. A query is compared with the
lists whose centroids are nearest, in blocks: a block holds at most ``BLOCK`` vectors of one list and ``BLOCK`` queries, and
gives back the best ``k`` of each query, so neither a list nor a popular list's queries have to fit one task, and no pair is
written. With ``exact``, a second round compares what the first could not rule out: a list can hold nothing better than the cosine of the
angle between query and centroid, less that between the centroid and the list's farthest vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .scoring import vector_problem

#: Vectors, and queries, that are compared at once.
BLOCK = 4096
#: Places to which similarities are compared, so that equal vectors tie whatever block they are in.
PLACES = 9
_FOUND = "query_id bigint, vec_id bigint, similarity double"


@dataclass(frozen=True)
class VectorIndex:
    """Centroids, how many vectors each list has and how far its farthest one is, and the table ``vec_id, list, embedding``."""

    centroids: np.ndarray
    counts: dict[int, int]
    nearest: dict[int, float]
    table: DataFrame

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def _unit(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def fitted_centroids(sample: np.ndarray, lists: int, rounds: int = 12) -> np.ndarray:
    """Directions that the unit vectors of a sample gather around; as many as there are different vectors at most."""
    sample = np.unique(sample, axis=0)
    centroids = sample[np.random.default_rng(0).permutation(len(sample))[:lists]]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centroids)
    return centroids


def build_index(vectors: DataFrame, lists: int = 256, sample: int = 20_000) -> VectorIndex | None:
    """Index ``vec_id, embedding``; None without usable vectors. Vectors of another than the usual length, and those that cannot be compared, are left out.

    The sample holds the ``sample`` vectors with the smallest hashed ids; every vector is in the index.
    """
    usable = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding").filter(vector_problem(F.col("embedding")).isNull())
    usual = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return None
    width = usual.d
    usable = usable.filter(F.size("embedding") == width)
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    centroids = fitted_centroids(_unit(pa.array(list(drawn)), width), lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(batch.column("embedding"), width) @ centroids.T
            own = np.argmax(near, axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own.astype(np.int32)), pa.array(near[np.arange(len(own)), own]), batch.column("embedding")], ["vec_id", "list", "near", "embedding"]
            )

    table = cut_lineage(usable.mapInArrow(assign, "vec_id bigint, list int, near double, embedding array<float>"), "vector-index")
    stats = table.groupBy("list").agg(F.count("*").alias("n"), F.min("near").alias("near")).collect()  # one row a list
    return VectorIndex(centroids, {r.list: r.n for r in stats}, {r.list: r.near for r in stats}, table.select("vec_id", "list", "embedding"))


def _asked(queries: DataFrame, index: VectorIndex, probe: int, floor: bool) -> DataFrame:
    """Each query with the lists it is compared with: the nearest ``probe``, or (``floor``) all others that may hold something better."""
    centroids, width = index.centroids, index.width
    held = np.array(sorted(index.counts), dtype=np.int32)
    reach = np.arccos(np.clip([index.nearest[i] for i in held], -1, 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _unit(batch.column("embedding"), width) @ centroids[held].T
            order = np.argsort(-near, axis=1, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(near.shape[1])[None, :], axis=1)
            wanted = rank < probe
            if floor:
                bound = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - reach, 0))
                worst = batch.column("worst").to_numpy(zero_copy_only=False)[:, None]
                wanted = ~wanted & ~(bound < worst - 1e-9)  # without a worst (NaN), all
            row, spot = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([batch.column(n).take(pa.array(row)) for n in ("query_id", "embedding")] + [pa.array(held[spot])], ["query_id", "embedding", "list"])

    return queries.mapInArrow(ask, "query_id bigint, embedding array<float>, list int")


def _best(query: np.ndarray, vec: np.ndarray, similarity: np.ndarray, k: int) -> pd.DataFrame:
    """The best ``k`` of each row of ``similarity``; of equal ones those with the smaller ids."""
    rows, columns = [], []
    kept = min(k, len(vec))
    edge = -np.partition(-similarity, kept - 1, axis=1)[:, kept - 1]
    for i in range(len(query)):
        spots = np.flatnonzero(similarity[i] >= edge[i])
        spots = spots[np.lexsort((vec[spots], -similarity[i, spots]))][:kept]
        rows.append(np.full(len(spots), i))
        columns.append(spots)
    row, column = np.concatenate(rows), np.concatenate(columns)
    return pd.DataFrame({"query_id": query[row], "vec_id": vec[column], "similarity": similarity[row, column]})


def _compared(index: VectorIndex, asked: DataFrame, k: int) -> DataFrame:
    """The best of every block of a list's vectors and the queries that ask it."""
    asked = cut_lineage(asked, "vector-asked")
    crowd = {r.list: math.ceil(r["count"] / BLOCK) for r in asked.groupBy("list").count().collect()}  # one row a list
    if not crowd:
        return asked.sparkSession.createDataFrame([], _FOUND)
    parts = {i: math.ceil(n / BLOCK) for i, n in index.counts.items()}
    many = lambda sizes: F.element_at(F.create_map(*[F.lit(v) for i, n in sizes.items() if i in crowd for v in (i, n)]), F.col("list"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cut = lambda name, n: F.pmod(F.xxhash64(name), n).cast("int")
    asks = asked.withColumn("crowd", cut("query_id", many(crowd))).withColumn("part", each(many(parts)))
    held = index.table.filter(F.col("list").isin(*crowd)).withColumn("part", cut("vec_id", many(parts))).withColumn("crowd", each(many(crowd)))

    def compare(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})
        sides = [np.stack(f["embedding"].to_numpy()).astype(np.float64) for f in (queries, vectors)]
        q, v = (s / np.linalg.norm(s, axis=1, keepdims=True) for s in sides)
        ids, out = vectors["vec_id"].to_numpy(), []
        for i in range(0, len(q), 256):
            out.append(_best(queries["query_id"].to_numpy()[i : i + 256], ids, np.round(q[i : i + 256] @ v.T, PLACES), k))
        return pd.concat(out)

    keys = ("list", "part", "crowd")
    return held.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(compare, _FOUND)


def nearest(index: VectorIndex, queries: DataFrame, k: int, probe: int = 16, exact: bool = False) -> DataFrame:
    """The ``k`` most similar vectors of every query (``query_id, embedding``): ``query_id, vec_id, similarity, rank``.

    Without ``exact`` only the nearest ``probe`` lists are looked into. Ties go to the smaller id; queries that cannot be compared have no result.
    """
    usable = cut_lineage(
        queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
        .filter(vector_problem(F.col("embedding"), F.lit(index.width)).isNull()), "vector-queries",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    top = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = cut_lineage(top(_compared(index, _asked(usable, index, probe, False), k)), "vector-first")
    if not exact:
        return first
    worst = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(float("nan"))).alias("worst"))
    again = usable.join(worst, "query_id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("nan"))))
    return top(first.drop("rank").unionByName(_compared(index, _asked(again, index, probe, True), k)))
