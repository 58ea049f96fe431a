"""Scores: weighted factors, vector similarity, nearest listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import round_half_up
from .contracts import FACTORS, INTEREST, QUALIFICATION
from .joins import spread_join


def group_score(factors: dict[str, Column], weights: dict[str, Column], names: tuple[str, ...]) -> Column:
    """Weighted mean of some factors as a whole percentage; null when their weights are all zero."""
    total = sum((weights[n].cast("double") for n in names), F.lit(0.0))
    earned = sum((factors[n].cast("double") * weights[n].cast("double") for n in names), F.lit(0.0))
    return F.when(total != 0, round_half_up(earned / total * 100).cast("int"))


def factor_scores(factors: dict[str, Column], weights: dict[str, Column]) -> dict[str, Column]:
    return {
        "overall_score": group_score(factors, weights, FACTORS),
        "qualification_score": group_score(factors, weights, QUALIFICATION),
        "interest_score": group_score(factors, weights, INTEREST),
    }


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def vector_problem(a: Column, size: Column | None = None) -> Column:
    """Why a vector cannot be compared, else null."""
    finite = F.forall(_doubles(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    problem = F.when(a.isNull() | (F.size(a) == 0), "dimensions")
    if size is not None:
        problem = problem.when(F.size(a) != size, "dimensions")
    return problem.when(~finite, "not_finite").when(norm(a) == 0, "zero")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for vectors that cannot be compared."""
    problem = F.coalesce(vector_problem(a), vector_problem(b), F.when(F.size(a) != F.size(b), "dimensions"))
    return F.when(problem.isNull(), dot(a, b) / (norm(a) * norm(b)))


def role_blend(role: Column, similarity: Column) -> Column:
    """The role factor with the similarity mixed in."""
    return role * 0.6 + (similarity + 1) / 2 * 0.4


def prepared_vectors(vectors: DataFrame) -> DataFrame:
    """Usable vectors with their norm, found once per vector rather than once per pair."""
    return vectors.withColumn("_problem", vector_problem(F.col("embedding"))).filter(F.col("_problem").isNull()).drop(
        "_problem"
    ).withColumn("_norm", norm(F.col("embedding")))


def similar_listings(targets: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every listing vector against its own user's target: ``user_id, vec_id, similarity``."""
    left = prepared_vectors(vectors)
    right = prepared_vectors(targets.select("user_id", "embedding")).select(
        "user_id", F.col("embedding").alias("target"), F.col("_norm").alias("_target_norm")
    )
    joined = spread_join(left, right, "user_id", "vec_id", counted=vectors, shuffled=True).filter(F.size("embedding") == F.size("target"))
    return joined.select(
        "user_id", "vec_id", (dot(F.col("embedding"), F.col("target")) / (F.col("_norm") * F.col("_target_norm"))).alias("similarity")
    )


def vector_topk(targets: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar listings of each user's target. The rank limit runs before the shuffle as well."""
    order = Window.partitionBy("user_id").orderBy(F.desc("similarity"), "vec_id")
    ranked = similar_listings(targets, vectors).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)
