"""A person's board: one lazy plan from listings to a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.countries import country_coverage, country_match
from ..operators.gates import board_conditions
from ..operators.reports import board_join, board_order, page_with_total


def board_rows(
    spark: SparkSession, listings: DataFrame, matches: DataFrame, saved: DataFrame, user_id: int, *,
    countries: list[str] | None = None, worldwide: bool = True, unknown: bool = False,
    q: str = "", work: str = "", view: str = "", score: float = 0,
) -> DataFrame:
    """All rows of a board. Country selection is one more predicate on the listing, before the joins."""
    shown = listings
    if countries:
        coverage = country_coverage(F.col("country"), F.col("location"))
        shown = shown.filter(country_match(coverage, F.array(*[F.lit(c) for c in countries]), F.lit(worldwide), F.lit(unknown)))
    rows = board_join(shown, matches, saved, user_id)
    return rows.filter(reduce(lambda a, b: a & b, board_conditions(q, work, view, score)))


def board(spark: SparkSession, listings: DataFrame, matches: DataFrame, saved: DataFrame, user_id: int, *,
          page: int = 1, sort: str = "score", **filters) -> DataFrame:
    rows = board_rows(spark, listings, matches, saved, user_id, **filters)
    return page_with_total(rows, board_order(sort), page)
