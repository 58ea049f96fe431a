"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16
#: So many of the most frequent keys are shared out; each further key holds less than one row in so many.
HOT_KEYS = 256


def hot_keys(rows: DataFrame, key: str, most: int = HOT_KEYS) -> DataFrame:
    """The ``most`` most frequent keys: ``key, _hot``."""
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    return counts.orderBy(F.desc("_rows"), key).limit(most).select(key, F.lit(True).alias("_hot"))


def with_hot_repeated(small: DataFrame, hot: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """The small side with its ``_salt``: the rows of hot keys once per salt, all others once."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    return small.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0))))).drop("_hot")


def _salt(spread_by: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")


def spread_join(
    big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = SALTS, counted: DataFrame | None = None, shuffled: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join a table whose ``key`` may be very uneven to one that has a row per key.

    The rows of a frequent key are spread over ``salts`` tasks by another column, and only its row on the small side is repeated,
    so a hot key is shared out instead of landing in a single task while a small side of many keys does not grow. Frequent keys are
    those of ``counted``, by default ``big``: a table with the key that is cheaper to read; or those of ``hot`` (``key, _hot``, at most
    :data:`HOT_KEYS` rows), where they are counted anyway. They only decide where rows meet.
    ``shuffled`` is for small sides that grow with the input, as people do: their file size tells too little to send them to every task.
    """
    hot = F.broadcast(hot_keys(big if counted is None else counted, key) if hot is None else hot)
    left = big.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), _salt(spread_by, salts)).otherwise(F.lit(0))).drop("_hot")
    right = with_hot_repeated(small, hot, key, salts)
    return left.join(right.hint("merge") if shuffled else right, [key, "_salt"], how).drop("_salt")


def repeated_join(big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """The same without a look at the keys, for a ``big`` that is dear to count: all of the small side is repeated once per salt."""
    left = big.withColumn("_salt", _salt(spread_by, salts))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, "_salt"], how).drop("_salt")
