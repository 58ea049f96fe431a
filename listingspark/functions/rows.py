"""Row helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def firsts_by(entries: Column, name: str) -> Column:
    """Of an array of structs whose first field is ``name``, the first entry of each value in the array's sorted order.

    One sort in the row instead of a shuffle; entries come back ordered by that field.
    """
    fresh = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)[name] != x[name]))
    return F.element_at(F.transform(F.array(F.array_sort(entries)), fresh), 1)


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row, however often later steps use them.

    Catalyst copies an expression into every filter and projection that refers to it; for costly
    text and URL expressions that multiplies the work. A one-row generator is opaque to that.
    """
    row = F.named_struct(*[x for name, c in columns.items() for x in (F.lit(name), c)])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(row)))
