"""Numbers: rounding, salaries, token and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import trim_all

MAX_SALARY = 10_000_000
CURRENCIES = ("CAD", "USD", "EUR", "GBP")


def round_half_up(c: Column) -> Column:
    """Half rounds toward positive infinity: -0.5 becomes 0, 2.5 becomes 3."""
    return F.floor(c + F.lit(0.5))


def salary_int(text: Column) -> Column:
    """A clean positive magnitude, else null. Ranges, suffixes and symbols are not guessed at."""
    clean = trim_all(text.cast("string"))
    value = F.when(clean.rlike(r"^\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), clean.try_cast("double"))
    return F.when((value > 0) & (value <= MAX_SALARY), round_half_up(value).cast("int"))


def salary_range(low: Column, high: Column) -> tuple[Column, Column]:
    """An ordered pair; an end that is unknown stays unknown."""
    a, b = salary_int(low), salary_int(high)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.least(a, b)).otherwise(a), F.when(both, F.greatest(a, b)).otherwise(b)


def salary_lenient(text: Column) -> Column:
    """Structured-data salaries: keep digits and dots; nothing left means unknown, never zero."""
    kept = F.regexp_replace(text.cast("string"), r"[^0-9.]", "")
    value = F.when(kept != "", kept.try_cast("double"))
    return F.when(value >= 0, round_half_up(value).cast("bigint"))


def currency_of(code: Column) -> Column:
    return F.when(code.isin(*CURRENCIES), code).otherwise(F.lit("Unknown"))


def approx_tokens(*texts: Column) -> Column:
    """About four characters per token, over the texts joined by newlines."""
    return F.ceil(F.length(F.concat_ws("\n", *texts)) / F.lit(4.0))


def cost_micros(input_tokens: Column, output_tokens: Column, embedding_tokens: Column) -> Column:
    """Estimated cost in millionths of a dollar, rounded up. Decimals keep the ceiling exact."""

    def money(tokens: Column, price: str) -> Column:
        return tokens.cast("decimal(18,0)") * F.lit(price).cast("decimal(4,2)")

    total = money(input_tokens, "0.75") + money(output_tokens, "4.50") + money(embedding_tokens, "0.02")
    return F.ceil(total).cast("bigint")
