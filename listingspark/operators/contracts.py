"""Data-quality contracts: what a listing, a set of weights or a factor row must satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import CURRENCIES, MAX_SALARY
from ..functions.text import let, trim_all

# The enumerations of the listing contract.
EMPLOYMENT_TYPES = ("Full-time", "Contract", "Fractional", "Consulting", "Temporary", "Permanent", "Unknown")
WORK_TYPES = ("Remote", "Hybrid", "On-site", "Unknown")
SENIORITY_LEVELS = (
    "Manager", "Senior Manager", "Director", "Senior Director", "VP", "SVP", "EVP", "C-Level", "Founder",
    "Advisor", "Consultant", "Individual Contributor", "Unknown",
)
SALARY_PERIODS = ("year", "hour", "month", "week", "day", "unknown")

# The eight score factors, their default weights and the two groups.
FACTORS = ("role", "experience", "skills", "leadership", "industry", "location", "compensation", "direction")
DEFAULT_WEIGHTS = {
    "role": 20, "experience": 20, "skills": 15, "leadership": 15,
    "industry": 10, "location": 10, "compensation": 5, "direction": 5,
}
QUALIFICATION = ("experience", "skills", "leadership")
INTEREST = ("role", "industry", "location", "compensation", "direction")

LISTING_TEXT = ("title", "company", "description", "location", "country", "industry")


def listing_violations(trimmed: bool = False) -> Column:
    """Codes of every contract rule a listing row breaks; an empty array means it is valid.

    ``trimmed``: the texts are trimmed already, so they are not gone through again.
    """
    c = F.col

    def size(name: str, low: int, high: int) -> Column:
        text = c(name) if trimmed else trim_all(c(name))
        return let(F.length(text), lambda n: F.when(~F.coalesce(n.between(low, high), F.lit(False)), name))

    def one_of(name: str, values: tuple[str, ...]) -> Column:
        return F.when(~F.coalesce(c(name).isin(*values), F.lit(False)), name)

    def money(name: str) -> Column:
        value = c(name).cast("double")
        return F.when(value.isNotNull() & ~((value >= 0) & (value <= MAX_SALARY) & (value == F.floor(value))), name)

    return F.array_compact(F.array(
        size("title", 2, 200),
        size("company", 1, 200),
        size("description", 20, 100_000),
        size("location", 0, 200),
        size("country", 0, 200),
        size("industry", 0, 200),
        one_of("employment_type", EMPLOYMENT_TYPES),
        one_of("seniority", SENIORITY_LEVELS),
        one_of("work_type", WORK_TYPES),
        money("salary_min"),
        money("salary_max"),
        F.when(c("salary_min") > c("salary_max"), "salary_range"),
        one_of("salary_period", SALARY_PERIODS),
        one_of("currency", (*CURRENCIES, "Unknown")),
        F.when(
            ~F.coalesce(c("job_url").rlike(r"^(?i:https?)://[^\s/?#]+[^\s]*$") & (F.length("job_url") <= 2000), F.lit(False)),
            "job_url",
        ),
    ))


def check_listings(listings: DataFrame) -> DataFrame:
    """Every row with its ``violations``, strings trimmed as the contract reads them."""
    trimmed = {name: trim_all(F.col(name)) for name in LISTING_TEXT}
    return listings.withColumn("violations", listing_violations()).withColumns(trimmed)


def weights_violation(weights: dict[str, Column]) -> Column:
    """Null when the eight weights are usable, else why not."""
    total = sum((weights[f].cast("double") for f in FACTORS), F.lit(0.0))
    in_range = F.lit(True)
    for f in FACTORS:
        in_range = in_range & F.coalesce(weights[f].between(0, 100), F.lit(False))
    return F.when(~in_range, "weight_range").when(~(F.abs(total - 100) < 0.001), "weight_total")


def factors_violation(factors: dict[str, Column], reasons: Column | None = None, gaps: Column | None = None) -> Column:
    """Null when the eight factors (and reasons, gaps) are usable, else the first problem."""
    ok = F.lit(True)
    for f in FACTORS:
        value = factors[f].cast("double")
        ok = ok & F.coalesce(value.between(0, 1) & ~F.isnan(value), F.lit(False))
    result = F.when(~ok, "factor_range")

    def texts_ok(items: Column) -> Column:
        return F.forall(items, lambda t: F.length(trim_all(t)).between(1, 200))

    if reasons is not None:
        result = result.when(~(F.size(reasons).between(1, 8) & texts_ok(reasons)), "reasons")
    if gaps is not None:
        result = result.when(~((F.size(gaps) <= 8) & texts_ok(gaps)), "gaps")
    return result


# What a preference is when an older stored record does not name it.
PREFERENCE_DEFAULTS: dict[str, tuple[str, object, tuple[int, int] | None]] = {
    "includeWorldwideJobs": ("boolean", True, None),
    "includeUnknownCountryJobs": ("boolean", False, None),
    "autoEvaluateAfterSync": ("boolean", True, None),
    "evaluationBatchSize": ("int", 5, (1, 20)),
    "aiMonthlyBudgetMicros": ("int", 250_000, (0, 100_000_000)),
    "aiDiscoveryBudgetMicros": ("int", 250_000, (0, 100_000_000)),
    "notificationsEnabled": ("boolean", True, None),
    "notifyMinScore": ("int", 90, (0, 100)),
    "digestEnabled": ("boolean", False, None),
    "digestMinScore": ("int", 85, (0, 100)),
    "digestHourUtc": ("int", 13, (0, 23)),
}


def fill_preferences(stored: DataFrame, json_column: str = "data") -> DataFrame:
    """Parse stored preference JSON, fill what is missing, and name the first value out of range."""
    schema = ", ".join(f"{name} {kind}" for name, (kind, _, _) in PREFERENCE_DEFAULTS.items())
    parsed = stored.withColumn("_p", F.from_json(F.col(json_column), schema))
    filled = parsed.select(
        *[F.col(c) for c in stored.columns if c != json_column],
        *[F.coalesce(F.col("_p")[name], F.lit(value)).alias(name) for name, (_, value, _) in PREFERENCE_DEFAULTS.items()],
    )
    problem = F.coalesce(*[
        F.when(~F.col(name).between(*bounds), name)
        for name, (_, _, bounds) in PREFERENCE_DEFAULTS.items() if bounds
    ])
    return filled.withColumn("problem", problem)
