"""Gates and filters: keywords, countries, hard requirements, visibility, due work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.countries import country_coverage, country_match
from ..functions.rows import with_once
from ..functions.text import keyword_text, let, normalized_text
from .joins import spread_join

# The reasons a listing is blocked for, in the order the rules apply.
BLOCKED_COUNTRY = "The job is outside your selected countries."
BLOCKED_LOCATION = "The location does not meet your hard location requirement."
BLOCKED_EMPLOYMENT = "The employment type does not meet your hard requirement."
BLOCKED_SENIORITY = "The seniority does not meet your hard requirement."
BLOCKED_SALARY = "Comparable compensation is missing or below your hard minimum."

# Application states shown on the board, and the fewer ones that still need attention.
APPLICATION_STATES = ("Preparing Application", "Applied", "Interviewing", "Offer", "Rejected", "Withdrawn")
ACTIVE_APPLICATION_STATES = ("Preparing Application", "Applied", "Interviewing", "Offer")

# Hours that must pass between successful scans of a rate-limited feed.
MIN_SCAN_HOURS = {"Jobicy": 1, "Remotive": 6}


def keyword_verdict(text: Column, include: Column, negative: Column) -> Column:
    """``struct(passed, reason, keyword)``. Exclusions win; then, if keywords are required, one must occur.

    A required list of nothing but blanks still requires something, and so blocks.
    """

    def first(keywords: Column, haystack: Column) -> Column:
        needles = F.transform(keywords, normalized_text)
        return F.get(F.filter(needles, lambda k: (k != "") & haystack.contains(k)), 0)

    def verdict(passed: bool, reason: Column, keyword: Column) -> Column:
        return F.struct(F.lit(passed).alias("passed"), reason.alias("reason"), keyword.alias("keyword"))

    def judge(haystack: Column) -> Column:
        return let(first(negative, haystack), lambda hit: (
            F.when(hit.isNotNull(), verdict(False, F.concat(F.lit('Excluded keyword "'), hit, F.lit('"')), hit))
            .when((F.size(include) > 0) & first(include, haystack).isNull(),
                  verdict(False, F.lit("No required keyword found"), F.lit("")))
            .otherwise(verdict(True, F.lit(None).cast("string"), F.lit(None).cast("string")))
        ))

    return let(text, judge)


def keyword_gate(listings: DataFrame, prefs: DataFrame) -> DataFrame:
    """Each owned listing with its owner's keyword verdict."""
    rules = prefs.select(F.col("user_id").alias("owner_id"), "include_keywords", "negative_keywords")
    joined = spread_join(listings, rules, "owner_id", "job_id", shuffled=True)
    text = keyword_text(F.col("title"), F.col("company"), F.col("description"))
    judged = with_once(joined, gate=keyword_verdict(text, F.col("include_keywords"), F.col("negative_keywords")))
    return judged.select(*listings.columns, "gate.passed", "gate.reason", "gate.keyword")


def hard_filter_reason(coverage: Column, listing: dict[str, Column], prefs: dict[str, Column]) -> Column:
    """The first hard requirement a listing fails, else null. Unstated values pass; stated ones must meet the rule."""
    place = F.lower(F.concat_ws(" ", listing["location"], listing["country"], listing["work_type"]))
    wanted = F.filter(F.transform(prefs["included_locations"], lambda w: F.lower(F.trim(w))), lambda w: w != "")
    remote_ok = F.array_contains(prefs["work_types"], "Remote") & (listing["work_type"] == "Remote")
    comparable = (
        (listing["salary_period"] == "year") & (listing["currency"] == prefs["currency"]) & listing["salary_min"].isNotNull()
    )
    return (
        F.when(~country_match(coverage, prefs["countries"], prefs["include_worldwide"], prefs["include_unknown"]), BLOCKED_COUNTRY)
        .when(
            prefs["hard_location"] & (F.size(prefs["included_locations"]) > 0) & ~remote_ok
            & ~F.exists(wanted, lambda w: place.contains(w)), BLOCKED_LOCATION)
        .when(
            prefs["hard_employment"] & (F.size(prefs["employment_types"]) > 0)
            & ~F.array_contains(prefs["employment_types"], listing["employment_type"]), BLOCKED_EMPLOYMENT)
        .when(
            prefs["hard_seniority"] & (F.size(prefs["seniority_levels"]) > 0) & (listing["seniority"] != "Unknown")
            & ~F.array_contains(prefs["seniority_levels"], listing["seniority"]), BLOCKED_SENIORITY)
        .when(
            prefs["hard_salary"] & prefs["salary_min"].isNotNull()
            & (~comparable | (listing["salary_min"] < prefs["salary_min"])), BLOCKED_SALARY)
    )


PREF_FIELDS = (
    "countries", "include_worldwide", "include_unknown", "hard_location", "hard_employment", "hard_seniority",
    "hard_salary", "included_locations", "work_types", "employment_types", "seniority_levels", "salary_min", "currency",
)
LISTING_FIELDS = ("location", "country", "work_type", "employment_type", "seniority", "salary_min", "salary_period", "currency")


def hard_filter(spark: SparkSession, listings: DataFrame, prefs: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Each owned listing with ``blocked``: the reason its owner's hard requirements reject it, or null.

    Country evidence depends on the listing alone, so it is found before the join. ``counted``: a table with the owners that is
    cheaper to read than ``listings``.
    """
    covered = listings.withColumn("_coverage", country_coverage(F.col("country"), F.col("location")))
    rules = prefs.select(F.col("user_id").alias("owner_id"), F.struct(*PREF_FIELDS).alias("_prefs"))
    joined = spread_join(covered, rules, "owner_id", "job_id", counted=listings if counted is None else counted, shuffled=True)
    reason = hard_filter_reason(
        F.col("_coverage"), {n: F.col(n) for n in LISTING_FIELDS}, {n: F.col(f"_prefs.{n}") for n in PREF_FIELDS}
    )
    return joined.withColumn("blocked", reason).select(*listings.columns, "blocked")


def visible(owner: Column, user_id) -> Column:
    """Shared listings and the user's own."""
    return owner.isNull() | (owner == user_id)


def board_conditions(q: str = "", work: str = "", view: str = "", score: float = 0) -> list[Column]:
    """Board filters over joined rows (``status`` and ``score`` of the user may be null)."""
    conditions = [F.col("archived") if view == "archived" else ~F.col("archived")]
    if q:
        pattern = "%" + q.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
        conditions.append(F.col("title").ilike(pattern) | F.col("company").ilike(pattern) | F.col("location").ilike(pattern))
    if work:
        conditions.append(F.col("work_type") == work)
    if view == "saved":
        conditions.append(F.col("status") == "Saved")
    if view == "applications":
        conditions.append(F.col("status").isin(*APPLICATION_STATES))
    if score > 0:
        conditions.append(F.col("score") >= score)
    return conditions


def is_due(as_of: Column) -> Column:
    """Whether a company waits for discovery, or has been stuck in it for a quarter of an hour."""
    stale = (F.col("status") == "Resolving") & (F.col("last_checked_at") < as_of - F.expr("INTERVAL 15 MINUTES"))
    return (F.col("status") == "Pending") | stale


def due_candidates(candidates: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Companies waiting for discovery, or stuck in it for a quarter of an hour; oldest first, all of them or the first ``limit``."""
    due = candidates.filter(is_due(as_of)).orderBy("created_at", "candidate_id")
    return due if limit is None else due.limit(limit)


def throttled_sources(sources: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Rate-limited sources whose last successful scan is too recent, with when they may run again."""
    hours = F.create_map(*[F.lit(x) for pair in MIN_SCAN_HOURS.items() for x in pair])
    limited = sources.withColumn("min_hours", F.try_element_at(hours, F.col("provider"))).filter(F.col("min_hours").isNotNull())
    last = runs.filter(F.col("status") == "Succeeded").groupBy("source_id").agg(F.max("started_at").alias("last_success"))
    again = F.col("last_success") + F.make_dt_interval(hours=F.col("min_hours"))
    return limited.join(last, "source_id").withColumn("allowed_at", again).filter(F.col("allowed_at") > as_of).select(
        "source_id", "provider", "last_success", "allowed_at"
    )
