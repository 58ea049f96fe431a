"""One scan from landed payloads to the next state of listings and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import with_once
from ..functions.text import content_hash, keyword_text
from ..functions.urls import canonical_url
from ..operators import merge, reports
from ..operators.gates import keyword_verdict
from ..operators.joins import spread_join


LISTING_COLUMNS = (
    "title", "company", "description", "location", "country", "industry", "employment_type", "seniority", "work_type", "salary_min", "salary_max", "salary_period",
    "currency", "job_url", "source_url", "provider", "posted_at", "description_hash",
)


@dataclass
class ScanResult:
    listings: DataFrame
    refs: DataFrame
    outcomes: DataFrame
    counters: DataFrame


def scan(
    normalized: DataFrame, seen: DataFrame, verdicts: DataFrame, sources: DataFrame, prefs: DataFrame,
    listings: DataFrame, refs: DataFrame, as_of: Column,
) -> ScanResult:
    """Merge the normalized rows of scanned sources.

    ``normalized`` holds contract rows with ``source_id``; ``seen`` every external id met, also of rows
    that failed; ``verdicts`` per source whether removals are allowed; ``sources`` owner and run per source.
    Listings keep every column of :data:`LISTING_COLUMNS` that ``normalized`` has; listings and references
    name a listing by the same ``job_id``, its owner and URL. Outcomes and counters are per run.
    """
    columns = [n for n in LISTING_COLUMNS if n in normalized.columns]
    owners = sources.select("source_id", "owner_id", "run_id")
    owned = spread_join(normalized, owners, "source_id", "external_id", counted=seen)
    good = owned.filter(F.size("violations") == 0)
    rules = prefs.select(F.col("user_id").alias("owner_id"), "include_keywords", "negative_keywords")
    gated = with_once(
        spread_join(good, rules, "owner_id", "external_id", "left", counted=seen.join(sources.select("source_id", "owner_id"), "source_id"), shuffled=True),
        gate=keyword_verdict(
            keyword_text(F.col("title"), F.col("company"), F.col("description")),
            F.coalesce("include_keywords", F.array().cast("array<string>")),
            F.coalesce("negative_keywords", F.array().cast("array<string>")),
        ),
        canonical_hash=content_hash(canonical_url(F.col("job_url"))),
    ).withColumn("job_id", F.concat_ws(":", "owner_id", "canonical_hash"))
    passed = gated.filter("gate.passed")
    incoming = passed.select(
        "owner_id", "canonical_hash", "job_id", *columns, F.col("run_id").alias("last_run"),
        as_of.alias("last_seen"), F.lit("Active").alias("lifecycle"), F.lit(None).cast("timestamp").alias("archived"),
        as_of.alias("discovered_at"), F.struct("source_id", "page_no", "ordinal").alias("ordinal"),
    )
    merged = merge.merge_listings(listings, incoming, columns, ("last_run",))
    new_refs = passed.select(
        "source_id", "external_id", "job_id", F.lit(True).alias("active"), as_of.alias("last_seen"), F.struct("page_no", "ordinal").alias("ordinal"),
    )
    merged_refs = merge.merge_refs(refs, new_refs).drop("outcome")
    after = merge.retire_missing(merged_refs, seen, verdicts)
    # the run that took a listing's last reference is the one that removed it
    by_run = after.filter("retired").join(owners.select("source_id", "run_id"), "source_id").groupBy("job_id").agg(F.max("run_id").alias("removed_by"))
    gone = merge.removed_listings(after).join(by_run, "job_id")
    final = merged.join(gone, "job_id", "left").withColumns({
        "lifecycle": F.when(F.col("removed_by").isNotNull(), "Removed").otherwise(F.col("lifecycle")),
        "outcome": F.when(F.col("removed_by").isNotNull(), "removed").otherwise(F.col("outcome")),
    })
    shown = ("run_id", "owner_id", "key", "outcome")
    outcomes = (
        final.filter(F.col("outcome") != "missing").select(F.coalesce("removed_by", "last_run").alias("run_id"), "owner_id", F.col("canonical_hash").alias("key"), "outcome")
        .unionByName(gated.filter(~F.col("gate.passed")).withColumns({"key": F.col("canonical_hash"), "outcome": F.lit("filtered")}).select(*shown))
        .unionByName(owned.filter(F.size("violations") > 0).withColumns({"key": F.col("external_id"), "outcome": F.lit("failed")}).select(*shown))
    )
    return ScanResult(final.select(*merged.drop("outcome").columns), after.drop("retired"), outcomes, reports.run_counters(outcomes))
