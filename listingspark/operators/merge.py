"""State changes as batch merges: current rows and incoming rows make the next rows.

Every merge is deterministic and repeatable: merging the same batch twice changes nothing more.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import next_slot
from ..functions.text import company_key
from .joins import spread_join


def last_by(df: DataFrame, keys: Iterable[str], *order: Column | str) -> DataFrame:
    """The last row of each key. Each task keeps one row per key before the shuffle, so hot keys stay small."""
    ordering = [F.desc(o) if isinstance(o, str) else o.desc() for o in order]
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*ordering)))
    return ranked.filter("_n = 1").drop("_n")


def merge(
    current: DataFrame,
    incoming: DataFrame,
    keys: list[str],
    *,
    last: Iterable[Column | str] = (),
    changed: Column | None = None,
    take: Iterable[str] = (),
    touch: Iterable[str] = (),
    keep: Iterable[str] = (),
) -> DataFrame:
    """Full outer merge on ``keys``; every row gets an ``outcome``. Of incoming rows with one key the last by ``last`` counts.

    ``take`` columns come from the incoming row when it is new or ``changed``, ``touch`` columns
    whenever there is an incoming row, ``keep`` columns only when the row is new. ``changed`` is
    written over ``c`` (current) and ``i`` (incoming) columns and defaults to always.
    """
    columns = [*take, *touch, *keep]
    incoming = last_by(incoming, keys, *(last or [F.struct(*columns)]))
    c = current.select(*keys, F.struct(*columns).alias("c"))
    i = incoming.select(*keys, F.struct(*columns).alias("i"))
    joined = c.join(i, keys, "full_outer")
    differs = F.lit(True) if changed is None else changed
    outcome = (
        F.when(F.col("i").isNull(), "missing").when(F.col("c").isNull(), "added")
        .when(differs, "updated").otherwise("unchanged")
    )
    marked = joined.withColumn("outcome", outcome)
    fresh = F.col("outcome").isin("added", "updated")
    picked = [F.when(fresh, F.col(f"i.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in take]
    picked += [F.when(F.col("i").isNotNull(), F.col(f"i.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in touch]
    picked += [F.when(F.col("outcome") == "added", F.col(f"i.{n}")).otherwise(F.col(f"c.{n}")).alias(n) for n in keep]
    return marked.select(*keys, *picked, "outcome")


def insert_absent(current: DataFrame, incoming: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The incoming rows whose key is not there yet, one per key."""
    one = last_by(incoming, keys, *order) if order else incoming
    return one.join(current.select(*keys), keys, "left_anti")


LISTING_TAKE = ("title", "description_hash")


def merge_listings(current: DataFrame, incoming: DataFrame, take: Iterable[str] = LISTING_TAKE, touch: Iterable[str] = ()) -> DataFrame:
    """Listings of a scan into the stored ones, by owner and canonical URL hash.

    A new description replaces all fields; the same one only marks the listing as seen and active.
    When a URL occurs twice in a scan the last by ``ordinal`` counts. ``archived`` and
    ``discovered_at`` are set once and never touched again; ``touch`` names further columns that follow every scan.
    """
    return merge(
        current, incoming, ["owner_id", "canonical_hash"], last=["ordinal"],
        changed=~F.col("c.description_hash").eqNullSafe(F.col("i.description_hash")),
        take=take, touch=("last_seen", "lifecycle", *touch), keep=("job_id", "archived", "discovered_at"),
    )


def merge_refs(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Where listings were seen, by source and external id: active again, with the listing it now names."""
    return merge(
        current, incoming, ["source_id", "external_id"], last=["ordinal"],
        touch=("job_id", "active", "last_seen"),
    )


def retire_missing(refs: DataFrame, seen: DataFrame, verdicts: DataFrame) -> DataFrame:
    """References after a scan: those it should have shown but did not become inactive.

    ``seen`` holds every external id the scan met, listed before any gate and including failures;
    ``verdicts`` says per source whether the scan was complete and allowed to remove.
    """
    met = seen.select("source_id", "external_id").distinct().withColumn("_met", F.lit(True))
    allowed = verdicts.select("source_id", "may_retire")
    joined = spread_join(refs.join(met, ["source_id", "external_id"], "left"), allowed, "source_id", "external_id", "left", counted=refs)
    retired = F.col("active") & F.coalesce(F.col("may_retire"), F.lit(False)) & F.col("_met").isNull()
    return joined.withColumn("retired", retired).select(
        *[(F.col("active") & ~F.col("retired")).alias("active") if n == "active" else F.col(n) for n in refs.columns], "retired"
    )


def live_refs(refs: DataFrame) -> DataFrame:
    """Active references left per listing, and whether any was retired."""
    retired = F.bool_or("retired") if "retired" in refs.columns else F.lit(False)
    return refs.groupBy("job_id").agg(F.count_if("active").alias("live"), retired.alias("any_retired"))


def removed_listings(refs_after: DataFrame) -> DataFrame:
    """Listings that lost their last live reference in this scan."""
    return live_refs(refs_after).filter((F.col("live") == 0) & F.col("any_retired")).select("job_id")


def apply_removals(listings: DataFrame, refs_after: DataFrame) -> DataFrame:
    gone = removed_listings(refs_after).withColumn("_gone", F.lit(True))
    return listings.join(gone, "job_id", "left").withColumn(
        "lifecycle", F.when(F.col("_gone"), "Removed").otherwise(F.col("lifecycle"))
    ).drop("_gone")


def merge_matches(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The newest evaluation per user and listing replaces the stored one."""
    values = [n for n in current.columns if n not in ("user_id", "job_id")]
    return merge(current, incoming, ["user_id", "job_id"], last=["evaluated_at"], touch=values)


def vector_cache(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """Which vectors can be reused: same owner, model and content hash; the rest must be computed."""
    known = cached.select("owner_id", "model", F.col("content_hash").alias("cached_hash"))
    return wanted.join(known, ["owner_id", "model"], "left").withColumn(
        "action", F.when(F.col("cached_hash") == F.col("content_hash"), "reuse").otherwise("compute")
    ).drop("cached_hash")


def insert_alerts(current: DataFrame, drafts: DataFrame) -> DataFrame:
    """Alerts not there yet; the key names user, listing, score and evaluation, so a replay inserts nothing."""
    return insert_absent(current, drafts, ["user_id", "dedupe_key"], "job_id")


def insert_listing_once(current: DataFrame, added: DataFrame) -> DataFrame:
    """Manual additions with their outcome; a listing the owner already has is rejected, keywords never apply."""
    known = current.select("owner_id", "canonical_hash").withColumn("_known", F.lit(True))
    order = Window.partitionBy("owner_id", "canonical_hash").orderBy("ordinal")
    return added.join(known, ["owner_id", "canonical_hash"], "left").withColumn("_n", F.row_number().over(order)).withColumn(
        "outcome", F.when(F.col("_known").isNull() & (F.col("_n") == 1), "added").otherwise("This opportunity has already been added.")
    ).drop("_known", "_n")


def apply_status(saved: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest application state per user and listing. The log itself is the changes, appended."""
    latest = changes.groupBy("user_id", "job_id").agg(
        F.max_by(F.struct("status", "created_at"), F.struct("created_at", "id")).alias("s")
    ).select("user_id", "job_id", "s.status", F.col("s.created_at").alias("updated_at"))
    return merge(saved, latest, ["user_id", "job_id"], touch=("status", "updated_at"))


def apply_archive(listings: DataFrame, actions: DataFrame) -> DataFrame:
    """The last archive or restore action of each listing wins; others keep their state."""
    last = actions.groupBy("job_id").agg(
        F.max_by(F.struct("archived", "at"), F.struct("at", "id")).alias("a")
    ).select("job_id", "a")
    return listings.join(last, "job_id", "left").withColumn(
        "archived_at", F.when(F.col("a").isNull(), F.col("archived_at")).when(F.col("a.archived"), F.col("a.at"))
    ).drop("a")


def link_by_key(candidates: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Imported companies and the watchlist entry of the same name.

    An entry that already names another domain is left alone; a blank domain is filled in, once: when
    several candidates share a name the lowest id decides, and those of other domains are not linked.
    """
    entries = watchlist.select("user_id", "watch_id", "domain", company_key(F.col("company")).alias("key"))
    keyed = candidates.select("user_id", "candidate_id", F.col("domain").alias("found"), company_key(F.col("name")).alias("key"))
    # what a blank entry becomes, one row per user and name; entries then meet candidates by domain, not by name alone
    first = keyed.groupBy("user_id", "key").agg(F.min_by(F.struct("found", "candidate_id"), "candidate_id").alias("first"))
    named = entries.join(first, ["user_id", "key"]).select(
        "user_id", "key", "watch_id", F.when(F.col("domain") == "", F.col("first.found")).otherwise(F.col("domain")).alias("found"),
        F.when(F.col("domain") == "", F.col("first.candidate_id")).alias("fills"),
    )
    return keyed.join(named, ["user_id", "key", "found"]).select(
        "user_id", "candidate_id", "watch_id", F.coalesce(F.col("fills") == F.col("candidate_id"), F.lit(False)).alias("backfill"), F.col("found").alias("domain")
    )


def import_candidates(current: DataFrame, lines: DataFrame) -> DataFrame:
    """Import outcome per line with the user's stored companies taken into account.

    ``lines`` is the result of the seed import with a ``user_id``; a domain the user already has is a duplicate.
    """
    known = current.select("user_id", "domain").distinct().withColumn("_known", F.lit(True))
    return lines.join(known, ["user_id", "domain"], "left").withColumn(
        "result", F.when(F.col("outcome") != "imported", "rejected").when(F.col("_known"), "duplicate").otherwise("imported")
    ).drop("_known")


def purge(rows: DataFrame, expired: Column) -> DataFrame:
    """What stays after retention."""
    return rows.filter(~F.coalesce(expired, F.lit(False)))


def alert_expired(as_of: Column, days: int = 90) -> Column:
    """Read alerts are kept ninety days; unread ones for ever."""
    return F.col("is_read") & (F.col("created_at") < as_of - F.make_dt_interval(days=F.lit(days)))


def activity_expired(as_of: Column, days: int = 14) -> Column:
    return F.col("created_at") < as_of - F.make_dt_interval(days=F.lit(days))


def mark_read(alerts: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Alerts after read requests: a request names one alert, or all of a user's when ``alert_id`` is null."""
    everything = requests.filter(F.col("alert_id").isNull()).select("user_id").distinct().withColumn("_all", F.lit(True))
    single = requests.filter(F.col("alert_id").isNotNull()).select("user_id", "alert_id").distinct().withColumn("_one", F.lit(True))
    joined = spread_join(alerts, everything, "user_id", "alert_id", "left", shuffled=True).join(single, ["user_id", "alert_id"], "left")
    marked = ~F.col("is_read") & (F.coalesce(F.col("_all"), F.lit(False)) | F.coalesce(F.col("_one"), F.lit(False)))
    return joined.withColumn("marked", marked).withColumn("is_read", F.col("is_read") | F.col("marked")).drop("_all", "_one")


RETRYABLE = ("Resolved", "Failed", "Blocked", "Unsupported", "NoCareersPage")


def candidate_transitions(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """Apply discovery results fenced by attempt: one counts only if the company is still resolving that attempt.

    Each company has one row. ``fenced`` says that only results of other attempts came; they change nothing and
    :func:`fenced_results` lists them. Two results of one attempt count as one, the last by name.
    """
    of_attempt = results.groupBy("candidate_id", "attempts").agg(F.max("status").alias("new_status"))
    sent = results.groupBy("candidate_id").agg(F.count("*").alias("results"))
    joined = candidates.join(of_attempt, ["candidate_id", "attempts"], "left").join(sent, "candidate_id", "left")
    valid = (F.col("status") == "Resolving") & F.col("new_status").isNotNull()
    effect = F.when(F.col("results").isNull(), "none").when(valid, "applied").otherwise("fenced")
    return joined.withColumn("effect", effect).select(
        "candidate_id", "attempts", F.when(F.col("effect") == "applied", F.col("new_status")).otherwise(F.col("status")).alias("status"), "effect"
    )


def fenced_results(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """The results that change nothing, as their company is not resolving that attempt."""
    open_ = candidates.filter(F.col("status") == "Resolving").select("candidate_id", "attempts")
    return results.join(open_, ["candidate_id", "attempts"], "left_anti")


def claim_candidates(candidates: DataFrame, as_of: Column) -> DataFrame:
    """Waiting or stuck companies go to resolving with one more attempt."""
    due = (F.col("status") == "Pending") | (
        (F.col("status") == "Resolving") & (F.col("last_checked_at") < as_of - F.expr("INTERVAL 15 MINUTES"))
    )
    return candidates.withColumn("claimed", due).withColumns({
        "status": F.when(F.col("claimed"), "Resolving").otherwise(F.col("status")),
        "attempts": F.col("attempts") + F.when(F.col("claimed"), 1).otherwise(0),
    })


def retry_candidates(candidates: DataFrame, requests: DataFrame) -> DataFrame:
    """Retry requests: a finished company waits again; any other request is refused."""
    return requests.join(candidates.select("candidate_id", "user_id", "status"), ["candidate_id", "user_id"], "left").withColumn(
        "outcome", F.when(F.coalesce(F.col("status").isin(*RETRYABLE), F.lit(False)), "Pending").otherwise("refused")
    )


def merge_sources(current: DataFrame, resolved: DataFrame) -> DataFrame:
    """Sources by owner and identity. Re-resolution may move where a source points, never its owner's choices."""
    return merge(
        current, resolved, ["owner_id", "identity"],
        touch=("provider", "board", "source_url"), keep=("source_id", "company", "schedule", "enabled"),
    )


def merge_patterns(current: DataFrame, discovered: DataFrame, scans: DataFrame) -> DataFrame:
    """Saved request patterns: a new one replaces the old and forgets its history; then scans are counted in.

    ``scans`` has ``source_id, verified_at`` (null if none succeeded) and ``failures`` since the last success.
    """
    replaced = merge(current, discovered, ["source_id"], touch=("url_template", "jobs_path", "failures", "verified_at"))
    news = scans.select("source_id", F.col("verified_at").alias("_ok"), F.col("failures").alias("_bad"))
    return replaced.join(news, "source_id", "left").withColumns({
        "failures": F.when(F.col("_ok").isNotNull(), F.col("_bad")).otherwise(F.col("failures") + F.coalesce(F.col("_bad"), F.lit(0))),
        "verified_at": F.coalesce(F.col("_ok"), F.col("verified_at")),
    }).drop("_ok", "_bad")


def pattern_scans(runs: DataFrame) -> DataFrame:
    """Per source: the last success and the failures after it."""
    last = runs.groupBy("source_id").agg(F.max(F.when(F.col("status") == "Succeeded", F.col("started_at"))).alias("verified_at"))
    failed = runs.filter(F.col("status") == "Failed").select("source_id", "started_at")
    after = failed.join(last, "source_id").filter(F.col("verified_at").isNull() | (F.col("started_at") > F.col("verified_at")))
    counts = after.groupBy("source_id").agg(F.count("*").alias("failures"))
    return last.join(counts, "source_id", "left").select(
        "source_id", "verified_at", F.coalesce("failures", F.lit(0)).alias("failures")
    )


def due_sources(sources: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Enabled scheduled sources whose time has come, all or the first ``limit``; those never scheduled come last, ids break ties."""
    due = F.col("next_run_at").isNull() | (F.col("next_run_at") <= as_of)
    ready = sources.filter(
        F.col("enabled") & (F.col("schedule") != "Manual") & F.col("owner_id").isNotNull() & due
    ).orderBy(F.asc_nulls_last("next_run_at"), "source_id")
    return ready if limit is None else ready.limit(limit)


def advance_schedule(sources: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """All sources after one tick: the claimed ones move to their next aligned slot, missed slots collapse into it."""
    claimed = due_sources(sources, as_of, limit).select("source_id").withColumn("claimed", F.lit(True))
    return sources.join(claimed, "source_id", "left").withColumns({
        "claimed": F.coalesce(F.col("claimed"), F.lit(False)),
        "next_run_at": F.when(F.col("claimed"), next_slot(F.col("schedule"), as_of)).otherwise(F.col("next_run_at")),
    })


def fold_runs(events: DataFrame) -> DataFrame:
    """One row per run from its events: the last event gives the state, the first start and last end the duration."""
    last = F.max_by("status", F.struct("at", "seq"))
    runs = events.groupBy("run_id").agg(
        last.alias("status"), F.min("at").alias("started_at"), F.max("at").alias("last_at"), F.count("*").alias("events")
    )
    done = F.col("status").isin("Succeeded", "Partial", "Failed")
    millis = F.unix_millis(F.col("last_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))
    return runs.withColumn("duration_ms", F.when(done, millis))


def cascade_disable(candidates: DataFrame, watchlist: DataFrame, sources: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove companies with their watchlist entries; their sources are disabled, not deleted."""
    gone = candidates.join(deleted, "candidate_id", "left_semi")
    left = candidates.join(deleted.select("candidate_id"), "candidate_id", "left_anti")
    watch = watchlist.join(
        gone.filter(F.col("watch_id").isNotNull()).select("watch_id", "user_id").distinct(), ["watch_id", "user_id"], "left_anti"
    )
    off = gone.filter(F.col("source_id").isNotNull()).select("source_id", F.col("user_id").alias("owner_id")).distinct().withColumn("_off", F.lit(True))
    disabled = sources.join(off, ["source_id", "owner_id"], "left").withColumns({
        "enabled": F.col("enabled") & F.col("_off").isNull(),
        "schedule": F.when(F.col("_off"), "Manual").otherwise(F.col("schedule")),
        "next_run_at": F.when(F.col("_off").isNull(), F.col("next_run_at")),
    }).drop("_off")
    return left, watch, disabled


def fold_state(events: DataFrame) -> DataFrame:
    """The latest value of every key."""
    return events.groupBy("key").agg(
        F.max_by("value", F.struct("updated_at", "seq")).alias("value"), F.max("updated_at").alias("updated_at")
    )
