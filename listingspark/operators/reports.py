"""Reports: boards, latest runs, evaluation batches, digests, spend, alerts and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import alert_body, alert_title, digest_line, digest_sentence
from ..functions.dates import alert_key
from .gates import ACTIVE_APPLICATION_STATES, visible
from .joins import spread_join

PAGE_SIZE = 50


def board_join(listings: DataFrame, matches: DataFrame, saved: DataFrame, user_id: int) -> DataFrame:
    """A person's visible listings with their own match and saved state; the person is filtered before the joins."""
    mine = matches.filter(F.col("user_id") == user_id).select("job_id", "score", "evaluated_at")
    states = saved.filter(F.col("user_id") == user_id).select("job_id", "status")
    shown = listings.filter(visible(F.col("owner_id"), user_id))
    return shown.join(mine, "job_id", "left").join(states, "job_id", "left")


def board_order(sort: str = "score") -> list[Column]:
    newest = [F.desc("discovered_at"), F.asc("job_id")]
    return newest if sort == "newest" else [F.desc_nulls_last("score"), *newest]


def page_with_total(rows: DataFrame, order: list[Column], page: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of rows; every row carries the filtered total, found by a partial count rather than a global window."""
    page = max(1, page)
    total = rows.agg(F.count("*").alias("n")).scalar()
    shown = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return shown.withColumn("total", total).withColumn("has_more", F.lit(page * size) < F.col("total"))


def page_total(rows: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """The total and page facts on their own: a page past the end has no rows but still a total."""
    page = max(1, page)
    return rows.agg(F.count("*").alias("total")).select(
        "total", F.lit(page).cast("bigint").alias("page"), (F.lit(page * size) < F.col("total")).alias("has_more")
    )


def latest_run(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """Every source with its most recent run, or none."""
    last = runs.groupBy("source_id").agg(
        F.max_by(F.struct("run_id", "status", "started_at"), F.struct("started_at", "run_id")).alias("last")
    )
    return sources.join(last, "source_id", "left")


def runs_complete(requested: DataFrame, runs: DataFrame, owners: DataFrame) -> DataFrame:
    """Requested runs that may not be evaluated: unknown, someone else's, or not finished. None means go."""
    finished = runs.filter(F.col("status").isin("Succeeded", "Partial")).join(
        owners.select("source_id", F.col("owner_id").alias("user_id")), "source_id"
    ).select("run_id", "user_id")
    return requested.distinct().join(finished, ["run_id", "user_id"], "left_anti")


def eval_candidates(listings: DataFrame, refs: DataFrame, sources: DataFrame, matches: DataFrame, changed: DataFrame) -> DataFrame:
    """Owned active listings seen in the given sources that were never evaluated or are out of date.

    ``changed`` has per user when profile or preferences last changed. The semi join replaces a
    distinct over listings, so a listing with many references costs no more than one.
    """
    seen = refs.filter("active").join(sources.select("source_id"), "source_id", "left_semi").select("job_id")
    owned = listings.filter(F.col("owner_id").isNotNull() & (F.col("lifecycle") == "Active") & ~F.col("archived"))
    fresh = owned.join(seen, "job_id", "left_semi").withColumnRenamed("owner_id", "user_id")
    scored = fresh.join(matches.select("user_id", "job_id", "evaluated_at"), ["user_id", "job_id"], "left")
    dated = spread_join(scored, changed.select("user_id", "changed_at"), "user_id", "job_id", "left", counted=listings.select(F.col("owner_id").alias("user_id")), shuffled=True)
    stale = (
        F.col("evaluated_at").isNull() | (F.col("evaluated_at") < F.col("updated_at"))
        | (F.col("evaluated_at") < F.col("changed_at"))
    )
    return dated.filter(F.coalesce(stale, F.lit(False))).drop("evaluated_at", "changed_at")


def eval_batch(candidates: DataFrame, sizes: DataFrame, largest: int = 20) -> DataFrame:
    """The newest few candidates of each user, after the hard filter.

    Batches never exceed ``largest``; that constant limit also runs before the shuffle, so a user
    with very many candidates sends only a few rows per task. People are not sent to every task: their file size tells too little.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("discovered_at"), "job_id")
    top = candidates.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= largest)
    return top.join(sizes.select("user_id", "batch_size").hint("merge"), "user_id").filter(F.col("n") <= F.col("batch_size")).drop("batch_size")


def dashboard(listings: DataFrame, as_of: Column) -> DataFrame:
    today = F.date_trunc("day", as_of)
    return listings.filter(~F.col("archived")).agg(
        F.count("*").alias("total"), F.count_if(F.col("discovered_at") >= today).alias("new_today")
    )


def pipeline_counts(saved: DataFrame, listings: DataFrame) -> DataFrame:
    """Saved listings and applications that need attention, per user."""
    active = listings.filter(~F.col("archived")).select("job_id")
    return saved.join(active, "job_id").groupBy("user_id").agg(
        F.count_if(F.col("status") == "Saved").alias("saved"),
        F.count_if(F.col("status").isin(*ACTIVE_APPLICATION_STATES)).alias("applications"),
    )


def scored_join(matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Evaluations of active listings with what alerts and digests show."""
    active = listings.filter(~F.col("archived")).select("job_id", "title", "company", "location", "work_type")
    return matches.join(active, "job_id")


def digest_window(as_of: Column, hours: Column | int) -> Column:
    bounded = F.least(F.greatest(F.lit(hours), F.lit(1)), F.lit(720))
    return as_of - F.make_dt_interval(hours=bounded)


def digest_items(scored: DataFrame, since: Column, limit: int | None = None) -> DataFrame:
    """The evaluations of each user in the window, with ``limit`` only the best."""
    recent = scored.filter(F.col("evaluated_at") >= since)
    if limit is None:
        return recent
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "job_id")
    return recent.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def digest_counts(items: DataFrame, prefs: DataFrame) -> DataFrame:
    """How many of the looked-at evaluations fall in each class, by the user's own thresholds."""
    joined = items.join(prefs.select("user_id", "notify_min", "digest_min"), "user_id")
    s = F.col("score")
    return joined.groupBy("user_id").agg(
        F.count_if(s >= F.col("notify_min")).alias("excellent"),
        F.count_if((s >= F.col("digest_min")) & (s < F.col("notify_min"))).alias("strong"),
        F.count_if((s >= 65) & (s < F.col("digest_min"))).alias("possible"),
        F.count_if(s >= 90).alias("high_priority"),
    )


def digest_top(items: DataFrame, prefs: DataFrame, limit: int = 5) -> DataFrame:
    joined = items.join(prefs.select("user_id", "digest_min"), "user_id").filter(F.col("score") >= F.col("digest_min"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "job_id")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def digest_applications(saved: DataFrame, listings: DataFrame, limit: int | None = None) -> DataFrame:
    active = listings.filter(~F.col("archived")).select("job_id", "title", "company")
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "job_id")
    rows = saved.filter(F.col("status").isin(*ACTIVE_APPLICATION_STATES)).join(active, "job_id")
    return rows if limit is None else rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def new_listings(listings: DataFrame, since: Column) -> tuple[DataFrame, Column]:
    """New owned listings per user, and the number of shared ones everybody sees. Countries do not matter here."""
    fresh = listings.filter(~F.col("archived") & (F.col("discovered_at") >= since))
    own = fresh.filter(F.col("owner_id").isNotNull()).groupBy(F.col("owner_id").alias("user_id")).agg(F.count("*").alias("own"))
    shared = fresh.filter(F.col("owner_id").isNull()).agg(F.count("*")).scalar()
    return own, shared


def digests(users: DataFrame, listings: DataFrame, matches: DataFrame, saved: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The whole digest of every given user: counts, sentence and bullet lines."""
    since = digest_window(as_of, hours)
    items = digest_items(scored_join(matches, listings), since)
    counts = digest_counts(items, users)
    top = digest_top(items, users).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", digest_line(F.col("title"), F.col("company"), F.col("score")).alias("line")))).alias("top")
    )
    pending = digest_applications(saved, listings).groupBy("user_id").agg(F.count("*").alias("applications"))
    own, shared = new_listings(listings, since)
    joined = users.select("user_id").join(counts, "user_id", "left").join(top, "user_id", "left").join(
        pending, "user_id", "left"
    ).join(own, "user_id", "left")
    filled = joined.withColumns({
        **{n: F.coalesce(F.col(n), F.lit(0)) for n in ("excellent", "strong", "possible", "high_priority", "applications")},
        "new_jobs": F.coalesce(F.col("own"), F.lit(0)) + shared,
    })
    sentence = digest_sentence(
        F.col("new_jobs"), F.lit(min(max(hours, 1), 720)), F.col("high_priority"), F.col("strong"), F.col("possible"), F.col("applications")
    )
    lines = F.transform(F.coalesce("top", F.array().cast("array<struct<rank:int,line:string>>")), lambda t: t["line"])
    body = F.array_join(F.concat(F.array(sentence), lines), "\n")
    return filled.select("user_id", "new_jobs", "excellent", "strong", "possible", "high_priority", "applications", body.alias("body"))


def month_spend(costs: DataFrame, as_of: Column, at: str = "evaluated_at") -> DataFrame:
    """Spend since the start of the month, per user."""
    return costs.filter(F.col(at) >= F.date_trunc("month", as_of)).groupBy("user_id").agg(
        F.coalesce(F.sum("cost_micros"), F.lit(0)).cast("bigint").alias("spent")
    )


def budget_state(users: DataFrame, spend: DataFrame, estimate: Column | int) -> DataFrame:
    """Whether one more call of the estimated cost would exceed a user's budget."""
    return users.select("user_id", "budget_micros").join(spend, "user_id", "left").select(
        "user_id", F.coalesce("spent", F.lit(0)).alias("spent"), "budget_micros"
    ).withColumn("over_budget", F.col("spent") + F.lit(estimate) > F.col("budget_micros"))


DISCOVERY_RESERVE = 50_000


def settled_cost(outcome: Column, actual: Column, reserve: int = DISCOVERY_RESERVE) -> Column:
    """What a reserved call costs: nothing if it failed, the real cost if it was reported, else the reserve."""
    return F.when(outcome == "failed", F.lit(0)).otherwise(F.coalesce(actual, F.lit(reserve))).cast("bigint")


def unread(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("is_read")).groupBy("user_id").agg(F.count("*").alias("unread"))


def run_counters(rows: DataFrame) -> DataFrame:
    """What each run did, from its classified rows."""
    outcome = F.col("outcome")
    return rows.groupBy("run_id").agg(
        F.count_if(outcome != "removed").alias("discovered"),
        F.count_if(outcome == "added").alias("added"),
        F.count_if(outcome == "updated").alias("updated"),
        F.count_if(outcome == "removed").alias("removed"),
        F.count_if(outcome == "filtered").alias("filtered"),
    )


def run_warnings(warnings: DataFrame, filtered: DataFrame, limit: int | None = None) -> DataFrame:
    """The warnings of each run in order, with ``limit`` the first ones; a line on skipped listings comes first."""
    n = F.col("filtered")
    summary = filtered.filter(n > 0).select(
        "run_id", F.lit(-1).cast("bigint").alias("seq"),
        F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, "listing was").otherwise("listings were"), F.lit(" skipped by your keyword filters.")).alias("message"),
    )
    order = Window.partitionBy("run_id").orderBy("seq")
    first = warnings.select("run_id", F.col("seq").cast("bigint").alias("seq"), "message").unionByName(summary).withColumn(
        "n", F.row_number().over(order)
    )
    if limit is not None:
        first = first.filter(F.col("n") <= limit)
    return first.select("run_id", "n", "message")


def purge_counts(alerts: DataFrame, activity: DataFrame, alert_rule: Column, activity_rule: Column) -> DataFrame:
    a = alerts.agg(F.lit("alerts").alias("table_name"), F.count_if(alert_rule).alias("expired"), F.count("*").alias("rows"))
    b = activity.agg(F.lit("activity").alias("table_name"), F.count_if(activity_rule).alias("expired"), F.count("*").alias("rows"))
    return a.unionByName(b)


def schedule_summary(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    scheduled = sources.agg(F.count_if(F.col("enabled") & (F.col("schedule") != "Manual")).alias("scheduled"))
    waiting = candidates.agg(F.count_if(F.col("status").isin("Pending", "Resolving")).alias("in_flight"))
    return scheduled.withColumn("in_flight", waiting.scalar())


def status_timeline(log: DataFrame, limit: int) -> DataFrame:
    """The newest state changes of each listing, per user."""
    order = Window.partitionBy("user_id", "job_id").orderBy(F.desc("created_at"), F.desc("id"))
    return log.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)


def activity_page(activity: DataFrame, user_id: int, limit: int, before: tuple | None = None, candidate_id: int | None = None) -> DataFrame:
    """One page of the feed, newest first, by the whole sort key; ``before`` is the last row of the page before."""
    shown = activity.filter(visible(F.col("user_id"), user_id))
    if candidate_id is not None:
        shown = shown.filter(F.col("candidate_id") == candidate_id)
    if before is not None:
        at, row = before
        shown = shown.filter((F.col("created_at") < F.lit(at)) | ((F.col("created_at") == F.lit(at)) & (F.col("id") < F.lit(row))))
    return shown.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def alert_drafts(matches: DataFrame, listings: DataFrame, prefs: DataFrame, limit: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Alerts owed to users who want them: scores at their threshold, with ``limit`` the newest of each user.

    ``counted``: a table with the users that is cheaper to read than ``matches``.
    """
    wanted = prefs.filter("notifications_enabled").select("user_id", "notify_min")
    joined = spread_join(scored_join(matches, listings), wanted, "user_id", "job_id", counted=matches if counted is None else counted, shuffled=True)
    hits = joined.filter(F.col("score") >= F.col("notify_min"))
    top = hits
    if limit is not None:
        order = Window.partitionBy("user_id").orderBy(F.desc("evaluated_at"), "job_id")
        top = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    return top.select(
        "user_id", "job_id", F.lit("Match").alias("kind"), alert_title(F.col("score"), F.col("title")).alias("title"),
        alert_body(F.col("company"), F.col("location"), F.col("score"), F.col("reason")).alias("body"), "score",
        alert_key(F.col("job_id"), F.col("score"), F.col("evaluated_at")).alias("dedupe_key"),
    )


def alerts_page(alerts: DataFrame, listings: DataFrame, user_id: int, limit: int) -> DataFrame:
    """A person's newest alerts with the listing each is about, if any. Only the page itself is joined."""
    page = alerts.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("alert_id")).limit(max(limit, 1))
    return page.join(listings.select("job_id", F.col("title").alias("job_title"), "lifecycle"), "job_id", "left")


def run_history(runs: DataFrame, sources: DataFrame, shown: int) -> DataFrame:
    """The newest runs over some sources."""
    return runs.join(sources.select("source_id"), "source_id", "left_semi").orderBy(F.desc("started_at"), F.desc("run_id")).limit(shown)


def digest_due(prefs: DataFrame, as_of: Column) -> DataFrame:
    return prefs.filter(F.col("digest_enabled") & (F.col("digest_hour") == F.hour(as_of))).select("user_id")
