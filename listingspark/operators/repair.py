"""Keeping sources working: failures in a row, fair claims of companies that wait, two companies that lead to one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .gates import is_due
from .joins import spread_join

FINISHED = ("Succeeded", "Partial", "Failed")


def _spans(runs: DataFrame, carried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Failed runs with how many of their hour's failures they end (``here``) and whether the hour had a success before (``broken``);
    and of every hour how long a streak it leaves (``left``) and how long the one was that it met (``met``)."""
    done = runs.filter(F.col("status").isin(*FINISHED)).select("source_id", "run_id", "started_at", (F.col("status") == "Failed").alias("failed"))
    hourly = done.withColumn("hour", F.date_trunc("hour", "started_at"))
    order = Window.partitionBy("source_id", "hour").orderBy("started_at", "run_id")
    marked = hourly.withColumn("breaks", F.sum((~F.col("failed")).cast("int")).over(order))
    inner = Window.partitionBy("source_id", "hour", "breaks").orderBy("started_at", "run_id")
    failed = marked.filter("failed").select("source_id", "run_id", "started_at", "hour", (F.col("breaks") > 0).alias("broken"), F.row_number().over(inner).alias("here"))
    # the failures after an hour's last success are those with its highest count of breaks
    hours = marked.groupBy("source_id", "hour", "breaks").agg(F.count_if("failed").alias("n")).groupBy("source_id", "hour").agg(F.max_by("n", "breaks").alias("tail"), F.max("breaks").alias("breaks"))
    by_hour = Window.partitionBy("source_id").orderBy("hour")
    islands = hours.withColumn("island", F.sum((F.col("breaks") > 0).cast("int")).over(by_hour))
    if carried is None:
        islands = islands.withColumn("before", F.lit(0))
    else:
        islands = islands.join(carried.select("source_id", F.col("streak").alias("before")), "source_id", "left")
    start = F.when(F.col("island") == 0, F.coalesce("before", F.lit(0))).otherwise(0)
    left = start + F.sum("tail").over(Window.partitionBy("source_id", "island").orderBy("hour"))
    ended = islands.withColumn("left", left)
    return failed, ended.select("source_id", "hour", "left", F.coalesce(F.lag("left").over(by_hour), F.col("before"), F.lit(0)).alias("met"))


def failure_streaks(runs: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Every failed run with its place in its source's row of failures: ``source_id, run_id, started_at, streak``.

    ``carried`` has the streaks that were open before these runs (``source_id, streak``), so that history is not read again. Runs that
    have not finished neither end nor lengthen a streak. A source's runs are ordered an hour at a time, and its hours, one row
    each, after that, so a source with very many runs is no single sort.
    """
    failed, hours = _spans(runs, carried)
    placed = failed.join(hours.select("source_id", "hour", "met"), ["source_id", "hour"])
    return placed.select("source_id", "run_id", "started_at", (F.col("here") + F.when(F.col("broken"), 0).otherwise(F.col("met"))).cast("bigint").alias("streak"))


def open_streaks(runs: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """``source_id, streak`` of all sources after these runs: what the next batch of runs carries on."""
    _, hours = _spans(runs, carried)
    now = hours.groupBy("source_id").agg(F.max_by("left", "hour").cast("bigint").alias("streak"))
    return now if carried is None else now.unionByName(carried.join(now, "source_id", "left_anti").select("source_id", "streak"))


def repaired_candidates(candidates: DataFrame, streaks: DataFrame, after: int = 3) -> DataFrame:
    """Companies with what failures do to them: after each ``after`` failures in a row of its source, one is looked up again.

    Adds ``next_status`` and ``resets``, how often that happened. A company that waits or is being looked up already stays as it is.
    """
    resets = streaks.filter(F.col("streak") % after == 0).groupBy("source_id").agg(F.count("*").alias("resets"))
    waiting = F.col("status").isin("Pending", "Resolving")
    joined = spread_join(candidates, resets, "source_id", "candidate_id", "left").withColumn("resets", F.coalesce("resets", F.lit(0)))
    return joined.withColumn("next_status", F.when((F.col("resets") > 0) & ~waiting, "Pending").otherwise(F.col("status")))


def fair_claims(candidates: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The next companies to look up, one of each user in turn: ``candidate_id, user_id, turn``.

    A user's turn counts on from what is already being looked up for them. Of each user no more than ``limit`` can be claimed, and
    that rank limit runs in every task before the shuffle; the order over all users is a sort with a limit, not a window.
    """
    busy = candidates.filter((F.col("status") == "Resolving") & ~is_due(as_of))
    ahead = busy.groupBy("user_id").agg(F.count("*").alias("ahead"))
    own = Window.partitionBy("user_id").orderBy("created_at", "candidate_id")
    first = candidates.filter(is_due(as_of)).withColumn("place", F.row_number().over(own)).filter(F.col("place") <= limit)
    turned = first.join(ahead, "user_id", "left").withColumn("turn", (F.col("place") + F.coalesce("ahead", F.lit(0))).cast("bigint"))
    return turned.orderBy("turn", "created_at", "candidate_id").limit(limit).select("candidate_id", "user_id", "turn")


def source_conflicts(resolutions: DataFrame) -> DataFrame:
    """Resolutions that lead to a source which an earlier company of the same user already has: ``candidate_id, user_id, identity, holder``."""
    first = resolutions.groupBy("user_id", "identity").agg(F.min_by("candidate_id", F.struct("created_at", "candidate_id")).alias("holder"), F.count_distinct("candidate_id").alias("n"))
    shared = first.filter("n > 1").drop("n")
    return resolutions.join(shared, ["user_id", "identity"]).filter(F.col("candidate_id") != F.col("holder")).select("candidate_id", "user_id", "identity", "holder").distinct()
