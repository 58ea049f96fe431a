"""Evaluation of listings for their owners: eligible batch, budget, similarity, blended factors, scores, matches, alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.labels import listing_text
from ..functions.numbers import approx_tokens, cost_micros
from ..operators.contracts import FACTORS, factors_violation, weights_violation
from ..operators.gates import hard_filter
from ..operators.joins import spread_join
from ..operators.merge import insert_alerts, merge_matches
from ..operators.reports import alert_drafts, eval_batch, eval_candidates, month_spend
from ..operators.scoring import cosine, factor_scores, role_blend
from ..session import cut_lineage

#: What a call of the model takes on top of the texts, and what it answers at most.
PROMPT_TOKENS, ANSWER_TOKENS = 200, 700


def eligible_batch(spark: SparkSession, listings: DataFrame, refs: DataFrame, sources: DataFrame, matches: DataFrame, prefs: DataFrame) -> DataFrame:
    """What is evaluated next for each user: the cheap filters run before anything that costs money."""
    candidates = eval_candidates(listings, refs, sources, matches, prefs)
    passed = hard_filter(spark, candidates.withColumnRenamed("user_id", "owner_id"), prefs, counted=listings).filter(F.col("blocked").isNull())
    return eval_batch(passed.withColumnRenamed("owner_id", "user_id"), prefs)


def score_rows(rows: DataFrame, weights: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Scores for factor rows that carry a ``similarity``; rows or weights that break their contract get a ``problem``.

    ``counted``: a table with the users of the rows that is cheaper to read, for :func:`spread_join`.
    """
    named = weights.select("user_id", *[f"w_{f}" for f in FACTORS])
    joined = spread_join(rows, named, "user_id", "row_id", counted=counted, shuffled=True)
    weight = {f: F.col(f"w_{f}") for f in FACTORS}
    raw = {f: F.col(f) for f in FACTORS}
    problem = F.coalesce(weights_violation(weight), factors_violation(raw))
    blended = {**raw, "role": F.when(F.col("similarity").isNull(), raw["role"]).otherwise(role_blend(raw["role"], F.col("similarity")))}
    scored = joined.withColumn("problem", problem)
    return scored.withColumns({
        name: F.when(F.col("problem").isNull(), score) for name, score in factor_scores(blended, weight).items()
    })


def affordable(batch: DataFrame, spend: DataFrame, budgets: DataFrame) -> DataFrame:
    """The batch with ``affordable``: whether a user's budget still holds a row's ``estimate`` after all rows before it.

    People are not sent to every task: their file size tells too little. What comes before is a running sum over a user's batch, a few rows. Nothing of a row that cannot be paid is looked up or scored.
    """
    order = Window.partitionBy("user_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = batch.withColumn("running", F.sum("estimate").over(order))
    state = budgets.select("user_id", "budget_micros").join(spend, "user_id", "left")
    paid = summed.join(state.hint("merge"), "user_id", "left").withColumn("affordable", F.coalesce("spent", F.lit(0)) + F.col("running") <= F.coalesce("budget_micros", F.lit(0)))
    return paid.drop("running", "spent", "budget_micros")


@dataclass
class Evaluation:
    """The batch with what came of each row (``outcome``, scores), and the matches and new alerts after it."""

    batch: DataFrame
    matches: DataFrame
    alerts: DataFrame


def evaluate(
    spark: SparkSession, listings: DataFrame, refs: DataFrame, sources: DataFrame, matches: DataFrame, prefs: DataFrame, targets: DataFrame, vectors: DataFrame,
    answers: DataFrame, alerts: DataFrame, as_of: Column, text_limit: int | None = None,
) -> Evaluation:
    """One evaluation from the eligible batch to alerts.

    ``targets``: ``user_id, target_text, embedding``; ``vectors``: ``job_id, embedding``; ``answers``: what the model says of a user's listing,
    ``user_id, job_id, reason`` and the factors. All dates are ``as_of``, and alert keys name user, listing, score and date, so an
    evaluation that runs again gives the same rows. Outcomes: ``scored``; ``over_budget``; ``no_answer``; ``problem``, if factors or weights
    break their contract or weigh only one of the two groups. Only scored rows reach the matches.
    """
    batch = eligible_batch(spark, listings, refs, sources, matches, prefs)
    offered = listing_text(*[F.col(n) for n in ("title", "company", "location", "work_type", "employment_type", "seniority", "industry", "description")], limit=text_limit)
    asked = batch.join(targets.select("user_id", "target_text", F.col("embedding").alias("target")), "user_id", "left")
    tokens = approx_tokens(F.coalesce("target_text", F.lit("")), offered)
    priced = asked.withColumn("estimate", cost_micros(tokens + PROMPT_TOKENS, F.lit(ANSWER_TOKENS), tokens)).select("user_id", "job_id", "n", "target", "estimate")
    gated = affordable(priced, month_spend(matches, as_of), prefs)
    paid = gated.filter("affordable").join(vectors.select("job_id", "embedding"), "job_id", "left")
    similar = paid.withColumn("similarity", F.when(F.col("embedding").isNotNull() & F.col("target").isNotNull(), cosine(F.col("embedding"), F.col("target"))))
    answered = similar.join(answers, ["user_id", "job_id"]).withColumn("row_id", F.col("job_id"))
    scored = score_rows(answered, prefs, counted=answers).select("user_id", "job_id", "reason", "problem", "similarity", "overall_score", "qualification_score", "interest_score")
    whole = F.col("qualification_score").isNotNull() & F.col("interest_score").isNotNull()
    outcome = F.when(~F.col("affordable"), "over_budget").when(F.col("reason").isNull(), "no_answer").when(whole, "scored").otherwise("problem")
    # written once: batch, matches and alerts would each hold the whole plan again, which the driver keeps and runs three times over
    done = cut_lineage(gated.drop("target").join(scored, ["user_id", "job_id"], "left").withColumn("outcome", outcome), "evaluated")
    fresh = done.filter("outcome = 'scored'").select(
        "user_id", "job_id", F.col("overall_score").alias("score"), as_of.alias("evaluated_at"), F.col("estimate").alias("cost_micros"), "reason"
    )
    merged = merge_matches(matches.select(*fresh.columns), fresh)
    return Evaluation(done, merged, insert_alerts(alerts, alert_drafts(fresh, listings, prefs, counted=answers)))
