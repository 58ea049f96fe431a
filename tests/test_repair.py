import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from listingspark.operators import repair as R
from listingspark.plans import evaluate

RUNS = "source_id int, run_id int, started_at timestamp, status string"
START = dt.datetime(2024, 1, 1)


def runs(seed, many=400):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), i, START + dt.timedelta(minutes=rng.randrange(3000)), rng.choice(["Failed"] * 5 + ["Succeeded", "Partial", "Running"])) for i in range(many)]
    return rows + [(9, 1000 + i, START, "Failed") for i in range(70)]  # all at one instant


def by_hand(rows):
    streaks, found = {}, {}
    for source, run, _, status in sorted(rows, key=lambda r: (r[2], r[1])):
        if status == "Failed":
            found[run] = streaks[source] = streaks.get(source, 0) + 1
        elif status != "Running":
            streaks[source] = 0
    return found, streaks


@pytest.mark.parametrize("cuts", [[], [1000], [17, 900, 901, 2400]])
def test_streaks_in_batches_equal_those_over_all(spark, cuts):
    rows = runs(len(cuts))
    random.Random(1).shuffle(rows)
    edges = [-1, *cuts, 10**6]
    carried, got = None, {}
    for low, high in zip(edges, edges[1:]):
        part = [r for r in rows if low < (r[2] - START).total_seconds() / 60 <= high]
        df = spark.createDataFrame(part, RUNS).repartition(3)
        got |= {r.run_id: r.streak for r in R.failure_streaks(df, carried).collect()}
        carried = spark.createDataFrame(R.open_streaks(df, carried).collect(), "source_id int, streak long")
    assert (got, {r.source_id: r.streak for r in carried.collect()}) == by_hand(rows)


def test_a_company_is_looked_up_again_after_three_failures(spark):
    df = spark.createDataFrame([(1, i, START + dt.timedelta(hours=i), s) for i, s in enumerate(["Failed", "Failed", "Running", "Failed", "Failed", "Partial", "Failed", "Failed"])], RUNS)
    companies = spark.createDataFrame([(1, 1, "Resolved"), (2, 1, "Resolving"), (3, 2, "Blocked"), (4, None, "Resolved")], "candidate_id int, source_id int, status string")
    got = {r.candidate_id: (r.next_status, r.resets) for r in R.repaired_candidates(companies, R.failure_streaks(df)).collect()}
    assert got == {1: ("Pending", 1), 2: ("Resolving", 1), 3: ("Blocked", 0), 4: ("Resolved", 0)}


def test_claims_are_fair(spark):
    """One user holds 90 % of the queue, and all of it is older; the others are served before their second company."""
    rows = [(i, 1, "Pending", START, START + dt.timedelta(seconds=i)) for i in range(900)] + [(1000 + i, 2 + i % 50, "Pending", START, START + dt.timedelta(days=1, seconds=i)) for i in range(100)]
    rows += [(2000, 5, "Resolving", START + dt.timedelta(days=2), START)]  # user 5 has one in flight
    df = spark.createDataFrame(rows, "candidate_id int, user_id int, status string, last_checked_at timestamp, created_at timestamp")
    claims = R.fair_claims(df, F.lit("2024-01-03 00:05:00").cast("timestamp"), 60)
    got = claims.collect()
    first = [r.user_id for r in got if r.turn == 1]
    assert sorted(first) == [u for u in range(1, 52) if u != 5] and got[0].user_id == 1 and len(got) == 60
    plan = claims._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[1] and "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan


def test_conflicting_resolutions(spark):
    rows = [(1, 7, "Lever:a", START), (2, 7, "Lever:a", START), (3, 8, "Lever:a", START), (4, 7, "Lever:b", START), (2, 7, "Lever:a", START)]
    df = spark.createDataFrame(rows, "candidate_id int, user_id int, identity string, created_at timestamp")
    assert [tuple(r) for r in R.source_conflicts(df).collect()] == [(2, 7, "Lever:a", 1)]


def test_the_budget_cuts_before_the_scores(spark):
    batch = spark.createDataFrame([(1, 10, 1, 100), (1, 11, 2, 100), (1, 12, 3, 1), (2, 13, 1, 50), (3, 14, 1, 1)], "user_id int, job_id int, n int, estimate long")
    spend = spark.createDataFrame([(1, 800)], "user_id int, spent long")
    budgets = spark.createDataFrame([(1, 900), (2, 50)], "user_id int, budget_micros long")
    got = {r.job_id: r.affordable for r in evaluate.affordable(batch, spend, budgets).collect()}
    assert got == {10: True, 11: False, 12: False, 13: True, 14: False}


def test_every_outcome_of_an_evaluation(spark):
    from suite import planned

    rows = planned.evaluate_job(spark, "/root/testdata/sf0.01").collect()
    outcomes = {r.outcome for r in rows}
    assert {"scored", "over_budget"} <= outcomes <= {"scored", "over_budget", "no_answer", "problem"}
    assert all((r.merged is not None) == (r.outcome == "scored") for r in rows) and len({(r.user_id, r.job_id) for r in rows}) == len(rows)
