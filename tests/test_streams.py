import time

import pytest
from pyspark.sql import functions as F

from listingspark.sources.tables import BatchTable
from listingspark.streaming import jobs

EVENTS = "key string, ts timestamp"


def land(spark, folder, name, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")


def stream(spark, folder, schema=EVENTS):
    return spark.readStream.schema(schema).parquet(f"{folder}/in/*")


def at(text):
    import datetime as dt

    return dt.datetime.fromisoformat(f"2024-01-01T{text}")


def test_silence_is_told_when_nothing_arrives_at_all(spark, tmp_path):
    """Two sources beat once; no event follows, and the clock makes both unhealthy and empties the state."""
    land(spark, tmp_path, "a", [("x", at("00:00:00")), ("y", at("00:00:05"))])
    out = []
    rows = jobs.source_health(stream(spark, tmp_path), "key", "ts", minutes=1 / 30, live=True)
    query = rows.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).foreachBatch(lambda b, _: out.extend(b.collect())).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while time.time() < end and sum(not r.healthy for r in out) < 2:
            time.sleep(0.5)
        time.sleep(3)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    finally:
        query.stop()
    assert sorted((r.key, r.healthy) for r in out) == [("x", False), ("x", True), ("y", False), ("y", True)]
    assert held[0] == 2 and held[-1] == 0


def test_silence_by_event_time_ends_and_begins_again(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "key")
    seen = {}
    landings = [[("x", at("00:00:00")), ("y", at("00:00:00"))], [("y", at("00:30:00"))], [("y", at("01:00:00")), ("x", at("01:00:00"))]]
    for i, rows in enumerate(landings):
        land(spark, tmp_path, f"l{i}", rows)
        health = jobs.source_health(stream(spark, tmp_path), "key", "ts", minutes=10)
        query = jobs.run_available(jobs.upsert_stream(health, table, jobs.latest_verdicts, str(tmp_path / "at"), "update"))
        seen[i] = {r.key: r.healthy for r in table.current().collect()}, query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]
    assert seen == {0: ({"x": True, "y": True}, 2), 1: ({"x": False, "y": True}, 1), 2: ({"x": True, "y": True}, 2)}


ALERTS = "user_id int, dedupe_key string, ts timestamp"


def test_no_alert_is_lost_or_doubled_however_late(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    landings = [
        [(1, "a", day(100)), (1, "a", day(100)), (2, "a", day(99))],
        [(1, "b", day(1)), (1, "a", day(100)), (3, "c", day(101))],  # b is 99 days old
        [(1, "b", day(1)), (2, "a", day(99)), (1, "d", day(2))],
    ]
    table, marks = BatchTable(spark, str(tmp_path / "t"), "user_id", "dedupe_key"), jobs.Marks(BatchTable(spark, str(tmp_path / "m"), "n"))
    for i, rows in enumerate(landings):
        land(spark, tmp_path, f"l{i}", rows, ALERTS)
        jobs.run_available(jobs.alert_stream(stream(spark, tmp_path, ALERTS), table, marks, "ts", str(tmp_path / "at"), "30 days"))
    assert sorted((r.user_id, r.dedupe_key) for r in table.rows().collect()) == [(1, "a"), (1, "b"), (1, "d"), (2, "a"), (3, "c")]
    assert [r.late for r in marks.table.current().orderBy("n").collect()] == [0, 1, 2]


@pytest.mark.parametrize("slices", [1, 4])
def test_runs_and_digests_do_not_depend_on_the_landings(spark, tmp_path, slices):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(3), at(f"{rng.randrange(24):02}:{rng.randrange(60):02}:00"), i, rng.choice(["Running", "Failed", "Succeeded"])) for i in range(200)]
    schema = "run_id int, user_id int, at timestamp, seq int, status string"
    runs, digest, marks = BatchTable(spark, str(tmp_path / "r"), "run_id"), BatchTable(spark, str(tmp_path / "d"), "user_id", "hour"), jobs.Marks(BatchTable(spark, str(tmp_path / "m"), "n"))
    for i in range(slices):
        land(spark, tmp_path, f"l{i}", rows[i::slices], schema)
        jobs.run_available(jobs.run_fold_stream(stream(spark, tmp_path, schema), runs, str(tmp_path / "at-r")))
        jobs.run_available(jobs.digest_stream(stream(spark, tmp_path, schema), digest, marks, "at", str(tmp_path / "at-d")))
    want = {k: max((r[2], r[3], r[4]) for r in rows if r[0] == k)[2] for k in {r[0] for r in rows}}
    assert {r.run_id: r.status for r in jobs.run_states(runs).collect()} == want and sum(r.events for r in jobs.run_states(runs).collect()) == 200
    got = digest.current().agg(F.sum("events").alias("events"), F.sum("late").alias("late")).first()
    assert got.events == 200 and (got.late == 0) == (slices == 1)
