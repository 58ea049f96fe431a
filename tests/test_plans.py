import pytest
from pyspark.sql import functions as F

from listingspark.plans import board, scan
from listingspark.streaming import jobs


def test_board_pages_concatenate(spark):
    listings = spark.range(123).select(
        F.col("id").alias("job_id"), F.lit(None).cast("long").alias("owner_id"), F.concat(F.lit("T"), "id").alias("title"), F.lit("C").alias("company"), F.lit("Oslo").alias("location"),
        F.lit("").alias("country"), F.lit("Remote").alias("work_type"), F.lit(False).alias("archived"), (F.col("id") % 3).alias("discovered_at"))
    matches = spark.range(60).select(F.col("id").alias("job_id"), F.lit(1).alias("user_id"), (F.col("id") % 7).cast("int").alias("score"), F.lit(0).alias("evaluated_at"))
    saved = spark.createDataFrame([(1, 1, "Saved")], "user_id int, job_id long, status string")
    pages = [board.board(spark, listings, matches, saved, 1, page=p).collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [50, 50, 23, 0]
    assert len({r.job_id for p in pages for r in p}) == 123
    assert all(r.total == 123 for p in pages for r in p)
    scores = [r.score for p in pages for r in p]
    assert scores == sorted([s for s in scores if s is not None], reverse=True) + [None] * scores.count(None)


def test_scan_conserves_rows(spark):
    schema = "source_id int, page_no int, ordinal int, external_id string, title string, company string, description string, job_url string, description_hash string, violations array<string>"
    rows = [
        (1, 1, 0, "a", "Keep", "C", "text one", "https://x.com/a?utm_source=q", "h1", []), (1, 1, 1, "b", "Blocked terraform", "C", "text two", "https://x.com/b", "h2", []),
        (1, 1, 2, "c", "Broken", "C", "text", "https://x.com/c", "h3", ["description"]),
    ]
    normalized = spark.createDataFrame(rows, schema)
    empty = "owner_id int, canonical_hash string, job_id string, title string, company string, description string, job_url string, description_hash string, last_run int, last_seen timestamp, lifecycle string, archived timestamp, discovered_at timestamp"
    listings = spark.createDataFrame([], empty)
    refs = spark.createDataFrame([], "source_id int, external_id string, job_id string, active boolean, last_seen timestamp")
    sources = spark.createDataFrame([(1, 5, 70)], "source_id int, owner_id int, run_id int")
    prefs = spark.createDataFrame([(5, [], ["terraform"])], "user_id int, include_keywords array<string>, negative_keywords array<string>")
    verdicts = spark.createDataFrame([(1, True)], "source_id int, may_retire boolean")
    at = F.lit("2024-01-01").cast("timestamp")
    first = scan.scan(normalized, normalized.select("source_id", "external_id"), verdicts, sources, prefs, listings, refs, at)
    count = first.counters.first()
    assert (count.run_id, count.added, count.updated, count.filtered, count.removed, count.discovered) == (70, 1, 0, 1, 0, 3)
    assert [(r.company, r.description, r.job_url) for r in first.listings.collect()] == [("C", "text one", "https://x.com/a?utm_source=q")]
    assert first.refs.join(first.listings, "job_id", "left_semi").count() == 1
    only_b = normalized.filter("external_id = 'b'")
    second = scan.scan(only_b, only_b.select("source_id", "external_id"), verdicts, sources, prefs, first.listings, first.refs, at)
    assert [(r.lifecycle) for r in second.listings.collect()] == ["Removed"]
    assert [(r.run_id, r.removed) for r in second.counters.filter("removed > 0").collect()] == [(70, 1)]
    replay = scan.scan(normalized, normalized.select("source_id", "external_id"), verdicts, sources, prefs, first.listings, first.refs, at)
    assert replay.counters.first().added == 0
    assert sorted(map(tuple, replay.listings.collect())) == sorted(map(tuple, first.listings.collect()))


@pytest.mark.parametrize("seconds", [10, 1])
def test_rate_windows_match_a_plain_loop(spark, seconds):
    import random

    rng = random.Random(7)
    events = [(rng.choice("aab"), rng.randrange(0, 120_000)) for _ in range(800)]
    df = spark.createDataFrame(events, "key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    want = []
    for key in "ab":
        start, expires, count = None, -1, 0
        for ms in sorted(m for k, m in events if k == key):
            if ms > expires:
                if start is not None:
                    want.append((key, start, count, max(0, count - 3)))
                start, expires, count = ms, ms + seconds * 1000, 0
            count += 1
        want.append((key, start, count, max(0, count - 3)))
    rows = jobs.rate_windows(df, "key", "ts", limit=3, seconds=seconds).collect()
    assert sorted((r.key, r.window_start_ms, r.attempts, r.over_limit) for r in rows) == sorted(want)


@pytest.mark.parametrize("frame", [3, 10_000])
def test_streamed_rate_does_not_depend_on_frames(spark, tmp_path, frame):
    """Forty events of one key, landed newest first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", frame)
    try:
        rows = spark.createDataFrame([("k", 60 * (40 - i)) for i in range(40)], "key string, s long").withColumn("ts", F.timestamp_seconds("s"))
        rows.coalesce(1).write.parquet(f"{tmp_path}/in")
        out = []
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        counted = jobs.rate_counter(stream, "key", "ts", limit=5, seconds=600)
        jobs.run_available(counted.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/at").foreachBatch(lambda b, _: out.extend(b.collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.window_start_ms // 60_000, r.attempts, r.over_limit) for r in out) == [(1, 11, 6), (12, 11, 6), (23, 11, 6), (34, 7, 2)]


def test_state_rows_and_backfills_are_single(spark):
    from listingspark.operators import merge

    candidates = spark.createDataFrame([(1, 2, "Resolving"), (2, 1, "Resolved")], "candidate_id int, attempts int, status string")
    results = spark.createDataFrame([(1, 1, "Failed"), (1, 2, "Resolved"), (1, 2, "Resolved"), (2, 1, "Failed")], "candidate_id int, attempts int, status string")
    assert sorted(map(tuple, merge.candidate_transitions(candidates, results).collect())) == [(1, 2, "Resolved", "applied"), (2, 1, "Resolved", "fenced")]
    assert sorted(map(tuple, merge.fenced_results(candidates, results).collect())) == [(1, 1, "Failed"), (2, 1, "Failed")]
    named = spark.createDataFrame([(7, 5, "Acme", "b.com"), (7, 3, " ACME", "a.com"), (7, 9, "Acme", "a.com")], "user_id int, candidate_id int, name string, domain string")
    watch = spark.createDataFrame([(7, 1, "acme", ""), (7, 2, "acme", "b.com")], "user_id int, watch_id int, company string, domain string")
    got = sorted(map(tuple, merge.link_by_key(named, watch).select("candidate_id", "watch_id", "backfill", "domain").collect()))
    assert got == [(3, 1, True, "a.com"), (5, 2, False, "b.com"), (9, 1, False, "a.com")]
