"""Streams: the tables are landed in slices, streamed to the end, and compared with the batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from listingspark.functions import dates, text
from listingspark.functions.urls import canonical_url
from listingspark.operators import merge
from listingspark.session import cut_lineage, working_folder
from listingspark.sources import registry
from listingspark.sources.tables import BatchTable
from listingspark.streaming import jobs

from . import duck
from .feeds import payloads
from .gating import moment
from .merges import run_events
from .views import sql, view

c = F.col
SLICES = 3


def stream_landings(df: DataFrame, slice_by: str, name: str, writer_of) -> None:
    """Land ``df`` in a few slices; after each one the stream runs until it has caught up."""
    spark = df.sparkSession
    folder, checkpoint = working_folder(spark, f"{name}-landing"), working_folder(spark, f"{name}-checkpoint")
    for i in range(SLICES):
        df.filter(F.expr(f"{slice_by} = {i}")).write.parquet(f"{folder}/landing-{i}")
        stream = spark.readStream.schema(df.schema).parquet(f"{folder}/landing-*")
        jobs.run_available(writer_of(stream, checkpoint))


def _table(spark, name: str, *keys: str) -> BatchTable:
    return BatchTable(spark, working_folder(spark, name), *keys)


def _marks(spark, name: str) -> jobs.Marks:
    return jobs.Marks(_table(spark, f"{name}-marks", "n"))


def stream_ingest(spark, sf):
    """Payloads of one feed streamed into the listings; later landings bring changed descriptions."""
    base = payloads(spark, sf, "Remotive").withColumn("slice", F.expr("page_no % 2"))
    changed = base.filter("slice = 0 AND page_no % 4 = 0").withColumns({"slice": F.lit(2), "payload": F.replace("payload", F.lit("R&amp;D"), F.lit("Research"))})
    table = _table(spark, "stream-ingest", "owner_id", "canonical_hash")

    def normalize(batch: DataFrame) -> DataFrame:
        rows = registry.normalize(batch, "Remotive").filter(F.size("violations") == 0)
        return rows.select(
            c("source_id").alias("owner_id"), text.content_hash(canonical_url(c("job_url"))).alias("canonical_hash"), c("external_id").alias("job_id"), "title", "description_hash",
            F.lit(1).cast("bigint").alias("last_seen"), F.lit("Active").alias("lifecycle"), F.lit(False).alias("archived"), F.lit(1).cast("bigint").alias("discovered_at"),
            F.struct("page_no", "ordinal").alias("ordinal"),
        )

    def into(current: DataFrame | None, rows: DataFrame) -> DataFrame:
        if current is None:
            current = rows.filter(F.lit(False)).drop("ordinal").withColumn("changes", F.lit(0).cast("bigint"))
        merged = merge.merge_listings(current.drop("changes"), rows)
        before = current.select("owner_id", "canonical_hash", "changes")
        return merged.join(before, ["owner_id", "canonical_hash"], "left").withColumn(
            "changes", F.coalesce("changes", F.lit(0)) + F.when(c("outcome") == "updated", 1).otherwise(0)
        ).drop("outcome")

    stream_landings(base.unionByName(changed), "slice", "ingest", lambda s, at: jobs.ingest(s.drop("slice"), normalize, table, into, at))
    return table.current().select("owner_id", "job_id", "title", "description_hash", "changes")


def _alert_drafts(spark, sf):
    """Evaluations in three landings: newer ones, older ones that come after, and all of them once more."""
    drafts = view(spark, sf, "v_matches").filter("score >= 90").select(
        "user_id", dates.alert_key(c("job_id"), c("score"), c("evaluated_at")).alias("dedupe_key"), c("evaluated_at").cast("timestamp").alias("at"),
        F.expr("CASE WHEN job_id % 3 = 0 AND evaluated_at < TIMESTAMP '1999-01-01 00:00:00' THEN 1 ELSE 0 END").alias("slice"),
    )
    return drafts.unionByName(drafts.withColumn("slice", F.lit(2)))


def stream_alerts(spark, sf):
    """Each alert key comes out once, with a horizon of 30 days and replays that are years older."""
    table = _table(spark, "alerts", "user_id", "dedupe_key")
    marks = _marks(spark, "alerts")
    stream_landings(_alert_drafts(spark, sf), "slice", "alerts", lambda s, at: jobs.alert_stream(s.drop("slice"), table, marks, "at", at, "30 days"))
    return table.rows().select("user_id", "dedupe_key")


def stream_late(spark, sf):
    """How many rows of each landing were older than the horizon allows."""
    table, marks = _table(spark, "late", "user_id", "dedupe_key"), _marks(spark, "late")
    stream_landings(_alert_drafts(spark, sf), "slice", "late", lambda s, at: jobs.alert_stream(s.drop("slice"), table, marks, "at", at, "30 days"))
    return marks.table.current().select(c("n").cast("bigint").alias("batch"), "late")


def _sliced_events(spark, sf):
    return view(spark, sf, "events").withColumns({"ts": c("ts").cast("timestamp"), "slice": F.expr(f"event_id % {SLICES}")})


def _verdicts(spark, sf):
    """The last verdict on each source after all landings, in the order of time."""
    table = _table(spark, "health", "key")
    stream_landings(_timed(spark, sf), "slice", "health", lambda s, at: jobs.upsert_stream(
        jobs.source_health(s, "user_id", "ts", minutes=SILENT_MINUTES), table, jobs.latest_verdicts, at, "update"))
    return table.current()


SILENT_MINUTES = 600


def stream_health(spark, sf):
    """Who has spoken lately, as of an instant."""
    beats = _verdicts(spark, sf).select(c("key").cast("bigint").alias("user_id"), F.timestamp_millis("last_ms").alias("last_at"))
    return jobs.health(beats, F.lit("2024-01-30 23:00:00").cast("timestamp"), SILENT_MINUTES).select("user_id", F.unix_millis("last_at").alias("last_ms"), "healthy")


def stream_silence(spark, sf):
    """Sources that the stream itself declared unhealthy when their time ran out, without a further event of theirs."""
    return _verdicts(spark, sf).filter("not healthy").select(c("key").cast("bigint").alias("user_id"), "last_ms", "at_ms")


def _timed(spark, sf):
    """Events in three landings by time, as a counter would meet them."""
    events = view(spark, sf, "events").withColumns({"ts": c("ts").cast("timestamp")})
    return events.withColumn("slice", F.expr("CASE WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END"))


RATE = dict(limit=2, seconds=43_200)


def stream_rate(spark, sf):
    out = working_folder(spark, "rate-out")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def writer(stream: DataFrame, at: str):
        counted = jobs.rate_counter(stream, "user_id", "ts", **RATE)
        return counted.writeStream.outputMode("update").option("checkpointLocation", at).foreachBatch(keep)

    stream_landings(_timed(spark, sf), "slice", "rate", writer)
    return jobs.total_windows(spark.read.parquet(out))


def rate_windows(spark, sf):
    return jobs.rate_windows(view(spark, sf, "events"), "user_id", "ts", **RATE)


def stream_digest(spark, sf):
    """Events in landings without any order: every one is counted, and how many came late."""
    table, marks = _table(spark, "digest", "user_id", "hour"), _marks(spark, "digest")
    stream_landings(_sliced_events(spark, sf), "slice", "digest", lambda s, at: jobs.digest_stream(s, table, marks, "ts", at))
    return table.current().select("user_id", F.unix_seconds("hour").alias("hour_s"), "events", "late")


def stream_run_fold(spark, sf):
    table = _table(spark, "runs", "run_id")
    events = run_events(spark, sf).withColumns({"at": c("at").cast("timestamp"), "slice": F.expr(f"seq % {SLICES}")})
    stream_landings(events, "slice", "runs", lambda s, at: jobs.run_fold_stream(s, table, at))
    return jobs.run_states(table).select("run_id", "status", F.unix_micros("last_at").alias("last_us"), "events")


def stream_activity_purge(spark, sf):
    rows = view(spark, sf, "v_activity").withColumn("day", F.to_date("created_at"))
    name = f"activity_{uuid.uuid4().hex}"
    rows.write.format("parquet").partitionBy("day").saveAsTable(name)
    try:
        jobs.purge_by_date(spark, name, "day", "created_at", moment("2024-01-17 09:00:00"))
        return cut_lineage(spark.table(name).select("id", "user_id", "created_at"), "activity")
    finally:
        spark.sql(f"DROP TABLE {name}")


QUERIES = {f.__name__: f for f in (
    stream_ingest, stream_alerts, stream_late, stream_health, stream_silence, stream_rate, rate_windows, stream_digest, stream_run_fold, stream_activity_purge,
)}

# A window starts at its first event; the next one at the first event more than the span later.
RATE_SQL = (
    "WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms FROM events), "
    "w AS (SELECT key, min(ms) AS s FROM e GROUP BY key UNION ALL SELECT key, s FROM (SELECT w.key AS key, min(e.ms) AS s FROM w JOIN e ON e.key = w.key AND e.ms > w.s + 43200000 GROUP BY w.key, w.s)) "
    "SELECT w.key, w.s AS window_start_ms, w.s + 43200000 AS expires_ms, count(*) AS attempts, CAST(greatest(0, count(*) - 2) AS BIGINT) AS over_limit FROM w JOIN e ON e.key = w.key AND e.ms BETWEEN w.s AND w.s + 43200000 GROUP BY w.key, w.s"
)
_TEXT = "concat('<p>', text, '</p><br/>{r} &#233;t&#xE9; &copy;<script>x(\"</p>\")</script><ul><li>a</li></ul>')"

ORACLE = {
    "stream_ingest": sql("v_feed",
        "SELECT source_id AS owner_id, CAST(n AS VARCHAR) AS job_id, title, sha256(CASE WHEN page_no % 4 = 0 THEN later ELSE first END) AS description_hash, CAST(CASE WHEN page_no % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS changes FROM made WHERE length(first) BETWEEN 20 AND 100000 AND length(title) >= 2",
        f"made AS (SELECT source_id, n, page_no, {duck.html_to_text('title')} AS title, {duck.html_to_text('body')} AS first, {duck.html_to_text('replace(body, ' + duck.q('R&amp;D') + ', ' + duck.q('Research') + ')')} AS later FROM v_feed)"),
    "stream_alerts": sql("v_matches", "SELECT DISTINCT user_id, concat('match:', job_id, ':', score, ':', epoch_ms(evaluated_at)) AS dedupe_key FROM v_matches WHERE score >= 90"),
    "stream_late": sql("v_matches", "SELECT CAST(b AS BIGINT) AS batch, coalesce(count(*) FILTER (WHERE t < mark), 0) AS late FROM d JOIN marks USING (b) GROUP BY b",
        "e AS (SELECT evaluated_at AS t, CASE WHEN job_id % 3 = 0 AND evaluated_at < TIMESTAMP '1999-01-01 00:00:00' THEN 1 ELSE 0 END AS b FROM v_matches WHERE score >= 90)",
        "d AS (SELECT t, b FROM e UNION ALL SELECT t, 2 FROM e)",
        "marks AS (SELECT b, (SELECT max(t) FROM d x WHERE x.b < y.b) - INTERVAL 30 DAY AS mark FROM (SELECT DISTINCT b FROM d) y)"),
    "stream_silence": "SELECT user_id, epoch_us(max(ts)) // 1000 AS last_ms, epoch_us(max(ts)) // 1000 + 36000000 AS at_ms FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 10 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE",
    "stream_health": "SELECT user_id, epoch_us(max(ts)) // 1000 AS last_ms, max(ts) > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 10 HOUR AS healthy FROM events GROUP BY 1",
    "stream_rate": RATE_SQL,
    "rate_windows": RATE_SQL,
    "stream_digest": "WITH d AS (SELECT *, event_id % 3 AS b FROM events), marks AS (SELECT b, (SELECT max(ts) FROM d x WHERE x.b < y.b) - INTERVAL 1 HOUR AS mark FROM (SELECT DISTINCT b FROM d) y) "
        "SELECT user_id, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour_s, count(*) AS events, count(*) FILTER (WHERE ts < mark) AS late FROM d JOIN marks USING (b) GROUP BY 1, 2",
    "stream_run_fold": "SELECT event_id // 4 AS run_id, arg_max(CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'view' THEN 'Partial' WHEN 'error' THEN 'Failed' ELSE 'Running' END, (ts, event_id)) AS status, epoch_us(max(ts)) AS last_us, count(*) AS events FROM events GROUP BY 1",
    "stream_activity_purge": sql("v_activity", "SELECT id, user_id, created_at FROM v_activity WHERE created_at >= TIMESTAMP '2024-01-17 09:00:00'"),
}
