"""State changes as merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listingspark.operators import merge, reports
from listingspark.sources import seeds

from . import duck
from .gating import EVENTS_AS_OF, ORDERS_AS_OF, instant, moment
from .joined import REFS_SQL, _refs
from .landed import SEED_CTES, seed_lines
from .views import pick, sql, view

c = F.col
SEEN_AT = 1000


def incoming(spark, sf):
    """Rows of a scan; some URLs occur twice, the later one with another title."""
    rows = view(spark, sf, "v_incoming")
    again = rows.filter("job_id % 8 = 0").withColumns({"ordinal": c("ordinal") + 1_000_000, "title": F.lit("Said twice")})
    return rows.unionByName(again).withColumns({
        "last_seen": F.lit(SEEN_AT).cast("bigint"), "lifecycle": F.lit("Active"), "archived": F.lit(False), "discovered_at": F.lit(SEEN_AT).cast("bigint"),
    })


def merge_listings(spark, sf):
    return merge.merge_listings(view(spark, sf, "v_stored"), incoming(spark, sf))


def merge_refs(spark, sf):
    rows = incoming(spark, sf).withColumns({"active": F.lit(True), "job_id": c("job_id") + 5})
    return merge.merge_refs(_refs(spark, sf), rows)


def verdicts(spark, sf):
    return view(spark, sf, "supplier").selectExpr("s_suppkey AS source_id", "s_suppkey % 3 <> 0 AS may_retire")


def _retired(spark, sf):
    return merge.retire_missing(_refs(spark, sf), view(spark, sf, "v_incoming").select("source_id", "external_id"), verdicts(spark, sf))


def retire_missing(spark, sf):
    return _retired(spark, sf).select("source_id", "external_id", "active", "retired")


def apply_removals(spark, sf):
    return merge.apply_removals(view(spark, sf, "v_listings"), _retired(spark, sf)).select("job_id", "lifecycle")


RETIRED_SQL = (
    "after_scan AS (SELECT r.*, r.active AND coalesce(s_suppkey % 3 <> 0, false) AND i.external_id IS NULL AS retired FROM refs r LEFT JOIN supplier ON s_suppkey = r.source_id "
    "LEFT JOIN (SELECT DISTINCT source_id, external_id FROM v_incoming) i ON i.source_id = r.source_id AND i.external_id = r.external_id)"
)


def merge_matches(spark, sf):
    rows = view(spark, sf, "v_matches").select("user_id", "job_id", "score", "evaluated_at")
    current = rows.filter("job_id % 3 <> 0")
    fresh = rows.filter("job_id % 2 = 0").withColumn("score", (c("score") + 7) % 101)
    older = rows.filter("job_id % 4 = 0").withColumns({"evaluated_at": c("evaluated_at") - F.expr("INTERVAL 1 DAY"), "score": F.lit(1)})
    return merge.merge_matches(current, fresh.unionByName(older)).withColumn("score", c("score").cast("bigint"))


def vector_cache(spark, sf):
    docs = view(spark, sf, "documents")
    cached = docs.filter("doc_id % 3 <> 0").select(c("doc_id").alias("owner_id"), F.lit("m1").alias("model"), F.sha2("text", 256).alias("content_hash"))
    wanted = docs.select(
        c("doc_id").alias("owner_id"), F.when(c("doc_id") % 7 == 0, "m2").otherwise("m1").alias("model"),
        F.sha2(F.expr("CASE WHEN doc_id % 10 = 0 THEN concat(text, ' v2') ELSE text END"), 256).alias("content_hash"),
    )
    return merge.vector_cache(cached, wanted).select("owner_id", "model", "action")


def insert_alerts(spark, sf):
    drafts = reports.alert_drafts(view(spark, sf, "v_matches"), view(spark, sf, "v_listings"), view(spark, sf, "v_prefs"))
    new = merge.insert_alerts(view(spark, sf, "v_alerts"), drafts)
    return new.select("user_id", "job_id", "title", "dedupe_key", c("score").cast("bigint").alias("score"))


def insert_listing_once(spark, sf):
    rows = merge.insert_listing_once(view(spark, sf, "v_stored"), incoming(spark, sf))
    return rows.select("owner_id", "canonical_hash", "ordinal", "outcome")


def apply_status(spark, sf):
    changes = view(spark, sf, "v_status_log").withColumns({"user_id": c("user_id") % 20, "job_id": c("id") % 900})
    return merge.apply_status(view(spark, sf, "v_saved"), changes).select("user_id", "job_id", "status", "updated_at", "outcome")


def apply_archive(spark, sf):
    listings = view(spark, sf, "v_listings").select("job_id", F.when(c("archived"), moment("2024-01-01 00:00:00")).alias("archived_at"))
    actions = view(spark, sf, "events").selectExpr("event_id % 1500 AS job_id", "event_id % 2 = 0 AS archived", "ts AS at", "event_id AS id")
    return merge.apply_archive(listings, actions)


def import_candidates(spark, sf):
    stored = view(spark, sf, "customer").selectExpr("c_custkey % 3 AS user_id", "concat('site', c_custkey % 150, CASE WHEN c_custkey % 2 = 0 THEN '.com' ELSE '.org' END) AS domain")
    lines = seeds.import_seeds(seed_lines(spark, sf)).withColumn("user_id", F.substr(c("list_id"), F.lit(5)).cast("bigint"))
    rows = merge.import_candidates(stored, lines)
    return rows.select("user_id", c("line").cast("bigint").alias("line"), "domain", "result")


def purge(spark, sf):
    alerts = merge.purge(view(spark, sf, "v_alerts"), merge.alert_expired(moment(ORDERS_AS_OF))).select(F.lit("alerts").alias("table_name"), c("alert_id").alias("id"))
    activity = merge.purge(view(spark, sf, "v_activity"), merge.activity_expired(moment(EVENTS_AS_OF))).select(F.lit("activity").alias("table_name"), "id")
    return alerts.unionByName(activity)


def mark_read(spark, sf):
    alerts = view(spark, sf, "v_alerts")
    requests = alerts.filter("alert_id % 7 = 0").selectExpr("user_id", "CASE WHEN user_id % 4 = 0 THEN NULL ELSE alert_id END AS alert_id")
    return merge.mark_read(alerts, requests, moment(ORDERS_AS_OF)).select("alert_id", "user_id", "is_read", "marked")


RESULTS = pick("Resolved|Failed|Blocked", "c_custkey")


def candidate_transitions(spark, sf):
    results = view(spark, sf, "customer").filter("c_custkey % 5 <> 0").selectExpr("c_custkey AS candidate_id", "CAST(c_custkey % 3 AS INT) AS attempts", f"{RESULTS} AS status")
    late = results.filter("candidate_id % 2 = 0").withColumns({"attempts": F.expr("attempts - 1"), "status": F.lit("Failed")})
    results = results.unionByName(late).unionByName(results.filter("candidate_id % 4 = 0"))
    rows = merge.candidate_transitions(view(spark, sf, "v_candidates"), results)
    return rows.withColumn("attempts", c("attempts").cast("bigint"))


def candidate_claims(spark, sf):
    rows = merge.claim_candidates(view(spark, sf, "v_candidates"), instant(EVENTS_AS_OF))
    return rows.select("candidate_id", "status", c("attempts").cast("bigint").alias("attempts"), "claimed")


def candidate_retries(spark, sf):
    requests = view(spark, sf, "customer").selectExpr("c_custkey AS candidate_id", "c_custkey % 21 AS user_id")
    return merge.retry_candidates(view(spark, sf, "v_candidates"), requests).select("candidate_id", "user_id", "outcome")


def merge_sources(spark, sf):
    current = view(spark, sf, "v_sources").withColumn("identity", F.concat(c("provider"), F.lit(":board"), c("source_id")))
    provider = pick("Greenhouse|Lever|Jobicy|Remotive|Ashby|JSON-LD|Workable|TheMuse", "c_custkey")
    resolved = view(spark, sf, "customer").selectExpr(
        "c_custkey + 100000 AS source_id", "c_custkey % 20 AS owner_id", f"concat({provider}, ':board', c_custkey) AS identity", f"{provider} AS provider",
        "concat('moved', c_custkey) AS board", "concat('https://new', c_custkey, '.example.com') AS source_url", "c_name AS company", "'Every 4 hours' AS schedule", "true AS enabled",
    )
    return merge.merge_sources(current, resolved)


def _patterns(spark, sf):
    stored = view(spark, sf, "supplier").selectExpr(
        "s_suppkey AS source_id", "concat('https://old', s_suppkey, '/') AS url_template", "'/items' AS jobs_path", "CAST(s_suppkey % 5 AS BIGINT) AS failures",
        "CASE WHEN s_suppkey % 2 = 0 THEN CAST('2023-12-01 00:00:00' AS TIMESTAMP_NTZ) END AS verified_at",
    )
    found = view(spark, sf, "supplier").filter("s_suppkey % 3 = 0").selectExpr(
        "s_suppkey * 2 AS source_id", "concat('https://new', s_suppkey, '/') AS url_template", "'/jobs' AS jobs_path", "CAST(0 AS BIGINT) AS failures", "CAST(NULL AS TIMESTAMP_NTZ) AS verified_at",
    )
    return stored, found


def merge_patterns(spark, sf):
    stored, found = _patterns(spark, sf)
    return merge.merge_patterns(stored, found, merge.pattern_scans(view(spark, sf, "v_runs")))


def advance_schedule(spark, sf):
    rows = merge.advance_schedule(view(spark, sf, "v_sources"), instant(EVENTS_AS_OF), limit=25)
    return rows.select("source_id", "claimed", F.unix_seconds("next_run_at").alias("next_s"))


def run_events(spark, sf):
    return view(spark, sf, "events").selectExpr(
        "event_id DIV 4 AS run_id", "event_id AS seq", "ts AS at",
        "CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'view' THEN 'Partial' WHEN 'error' THEN 'Failed' ELSE 'Running' END AS status",
    )


def fold_runs(spark, sf):
    return merge.fold_runs(run_events(spark, sf)).select("run_id", "status", "events", "duration_ms")


def cascade_disable(spark, sf):
    candidates = view(spark, sf, "v_candidates")
    left, watch, sources = merge.cascade_disable(candidates, view(spark, sf, "v_watchlist"), view(spark, sf, "v_sources"), candidates.filter("candidate_id % 6 = 1").select("candidate_id"))
    none = F.lit(None).cast("string")
    parts = [
        left.select(F.lit("candidate").alias("kind"), c("candidate_id").alias("id"), none.alias("state")),
        watch.select(F.lit("watch").alias("kind"), c("watch_id").alias("id"), none.alias("state")),
        sources.select(F.lit("source").alias("kind"), c("source_id").alias("id"), F.concat_ws("/", c("enabled").cast("string"), "schedule").alias("state")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fold_state(spark, sf):
    rows = view(spark, sf, "events").selectExpr("concat('k', user_id) AS key", "concat(event_type, event_id) AS value", "date_trunc('hour', ts) AS updated_at", "event_id AS seq")
    return merge.fold_state(rows)


QUERIES = {f.__name__: f for f in (
    merge_listings, merge_refs, retire_missing, apply_removals, merge_matches, vector_cache, insert_alerts, insert_listing_once, apply_status, apply_archive,
    import_candidates, purge, mark_read, candidate_transitions, candidate_claims, candidate_retries, merge_sources, merge_patterns, advance_schedule,
    fold_runs, cascade_disable, fold_state,
)}

INC = "inc AS (SELECT *, title AS t FROM v_incoming), last_inc AS (SELECT owner_id, canonical_hash, job_id, description_hash, CASE WHEN job_id % 8 = 0 THEN 'Said twice' ELSE t END AS title FROM inc)"

ORACLE = {
    "merge_listings": sql("v_stored v_incoming",
        "SELECT owner_id, canonical_hash, CASE WHEN o IN ('added','updated') THEN it ELSE st END AS title, CASE WHEN o IN ('added','updated') THEN ih ELSE sh END AS description_hash, CASE WHEN o = 'missing' THEN sl ELSE CAST(1000 AS BIGINT) END AS last_seen, "
        "CASE WHEN o = 'missing' THEN lc ELSE 'Active' END AS lifecycle, CASE WHEN o = 'added' THEN ij ELSE sj END AS job_id, CASE WHEN o = 'added' THEN false ELSE ar END AS archived, CASE WHEN o = 'added' THEN 1000 ELSE ds END AS discovered_at, o AS outcome FROM ("
        "SELECT owner_id, canonical_hash, s.title AS st, i.title AS it, s.description_hash AS sh, i.description_hash AS ih, s.last_seen AS sl, s.lifecycle AS lc, s.job_id AS sj, i.job_id AS ij, s.archived AS ar, s.discovered_at AS ds, "
        "CASE WHEN i.job_id IS NULL THEN 'missing' WHEN s.job_id IS NULL THEN 'added' WHEN s.description_hash <> i.description_hash THEN 'updated' ELSE 'unchanged' END AS o FROM v_stored s FULL OUTER JOIN last_inc i USING (owner_id, canonical_hash))", INC),
    "merge_refs": sql("v_refs v_refs_more v_incoming", "SELECT source_id, external_id, CASE WHEN i.external_id IS NULL THEN r.job_id ELSE i.j END AS job_id, CASE WHEN i.j IS NULL THEN r.active ELSE true END AS active, CASE WHEN i.j IS NULL THEN r.last_seen ELSE CAST(1000 AS BIGINT) END AS last_seen, "
        "CASE WHEN i.j IS NULL THEN 'missing' WHEN r.job_id IS NULL THEN 'added' ELSE 'updated' END AS outcome FROM refs r FULL OUTER JOIN (SELECT source_id, external_id, job_id + 5 AS j FROM v_incoming) i USING (source_id, external_id)", REFS_SQL),
    "retire_missing": sql("v_refs v_refs_more v_incoming", "SELECT source_id, external_id, active AND NOT retired AS active, retired FROM after_scan", REFS_SQL, RETIRED_SQL),
    "apply_removals": sql("v_listings v_refs v_refs_more v_incoming", "SELECT l.job_id, CASE WHEN g.job_id IS NOT NULL THEN 'Removed' ELSE lifecycle END AS lifecycle FROM v_listings l LEFT JOIN (SELECT job_id FROM after_scan GROUP BY 1 HAVING bool_or(retired) AND count(*) FILTER (WHERE active AND NOT retired) = 0) g ON g.job_id = l.job_id", REFS_SQL, RETIRED_SQL),
    "merge_matches": sql("v_matches", "SELECT user_id, job_id, CAST(CASE WHEN job_id % 2 = 0 THEN (score + 7) % 101 ELSE score END AS BIGINT) AS score, evaluated_at, CASE WHEN job_id % 2 <> 0 THEN 'missing' WHEN job_id % 3 = 0 THEN 'added' ELSE 'updated' END AS outcome FROM v_matches WHERE job_id % 3 <> 0 OR job_id % 2 = 0"),
    "vector_cache": "SELECT doc_id AS owner_id, CASE WHEN doc_id % 7 = 0 THEN 'm2' ELSE 'm1' END AS model, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 10 <> 0 THEN 'reuse' ELSE 'compute' END AS action FROM documents",
    "insert_alerts": sql("v_matches v_listings v_prefs v_alerts", f"SELECT user_id, job_id, title, dedupe_key, score FROM (SELECT m.user_id, m.job_id, concat({duck.band('score')}, ': ', title) AS title, concat('match:', m.job_id, ':', score, ':', epoch_ms(evaluated_at)) AS dedupe_key, CAST(score AS BIGINT) AS score, "
        "row_number() OVER (PARTITION BY m.user_id ORDER BY evaluated_at DESC, m.job_id) AS n FROM v_matches m JOIN v_listings l ON l.job_id = m.job_id JOIN v_prefs p ON p.user_id = m.user_id WHERE NOT archived AND notifications_enabled AND score >= notify_min) d "
        "WHERE NOT EXISTS (SELECT 1 FROM v_alerts a WHERE a.user_id = d.user_id AND a.dedupe_key = d.dedupe_key)"),
    "insert_listing_once": sql("v_stored v_incoming", "SELECT i.owner_id, i.canonical_hash, o AS ordinal, CASE WHEN s.job_id IS NULL AND o < 1000000 THEN 'added' ELSE 'This opportunity has already been added.' END AS outcome FROM (SELECT *, ordinal AS o FROM v_incoming UNION ALL SELECT *, ordinal + 1000000 FROM v_incoming WHERE job_id % 8 = 0) i "
        "LEFT JOIN v_stored s ON s.owner_id = i.owner_id AND s.canonical_hash = i.canonical_hash"),
    "apply_status": sql("v_saved v_status_log", "SELECT user_id, job_id, coalesce(n.status, s.status) AS status, coalesce(n.created_at, s.updated_at) AS updated_at, CASE WHEN n.status IS NULL THEN 'missing' WHEN s.status IS NULL THEN 'added' ELSE 'updated' END AS outcome FROM v_saved s "
        "FULL OUTER JOIN (SELECT user_id % 20 AS user_id, id % 900 AS job_id, status, created_at FROM v_status_log QUALIFY row_number() OVER (PARTITION BY user_id % 20, id % 900 ORDER BY created_at DESC, id DESC) = 1) n USING (user_id, job_id)"),
    "apply_archive": sql("v_listings", "SELECT l.job_id, CASE WHEN a.job_id IS NULL THEN CASE WHEN archived THEN TIMESTAMP '2024-01-01 00:00:00' END WHEN a.on THEN a.ts END AS archived_at FROM v_listings l LEFT JOIN ("
        "SELECT event_id % 1500 AS job_id, event_id % 2 = 0 AS \"on\", ts FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 1500 ORDER BY ts DESC, event_id DESC) = 1) a ON a.job_id = l.job_id".replace("a.on ", 'a."on" ')),
    "import_candidates": sql("", "SELECT u AS user_id, p.line, p.domain, CASE WHEN p.domain IS NULL OR NOT p.line = t.taken OR t.taken IS NULL THEN 'rejected' WHEN k.domain IS NOT NULL THEN 'duplicate' ELSE 'imported' END AS result FROM (SELECT *, CAST(substr(list_id, 5) AS BIGINT) AS u FROM p) p "
        "LEFT JOIN t ON t.list_id = p.list_id AND t.domain = p.domain LEFT JOIN (SELECT DISTINCT c_custkey % 3 AS user_id, concat('site', c_custkey % 150, CASE WHEN c_custkey % 2 = 0 THEN '.com' ELSE '.org' END) AS domain FROM customer) k ON k.user_id = u AND k.domain = p.domain", *SEED_CTES),
    "purge": sql("v_alerts v_activity", f"SELECT 'alerts' AS table_name, alert_id AS id FROM v_alerts WHERE NOT (is_read AND created_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY) UNION ALL SELECT 'activity', id FROM v_activity WHERE NOT created_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY"),
    "mark_read": sql("v_alerts", "SELECT alert_id, user_id, is_read OR m AS is_read, NOT is_read AND m AS marked FROM (SELECT *, CASE WHEN user_id % 4 = 0 THEN EXISTS (SELECT 1 FROM v_alerts b WHERE b.user_id = a.user_id AND b.alert_id % 7 = 0) ELSE alert_id % 7 = 0 END AS m FROM v_alerts a)"),
    "candidate_transitions": sql("v_candidates", f"SELECT candidate_id, CAST(attempts AS BIGINT) AS attempts, CASE WHEN e = 'applied' THEN {RESULTS.replace('c_custkey', 'candidate_id')} WHEN e = 'late' THEN 'Failed' ELSE status END AS status, replace(e, 'late', 'applied') AS effect FROM (SELECT *, CASE WHEN candidate_id % 5 = 0 THEN 'none' WHEN status = 'Resolving' AND attempts = candidate_id % 3 THEN 'applied' WHEN status = 'Resolving' AND candidate_id % 2 = 0 AND attempts = candidate_id % 3 - 1 THEN 'late' ELSE 'fenced' END AS e FROM v_candidates)"),
    "candidate_claims": sql("v_candidates", f"SELECT candidate_id, CASE WHEN d THEN 'Resolving' ELSE status END AS status, CAST(attempts + CASE WHEN d THEN 1 ELSE 0 END AS BIGINT) AS attempts, d AS claimed FROM (SELECT *, status = 'Pending' OR (status = 'Resolving' AND last_checked_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 15 MINUTE) AS d FROM v_candidates)"),
    "candidate_retries": sql("v_candidates", "SELECT c_custkey AS candidate_id, c_custkey % 21 AS user_id, CASE WHEN status IN ('Resolved','Failed','Blocked','Unsupported','NoCareersPage') THEN 'Pending' ELSE 'refused' END AS outcome FROM customer LEFT JOIN v_candidates v ON v.candidate_id = c_custkey AND v.user_id = c_custkey % 21"),
    "merge_sources": sql("v_sources", "SELECT owner_id, identity, coalesce(r.provider, s.provider) AS provider, coalesce(r.board, s.board) AS board, CASE WHEN r.identity2 IS NOT NULL THEN r.source_url ELSE s.source_url END AS source_url, coalesce(s.source_id, r.source_id) AS source_id, coalesce(s.company, r.company) AS company, coalesce(s.schedule, 'Every 4 hours') AS schedule, coalesce(s.enabled, true) AS enabled, "
        "CASE WHEN r.identity2 IS NULL THEN 'missing' WHEN s.source_id IS NULL THEN 'added' ELSE 'updated' END AS outcome FROM (SELECT *, concat(provider, ':board', source_id) AS identity FROM v_sources) s FULL OUTER JOIN ("
        f"SELECT c_custkey + 100000 AS source_id, c_custkey % 20 AS owner_id, provider, concat(provider, ':board', c_custkey) AS identity, concat(provider, ':board', c_custkey) AS identity2, concat('moved', c_custkey) AS board, concat('https://new', c_custkey, '.example.com') AS source_url, c_name AS company FROM (SELECT *, {pick('Greenhouse|Lever|Jobicy|Remotive|Ashby|JSON-LD|Workable|TheMuse', 'c_custkey')} AS provider FROM customer)) r USING (owner_id, identity)"),
    "merge_patterns": sql("v_runs", "SELECT source_id, url_template, jobs_path, CASE WHEN ok IS NOT NULL THEN bad ELSE failures + coalesce(bad, 0) END AS failures, coalesce(ok, verified_at) AS verified_at, outcome FROM ("
        "SELECT source_id, CASE WHEN n.source_id IS NOT NULL THEN n.url_template ELSE o.url_template END AS url_template, CASE WHEN n.source_id IS NOT NULL THEN '/jobs' ELSE '/items' END AS jobs_path, CASE WHEN n.source_id IS NOT NULL THEN 0 ELSE o.failures END AS failures, CASE WHEN n.source_id IS NULL THEN o.verified_at END AS verified_at, "
        "CASE WHEN n.source_id IS NULL THEN 'missing' WHEN o.source_id IS NULL THEN 'added' ELSE 'updated' END AS outcome FROM (SELECT s_suppkey AS source_id, concat('https://old', s_suppkey, '/') AS url_template, s_suppkey % 5 AS failures, CASE WHEN s_suppkey % 2 = 0 THEN TIMESTAMP '2023-12-01 00:00:00' END AS verified_at FROM supplier) o "
        "FULL OUTER JOIN (SELECT s_suppkey * 2 AS source_id, concat('https://new', s_suppkey, '/') AS url_template FROM supplier WHERE s_suppkey % 3 = 0) n USING (source_id)) LEFT JOIN ("
        "SELECT source_id, ok, count(*) FILTER (WHERE status = 'Failed' AND (ok IS NULL OR started_at > ok)) AS bad FROM (SELECT *, max(CASE WHEN status = 'Succeeded' THEN started_at END) OVER (PARTITION BY source_id) AS ok FROM v_runs) GROUP BY 1, 2) USING (source_id)"),
    "advance_schedule": sql("v_sources", f"SELECT source_id, coalesce(d, false) AS claimed, CAST(CASE WHEN d THEN CASE schedule WHEN 'Hourly' THEN 1706662800 WHEN 'Every 4 hours' THEN 1706673600 WHEN 'Twice daily' THEN 1706702400 ELSE 1706745600 END ELSE epoch(next_run_at) END AS BIGINT) AS next_s FROM v_sources LEFT JOIN ("
        f"SELECT source_id, true AS d FROM v_sources WHERE enabled AND schedule <> 'Manual' AND owner_id IS NOT NULL AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{EVENTS_AS_OF}') ORDER BY next_run_at ASC NULLS LAST, source_id LIMIT 25) USING (source_id)"),
    "fold_runs": "SELECT run_id, status, events, CASE WHEN status <> 'Running' THEN last_ms - first_ms END AS duration_ms FROM (SELECT event_id // 4 AS run_id, arg_max(CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'view' THEN 'Partial' WHEN 'error' THEN 'Failed' ELSE 'Running' END, (ts, event_id)) AS status, count(*) AS events, "
        "epoch_us(min(ts)) // 1000 AS first_ms, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1)",
    "cascade_disable": sql("v_candidates v_watchlist v_sources", "SELECT 'candidate' AS kind, candidate_id AS id, CAST(NULL AS VARCHAR) AS state FROM v_candidates WHERE candidate_id % 6 <> 1 UNION ALL SELECT 'watch', watch_id, NULL FROM v_watchlist w WHERE NOT EXISTS (SELECT 1 FROM v_candidates c WHERE candidate_id % 6 = 1 AND c.watch_id = w.watch_id AND c.user_id = w.user_id) "
        "UNION ALL SELECT 'source', source_id, CASE WHEN off THEN 'false/Manual' ELSE concat(CASE WHEN enabled THEN 'true' ELSE 'false' END, '/', schedule) END FROM (SELECT *, EXISTS (SELECT 1 FROM v_candidates c WHERE candidate_id % 6 = 1 AND c.source_id = s.source_id AND c.user_id = s.owner_id) AS off FROM v_sources s)"),
    "fold_state": "SELECT concat('k', user_id) AS key, arg_max(concat(event_type, event_id), (date_trunc('hour', ts), event_id)) AS value, max(date_trunc('hour', ts)) AS updated_at FROM events GROUP BY 1",
}
