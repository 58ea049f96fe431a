"""Aggregations, scores, window logic, paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listingspark.operators import contracts, links as link_ops, merge, reports, robots, scoring
from listingspark.plans import board, evaluate
from listingspark.sources import bronze

from . import duck
from .gating import BLOCKED, EVENTS_AS_OF, LISTINGS_AS_OF, ORDERS_AS_OF, USER, BOARD_JOIN_SQL, coverage_ctes, instant, moment, preferences
from .joined import EVAL_SQL, MATCHES_SQL, REFS_SQL, _changed, _matches, _refs, page_paths, robots_files
from .landed import seed_lines
from .views import sql, view

c = F.col


def board_page(spark, sf):
    """Flagship: one person's board page by score, with the filtered total."""
    page = board.board(
        spark, view(spark, sf, "v_listings"), view(spark, sf, "v_matches"), view(spark, sf, "v_saved"), USER,
        page=1, countries=["GB", "DE", "CA", "US"], unknown=True,
    )
    return page.select("job_id", "title", "company", c("score").cast("bigint").alias("score"), "status", "total", "has_more")


BOARD_OK = "(list_has_any(coalesce(codes, []), ['GB','DE','CA','US']) OR len(coalesce(codes, [])) = 0)"


def page_with_total(spark, sf):
    """A page past the end: no rows, but the total is known."""
    rows = board.board_rows(spark, view(spark, sf, "v_listings"), view(spark, sf, "v_matches"), view(spark, sf, "v_saved"), USER)
    near, far = reports.page_total(rows, 2), reports.page_total(rows, 99_999)
    return near.unionByName(far)


def factor_scores(spark, sf):
    rows = view(spark, sf, "v_factors").withColumn("similarity", F.lit(None).cast("double"))
    scored = evaluate.score_rows(rows, view(spark, sf, "v_prefs"))
    return scored.select("row_id", "part_key", "problem", *[c(n).cast("bigint").alias(n) for n in ("overall_score", "qualification_score", "interest_score")])


_FACTORS_OK = " AND ".join(f"{f} BETWEEN 0 AND 1 AND NOT isnan({f})" for f in contracts.FACTORS)


def _score_sql(names, role: str = "role") -> str:
    total = " + ".join(f"w_{n}" for n in names)
    earned = " + ".join(f"({role if n == 'role' else n}) * w_{n}" for n in names)
    return f"CASE WHEN problem IS NULL AND {total} <> 0 THEN CAST(floor(({earned}) / ({total}) * 100 + 0.5) AS BIGINT) END"


_PROBLEM = f"CASE WHEN abs({' + '.join('w_' + f for f in contracts.FACTORS)} - 100) >= 0.001 THEN 'weight_total' WHEN NOT ({_FACTORS_OK}) THEN 'factor_range' END"
_W = ", ".join(f"w_{f}" for f in contracts.FACTORS)


def scores_sql(role: str, source: str) -> str:
    return sql(
        "v_factors v_prefs v_vectors" if "sims" in source else "v_factors v_prefs",
        f"SELECT row_id, part_key, problem, {_score_sql(contracts.FACTORS, role)} AS overall_score, {_score_sql(contracts.QUALIFICATION, role)} AS qualification_score, {_score_sql(contracts.INTEREST, role)} AS interest_score FROM j",
        *([SIMS] if "sims" in source else []),
        f"j AS (SELECT f.*, {_W}, {_PROBLEM} AS problem{', similarity' if 'sims' in source else ''} FROM {source} JOIN (SELECT user_id, {_W} FROM v_prefs) p ON p.user_id = f.user_id)",
    )


def targets(spark, sf):
    """One target vector per person: the lowest id of the person's vectors."""
    return view(spark, sf, "v_vectors").groupBy("user_id").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def cosine(spark, sf):
    rows = scoring.similar_listings(targets(spark, sf), view(spark, sf, "v_vectors"))
    return rows.select("user_id", "vec_id", F.round("similarity", 6).alias("similarity"))


SIMS = (
    "t AS (SELECT user_id, arg_min(embedding, vec_id) AS target FROM v_vectors GROUP BY user_id), "
    "sims AS (SELECT v.user_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(target AS DOUBLE[])) AS similarity FROM v_vectors v JOIN t ON t.user_id = v.user_id)"
)


def role_blend(spark, sf):
    """Factor rows with the similarity of the listing vector of the same number."""
    sims = scoring.similar_listings(targets(spark, sf), view(spark, sf, "v_vectors")).select(c("vec_id").alias("part_key"), "similarity")
    factors = view(spark, sf, "v_factors")
    scored = evaluate.score_rows(factors.join(sims, "part_key", "left"), view(spark, sf, "v_prefs"), counted=factors)
    return scored.select("row_id", "part_key", "problem", *[c(n).cast("bigint").alias(n) for n in ("overall_score", "qualification_score", "interest_score")])


def dashboard(spark, sf):
    rows = view(spark, sf, "v_listings").filter(c("owner_id").isNull() | (c("owner_id") == USER))
    return reports.dashboard(rows, instant(LISTINGS_AS_OF))


def pipeline_counts(spark, sf):
    return reports.pipeline_counts(view(spark, sf, "v_saved"), view(spark, sf, "v_listings"))


HOURS = 24 * 365 * 3


def _digest_items(spark, sf):
    since = moment("2000-01-01 00:00:00")
    return reports.digest_items(reports.scored_join(view(spark, sf, "v_matches"), view(spark, sf, "v_listings")), since)


def digest_counts(spark, sf):
    return reports.digest_counts(_digest_items(spark, sf), view(spark, sf, "v_prefs"))


ITEMS_SQL = (
    "items AS (SELECT m.user_id, m.job_id, m.score, l.title, l.company, row_number() OVER (PARTITION BY m.user_id ORDER BY m.score DESC, m.job_id) AS n FROM v_matches m "
    "JOIN v_listings l ON l.job_id = m.job_id WHERE NOT archived AND m.evaluated_at >= TIMESTAMP '{since}')"
)
COUNTS = (
    "count(*) FILTER (WHERE score >= notify_min) AS excellent, count(*) FILTER (WHERE score >= digest_min AND score < notify_min) AS strong, "
    "count(*) FILTER (WHERE score >= 65 AND score < digest_min) AS possible, count(*) FILTER (WHERE score >= 90) AS high_priority"
)


def digest_due(spark, sf):
    """Whose digest hour has come."""
    return reports.digest_due(view(spark, sf, "v_prefs"), moment("2001-08-02 16:20:00"))


def digest_text(spark, sf):
    """Digests of all people."""
    listings = view(spark, sf, "v_listings").withColumn("discovered_at", F.expr("timestamp_seconds(996624000 + (job_id * 37 % 1000) * 86)"))
    return reports.digests(
        view(spark, sf, "v_prefs"), listings, view(spark, sf, "v_matches"), view(spark, sf, "v_saved"), instant(ORDERS_AS_OF), 720,
    ).select("user_id", c("new_jobs").cast("bigint").alias("new_jobs"), F.sha2("body", 256).alias("body_hash"), F.length("body").cast("bigint").alias("n_chars"))


LINE = f"concat('• ', title, ' — ', company, ' (', score, ', ', {duck.band('score')}, ')')"
ACTIVE = "('Preparing Application','Applied','Interviewing','Offer')"
DIGEST_SQL = sql(
    "v_prefs v_listings v_matches v_saved",
    "SELECT user_id, new_jobs, sha256(body) AS body_hash, length(body) AS n_chars FROM ("
    "SELECT user_id, new_jobs, concat_ws(chr(10), concat_ws(' ', concat(new_jobs, ' ', CASE WHEN new_jobs = 1 THEN 'opportunity' ELSE 'opportunities' END, ' discovered in the last 720 hours.'), "
    "CASE WHEN high_priority > 0 OR strong > 0 OR possible > 0 THEN concat(high_priority, ' high-priority, ', strong, ' strong and ', possible, ' possible matches were evaluated.') ELSE 'No evaluated opportunity reached your digest threshold yet.' END, "
    "CASE WHEN apps > 0 THEN concat(apps, ' ', CASE WHEN apps = 1 THEN 'application needs' ELSE 'applications need' END, ' your attention.') END), top) AS body FROM ("
    "SELECT p.user_id, coalesce(excellent, 0) AS excellent, coalesce(strong, 0) AS strong, coalesce(possible, 0) AS possible, coalesce(high_priority, 0) AS high_priority, coalesce(apps, 0) AS apps, top, "
    "coalesce(own, 0) + (SELECT count(*) FROM fresh WHERE owner_id IS NULL) AS new_jobs FROM v_prefs p LEFT JOIN counts c ON c.user_id = p.user_id LEFT JOIN tops t ON t.user_id = p.user_id "
    "LEFT JOIN pend a ON a.user_id = p.user_id LEFT JOIN (SELECT owner_id, count(*) AS own FROM fresh WHERE owner_id IS NOT NULL GROUP BY 1) o ON o.owner_id = p.user_id))",
    ITEMS_SQL.format(since="2001-07-03 00:00:00"),
    f"counts AS (SELECT i.user_id, {COUNTS} FROM items i JOIN v_prefs p ON p.user_id = i.user_id GROUP BY 1)",
    f"tops AS (SELECT user_id, string_agg(line, chr(10) ORDER BY n) AS top FROM (SELECT i.user_id, i.n, {LINE} AS line, row_number() OVER (PARTITION BY i.user_id ORDER BY n) AS r FROM items i JOIN v_prefs p ON p.user_id = i.user_id WHERE score >= digest_min) WHERE r <= 5 GROUP BY 1)",
    f"pend AS (SELECT s.user_id, count(*) AS apps FROM v_saved s JOIN v_listings l ON l.job_id = s.job_id WHERE NOT archived AND status IN {ACTIVE} GROUP BY 1)",
    "fresh AS (SELECT * FROM v_listings WHERE NOT archived AND 996624000 + (job_id * 37 % 1000) * 86 >= epoch(TIMESTAMP '2001-07-03 00:00:00'))",
)


def month_spend(spark, sf):
    spend = reports.month_spend(view(spark, sf, "v_matches"), moment("2001-07-20 00:00:00"))
    return reports.budget_state(view(spark, sf, "v_prefs"), spend, 3000)


def discovery_spend(spark, sf):
    calls = view(spark, sf, "v_activity").filter(c("user_id").isNotNull() & c("stage").isin("purchase", "error", "view"))
    outcome = F.when(c("stage") == "error", "failed").otherwise("ok")
    settled = calls.withColumn("cost_micros", reports.settled_cost(outcome, c("cost_micros")))
    spend = reports.month_spend(settled, moment(EVENTS_AS_OF), "created_at")
    return reports.budget_state(view(spark, sf, "v_prefs"), spend, reports.DISCOVERY_RESERVE)


def unread(spark, sf):
    return reports.unread(view(spark, sf, "v_alerts"))


def _classified(spark, sf):
    """Outcome rows as a scan classifies them."""
    return view(spark, sf, "events").selectExpr(
        "event_id % 200 AS run_id", "CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'updated' WHEN 'purchase' THEN 'unchanged' WHEN 'signup' THEN 'filtered' ELSE 'removed' END AS outcome",
        "event_id AS seq", "concat('listing ', event_id, ': could not read posting') AS message",
    )


def run_counters(spark, sf):
    return reports.run_counters(_classified(spark, sf))


def run_warnings(spark, sf):
    rows = view(spark, sf, "events").selectExpr("event_id % 20 AS run_id", "event_id AS seq", "concat('listing ', event_id, ': could not read posting') AS message", "event_type")
    filtered = rows.groupBy("run_id").agg(F.count_if((c("event_type") == "signup") & (c("run_id") % 3 != 0)).alias("filtered"))
    return reports.run_warnings(rows.filter(c("event_type") == "error"), filtered).withColumn("n", c("n").cast("bigint"))


def live_refs(spark, sf):
    return merge.live_refs(_refs(spark, sf)).select("job_id", "live")


def purge_counts(spark, sf):
    return reports.purge_counts(
        view(spark, sf, "v_alerts"), view(spark, sf, "v_activity"),
        merge.alert_expired(moment(ORDERS_AS_OF)), merge.activity_expired(moment(EVENTS_AS_OF)),
    )


def schedule_summary(spark, sf):
    return reports.schedule_summary(view(spark, sf, "v_sources"), view(spark, sf, "v_candidates"))


def vector_topk(spark, sf):
    rows = scoring.vector_topk(targets(spark, sf), view(spark, sf, "v_vectors"), 10)
    return rows.select("user_id", "vec_id", F.round("similarity", 6).alias("similarity"), c("rank").cast("bigint").alias("rank"))


def latest_per_source(spark, sf):
    return merge.last_by(view(spark, sf, "v_runs"), ["source_id"], "started_at", "run_id").select("source_id", "run_id", "status")


def eval_batch(spark, sf):
    sources = view(spark, sf, "v_sources").filter("enabled")
    rows = evaluate.eligible_batch(spark, view(spark, sf, "v_listings"), view(spark, sf, "v_refs"), sources, _matches(spark, sf), preferences(spark, sf))
    return rows.select("user_id", "job_id", c("n").cast("bigint").alias("n"))


def import_first_wins(spark, sf):
    from listingspark.sources import seeds

    rows = seeds.import_seeds(seed_lines(spark, sf), limit=500)
    return rows.groupBy("list_id", "outcome").agg(F.count("*").alias("lines"), F.min("line").cast("bigint").alias("first_line"))


CAREER_PAGES = (
    "concat(html, '<a href=\"/company/careers\">Careers</a><a href=\"https://jobs.lever.co/acme', page_id, '\">Open roles</a><a href=\"/jobs/\">We''re <b>hiring</b></a>"
    "<a class=x href=''/blog/jobs''>jobs</a><a href=\"/jobs/\">Jobs</a><a href=\"https://else.example.org/careers\">Careers</a><a href=\"/join-us?x=1\"> Join\n us </a>')"
)


def career_pages(spark, sf):
    return view(spark, sf, "pages").selectExpr("page_id", "url", f"{CAREER_PAGES} AS html")


def best_link_per_url(spark, sf):
    ranked = link_ops.rank_career_links(career_pages(spark, sf)).filter("rank = 1")
    return ranked.select("page_id", "href", c("score").cast("bigint").alias("score"))


def robots_longest(spark, sf):
    rules = robots.robots_rules(robots_files(spark, sf))
    verdicts = robots.robots_verdict(page_paths(spark, sf), rules, "PoliteBot")
    return verdicts.groupBy("matched_rule").agg(F.count("*").alias("pages"))


def status_timeline(spark, sf):
    rows = view(spark, sf, "v_status_log").withColumn("user_id", c("user_id") % 2)
    return reports.status_timeline(rows, 50).select("user_id", "job_id", "id", "status", c("n").cast("bigint").alias("n"))


def activity_page(spark, sf):
    """The second page of the feed, after the hundredth row of the first."""
    feed = view(spark, sf, "v_activity")
    first = reports.activity_page(feed, USER, 100)
    last = first.orderBy("created_at", "id").limit(1).first()
    second = reports.activity_page(feed, USER, 100, before=(last.created_at, last.id))
    return second.select("id", "user_id", "created_at")


def digest_top(spark, sf):
    rows = reports.digest_top(_digest_items(spark, sf), view(spark, sf, "v_prefs"))
    return rows.select("user_id", "job_id", c("score").cast("bigint").alias("score"), c("rank").cast("bigint").alias("rank"))


def due_sources(spark, sf):
    return merge.due_sources(view(spark, sf, "v_sources"), instant(EVENTS_AS_OF), limit=25).select("source_id", "owner_id", "schedule")


def alerts_page(spark, sf):
    rows = reports.alerts_page(view(spark, sf, "v_alerts"), view(spark, sf, "v_listings"), USER, 500)
    return rows.select("alert_id", "job_id", "job_title", "lifecycle")


def run_history(spark, sf):
    return reports.run_history(view(spark, sf, "v_runs"), view(spark, sf, "v_sources").filter(c("owner_id") == USER), 20).select("run_id", "source_id", "status")


def distinct_ids(spark, sf):
    refs = _refs(spark, sf)
    return refs.select("source_id", "job_id").distinct()


QUERIES = {f.__name__: f for f in (
    board_page, page_with_total, factor_scores, cosine, role_blend, dashboard, pipeline_counts, digest_counts, digest_due, digest_text, month_spend, discovery_spend, unread,
    run_counters, run_warnings, live_refs, purge_counts, schedule_summary, vector_topk, latest_per_source, eval_batch, import_first_wins,
    best_link_per_url, robots_longest, status_timeline, activity_page, digest_top, due_sources, alerts_page, run_history, distinct_ids,
)}

from .landed import SEED_CTES  # noqa: E402

HOST_SQL = "regexp_extract(url, '://([^/?#]*)', 1)"
PATH_SQL = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
RULES_SQL = (
    "binding AS (SELECT host, rule, allow, line FROM hosts, (VALUES ('/de/', false, 0, 1), ('/de/1', true, 1, 2), ('/*8$', false, 0, 3)) v(rule, allow, even, line) WHERE n % 3 <> 0 AND (even = 0 OR n % 2 = 0) "
    "UNION ALL SELECT host, rule, allow, line FROM hosts, (VALUES ('/fr/', false, 1), ('/fr/*5', true, 2), ('/*/2*', false, 3)) v(rule, allow, line) WHERE n % 3 = 0), "
    "matched AS (SELECT p.page_id, b.rule, b.allow, b.line FROM (SELECT page_id, {host} AS host, {path} AS path FROM pages) p JOIN binding b ON b.host = p.host WHERE CASE rule WHEN '/de/' THEN starts_with(path, '/de/') WHEN '/de/1' THEN starts_with(path, '/de/1') "
    "WHEN '/*8$' THEN path LIKE '/%8' WHEN '/fr/' THEN starts_with(path, '/fr/') WHEN '/fr/*5' THEN path LIKE '/fr/%5%' ELSE path LIKE '/%/2%' END), "
    "verdict AS (SELECT p.page_id, m.rule, coalesce(m.allow, true) AS allowed FROM pages p LEFT JOIN (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, allow DESC, line) = 1) m ON m.page_id = p.page_id)"
).replace("{host}", HOST_SQL).replace("{path}", PATH_SQL)
HOSTS_CTE = f"hosts AS (SELECT {HOST_SQL} AS host, min(page_id) AS n FROM pages GROUP BY 1)"
ACT = "act AS (SELECT * FROM v_activity WHERE user_id IS NULL OR user_id = 7)"

ORACLE = {
    "board_page": sql("v_listings v_matches v_saved", f"SELECT job_id, title, company, CAST(score AS BIGINT) AS score, status, count(*) OVER () AS total, count(*) OVER () > 50 AS has_more FROM b JOIN coverage USING (country, location) "
        f"WHERE NOT archived AND {BOARD_OK} ORDER BY score DESC NULLS LAST, discovered_at DESC, job_id LIMIT 50", *coverage_ctes(), BOARD_JOIN_SQL),
    "page_with_total": sql("v_listings v_matches v_saved", "SELECT count(*) AS total, CAST(2 AS BIGINT) AS page, 100 < count(*) AS has_more FROM b WHERE NOT archived UNION ALL SELECT count(*), 99999, 4999950 < count(*) FROM b WHERE NOT archived", BOARD_JOIN_SQL),
    "factor_scores": scores_sql("role", "v_factors f"),
    "cosine": sql("v_vectors", "SELECT user_id, vec_id, round(similarity, 6) AS similarity FROM sims", SIMS),
    "role_blend": scores_sql("CASE WHEN similarity IS NULL THEN role ELSE role * 0.6 + (similarity + 1) / 2 * 0.4 END", "v_factors f LEFT JOIN (SELECT vec_id, similarity FROM sims) s ON s.vec_id = f.part_key"),
    "dashboard": sql("v_listings", "SELECT count(*) AS total, count(*) FILTER (WHERE discovered_at >= TIMESTAMP '2024-01-25 00:00:00') AS new_today FROM v_listings WHERE NOT archived AND (owner_id IS NULL OR owner_id = 7)"),
    "pipeline_counts": sql("v_saved v_listings", f"SELECT s.user_id, count(*) FILTER (WHERE status = 'Saved') AS saved, count(*) FILTER (WHERE status IN {ACTIVE}) AS applications FROM v_saved s JOIN v_listings l ON l.job_id = s.job_id WHERE NOT archived GROUP BY 1"),
    "digest_counts": sql("v_matches v_listings v_prefs", f"SELECT i.user_id, {COUNTS} FROM items i JOIN v_prefs p ON p.user_id = i.user_id GROUP BY 1", ITEMS_SQL.format(since="2000-01-01 00:00:00")),
    "digest_due": "SELECT c_custkey AS user_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 24 = 16",
    "digest_text": DIGEST_SQL,
    "month_spend": sql("v_matches v_prefs", "SELECT p.user_id, CAST(coalesce(s, 0) AS BIGINT) AS spent, budget_micros, coalesce(s, 0) + 3000 > budget_micros AS over_budget FROM v_prefs p LEFT JOIN (SELECT user_id, sum(cost_micros) AS s FROM v_matches WHERE evaluated_at >= TIMESTAMP '2001-07-01 00:00:00' GROUP BY 1) m ON m.user_id = p.user_id"),
    "discovery_spend": sql("v_activity v_prefs", "SELECT p.user_id, CAST(coalesce(s, 0) AS BIGINT) AS spent, budget_micros, coalesce(s, 0) + 50000 > budget_micros AS over_budget FROM v_prefs p LEFT JOIN (SELECT user_id, sum(CASE stage WHEN 'error' THEN 0 WHEN 'view' THEN 50000 ELSE cost_micros END) AS s FROM v_activity WHERE user_id IS NOT NULL AND stage IN ('purchase','error','view') AND created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1) m ON m.user_id = p.user_id"),
    "unread": sql("v_alerts", "SELECT user_id, count(*) AS unread FROM v_alerts WHERE NOT is_read GROUP BY 1"),
    "run_counters": "SELECT event_id % 200 AS run_id, count(*) FILTER (WHERE event_type <> 'error') AS discovered, count(*) FILTER (WHERE event_type = 'click') AS added, count(*) FILTER (WHERE event_type = 'view') AS updated, count(*) FILTER (WHERE event_type = 'error') AS removed, count(*) FILTER (WHERE event_type = 'signup') AS filtered FROM events GROUP BY 1",
    "run_warnings": "SELECT run_id, n, message FROM (SELECT run_id, message, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM (SELECT event_id % 20 AS run_id, event_id AS seq, concat('listing ', event_id, ': could not read posting') AS message FROM events WHERE event_type = 'error' "
        "UNION ALL SELECT run_id, -1, concat(k, ' ', CASE WHEN k = 1 THEN 'listing was' ELSE 'listings were' END, ' skipped by your keyword filters.') FROM (SELECT event_id % 20 AS run_id, count(*) AS k FROM events WHERE event_type = 'signup' AND (event_id % 20) % 3 <> 0 GROUP BY 1)))",
    "live_refs": sql("v_refs v_refs_more", "SELECT job_id, count(*) FILTER (WHERE active) AS live FROM refs GROUP BY 1", REFS_SQL),
    "purge_counts": sql("v_alerts v_activity", f"SELECT 'alerts' AS table_name, count(*) FILTER (WHERE is_read AND created_at < TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY) AS expired, count(*) AS rows FROM v_alerts UNION ALL SELECT 'activity', count(*) FILTER (WHERE created_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY), count(*) FROM v_activity"),
    "schedule_summary": sql("v_sources v_candidates", "SELECT count(*) FILTER (WHERE enabled AND schedule <> 'Manual') AS scheduled, (SELECT count(*) FROM v_candidates WHERE status IN ('Pending','Resolving')) AS in_flight FROM v_sources"),
    "vector_topk": sql("v_vectors", "SELECT user_id, vec_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY similarity DESC, vec_id) AS rank FROM sims) WHERE rank <= 10", SIMS),
    "latest_per_source": sql("v_runs", "SELECT source_id, run_id, status FROM v_runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1"),
    "eval_batch": sql("v_listings v_matches v_refs v_sources v_prefs", "SELECT e.user_id, e.job_id, n FROM (SELECT l.owner_id AS user_id, l.job_id, batch_size, row_number() OVER (PARTITION BY l.owner_id ORDER BY l.discovered_at DESC, l.job_id) AS n "
        f"FROM ev l JOIN v_prefs p ON p.user_id = l.owner_id JOIN coverage cv ON cv.country = l.country AND cv.location = l.location WHERE ({BLOCKED}) IS NULL) e WHERE n <= batch_size", MATCHES_SQL, EVAL_SQL, *coverage_ctes()),
    "import_first_wins": sql("", "SELECT list_id, outcome, count(*) AS lines, min(line) AS first_line FROM (SELECT p.list_id, p.line, CASE WHEN p.domain IS NULL THEN 'No domain found' WHEN p.line = t.taken AND place <= 500 THEN 'imported' WHEN p.line > t.taken AND place <= 500 THEN 'Duplicate domain' "
        "WHEN p.line > f.taken THEN 'Import limit is 500 rows' ELSE 'Company name or domain is too long' END AS outcome FROM p LEFT JOIN t ON t.list_id = p.list_id AND t.domain = p.domain LEFT JOIN (SELECT list_id, taken FROM t WHERE place = 500) f ON f.list_id = p.list_id) GROUP BY ALL", *SEED_CTES),
    "best_link_per_url": f"SELECT page_id, concat('https://', {HOST_SQL}, '/company/careers') AS href, CAST(15 AS BIGINT) AS score FROM pages",
    "robots_longest": sql("", "SELECT CASE WHEN NOT allowed THEN concat('Disallow: ', rule) END AS matched_rule, count(*) AS pages FROM verdict GROUP BY 1", HOSTS_CTE, RULES_SQL),
    "status_timeline": sql("v_status_log", "SELECT u AS user_id, job_id, id, status, n FROM (SELECT *, user_id % 2 AS u, row_number() OVER (PARTITION BY user_id % 2, job_id ORDER BY created_at DESC, id DESC) AS n FROM v_status_log) WHERE n <= 50"),
    "activity_page": sql("v_activity", "SELECT id, user_id, created_at FROM act ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 100", ACT),
    "digest_top": sql("v_matches v_listings v_prefs", "SELECT user_id, job_id, CAST(score AS BIGINT) AS score, rank FROM (SELECT i.*, row_number() OVER (PARTITION BY i.user_id ORDER BY n) AS rank FROM items i JOIN v_prefs p ON p.user_id = i.user_id WHERE n <= 50 AND score >= digest_min) WHERE rank <= 5", ITEMS_SQL.format(since="2000-01-01 00:00:00")),
    "due_sources": sql("v_sources", f"SELECT source_id, owner_id, schedule FROM v_sources WHERE enabled AND schedule <> 'Manual' AND owner_id IS NOT NULL AND (next_run_at IS NULL OR next_run_at <= TIMESTAMP '{EVENTS_AS_OF}') ORDER BY next_run_at ASC NULLS LAST, source_id LIMIT 25"),
    "alerts_page": sql("v_alerts v_listings", "SELECT alert_id, a.job_id, l.title AS job_title, l.lifecycle FROM (SELECT * FROM v_alerts WHERE user_id = 7 ORDER BY created_at DESC, alert_id DESC LIMIT 500) a LEFT JOIN v_listings l ON l.job_id = a.job_id"),
    "run_history": sql("v_runs v_sources", "SELECT run_id, source_id, status FROM v_runs WHERE source_id IN (SELECT source_id FROM v_sources WHERE owner_id = 7) ORDER BY started_at DESC, run_id DESC LIMIT 20"),
    "distinct_ids": sql("v_refs v_refs_more", "SELECT DISTINCT source_id, job_id FROM refs", REFS_SQL),
}
