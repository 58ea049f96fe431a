"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.functions.countries import country_coverage
from listingspark.operators.joins import spread_join
from listingspark.operators import links as link_ops, merge, reports, robots

from . import duck
from .gating import BLOCKED, BLOCKED_FROM, BOARD_JOIN_SQL, USER, coverage_ctes, preferences
from .views import sql, view

c = F.col


def board_join(spark, sf):
    rows = reports.board_join(view(spark, sf, "v_listings"), view(spark, sf, "v_matches"), view(spark, sf, "v_saved"), USER)
    return rows.select("job_id", c("score").cast("bigint").alias("score"), "status")


def saved_join(spark, sf):
    active = view(spark, sf, "v_listings").filter(~c("archived")).select("job_id", "company")
    return view(spark, sf, "v_saved").join(active, "job_id").select("user_id", "job_id", "status", "company")


def scored_join(spark, sf):
    rows = reports.scored_join(view(spark, sf, "v_matches"), view(spark, sf, "v_listings"))
    return rows.select("user_id", "job_id", c("score").cast("bigint").alias("score"), "company", "location")


def alerts_join(spark, sf):
    alerts = view(spark, sf, "v_alerts")
    listings = view(spark, sf, "v_listings").select("job_id", c("title").alias("job_title"), "lifecycle")
    return alerts.join(listings, "job_id", "left").select("alert_id", "user_id", "job_id", "job_title", "lifecycle")


def with_source(name: str, key: str):
    def run(spark, sf):
        sources = view(spark, sf, "v_sources").select("source_id", "provider", "enabled")
        return view(spark, sf, name).join(sources, "source_id", "left").select(key, "user_id", "source_id", "provider", "enabled")

    return run


def _changed(spark, sf):
    return view(spark, sf, "v_prefs").select("user_id", "changed_at")


def _matches(spark, sf):
    """Evaluations moved to the time of the listings so that some are stale."""
    return view(spark, sf, "v_matches").withColumn("evaluated_at", F.expr("timestamp_seconds(1704067200 + (job_id % 700) * 3700)"))


MATCHES_SQL = "mt AS (SELECT user_id, job_id, make_timestamp(CAST((1704067200 + (job_id % 700) * 3700) * 1000000 AS BIGINT)) AS evaluated_at FROM v_matches)"
EVAL_SQL = (
    "ev AS (SELECT l.*, l.owner_id AS user_id FROM v_listings l LEFT JOIN mt m ON m.user_id = l.owner_id AND m.job_id = l.job_id LEFT JOIN v_prefs p ON p.user_id = l.owner_id "
    "WHERE l.owner_id IS NOT NULL AND lifecycle = 'Active' AND NOT archived AND (m.job_id IS NULL OR m.evaluated_at < l.updated_at OR m.evaluated_at < p.changed_at) "
    "AND EXISTS (SELECT 1 FROM v_refs r JOIN v_sources s ON s.source_id = r.source_id WHERE r.job_id = l.job_id AND r.active AND s.enabled))"
)


def eval_candidates(spark, sf):
    sources = view(spark, sf, "v_sources").filter("enabled")
    rows = reports.eval_candidates(view(spark, sf, "v_listings"), view(spark, sf, "v_refs"), sources, _matches(spark, sf), _changed(spark, sf))
    return rows.select("user_id", "job_id")


def _refs(spark, sf):
    return view(spark, sf, "v_refs").unionByName(view(spark, sf, "v_refs_more"))


def missing_refs(spark, sf):
    seen = view(spark, sf, "v_incoming").select("source_id", "external_id").distinct()
    return _refs(spark, sf).filter("active").join(seen, ["source_id", "external_id"], "left_anti").select("source_id", "external_id", "job_id")


def latest_run(spark, sf):
    rows = reports.latest_run(view(spark, sf, "v_sources"), view(spark, sf, "v_runs"))
    return rows.select("source_id", c("last.run_id").alias("run_id"), c("last.status").alias("status"), c("last.started_at").alias("started_at"))


def _requested(spark, sf):
    return view(spark, sf, "v_runs").selectExpr("run_id", "source_id % 20 AS user_id")


def runs_complete(spark, sf):
    owners = view(spark, sf, "v_sources").filter(c("owner_id").isNotNull())
    return reports.runs_complete(_requested(spark, sf), view(spark, sf, "v_runs"), owners)


def link_by_key(spark, sf):
    return merge.link_by_key(view(spark, sf, "v_candidates"), view(spark, sf, "v_watchlist"))


def country_join(spark, sf):
    """Listings per proven country."""
    rows = view(spark, sf, "v_listings").select("job_id", country_coverage(c("country"), c("location")).alias("cov"))
    return rows.select(F.explode("cov.codes").alias("code")).groupBy("code").agg(F.count("*").alias("listings"))


ROBOTS = (
    "concat('# policy of ', host, chr(10), 'User-agent: *', chr(10), 'Disallow: /de/', CASE WHEN n % 2 = 0 THEN concat(chr(10), 'Allow: /de/1') ELSE '' END, chr(10), 'Disallow: /*8$', chr(13), chr(10), "
    "'Disallow:', chr(10), CASE WHEN n % 3 = 0 THEN concat('User-Agent: PoliteBot # us', chr(10), 'User-agent: Other', chr(10), 'Disallow: /fr/', chr(10), 'Allow: /fr/*5', chr(10), 'disallow: /*/2*', chr(10)) ELSE '' END, "
    "CASE WHEN n % 5 = 0 THEN concat('User-agent: lonely', chr(10), 'Sitemap: https://x/y', chr(10)) ELSE '' END, 'nonsense line', chr(10), 'User-agent: last', chr(10), 'Disallow: /')"
)
HOST = "regexp_extract(url, '://([^/?#]*)', 1)"


def robots_files(spark, sf):
    """One robots text per host of the page table."""
    hosts = view(spark, sf, "pages").selectExpr("page_id", f"{HOST} AS host").groupBy("host").agg(F.min("page_id").alias("n"))
    return hosts.selectExpr("host", f"{ROBOTS} AS text")


def page_paths(spark, sf):
    return view(spark, sf, "pages").selectExpr("page_id", f"{HOST} AS host", "regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path")


def robots_join(spark, sf):
    """How many rules bind each page's host for the agent."""
    bound = robots.agent_rules(robots.robots_rules(robots_files(spark, sf)), "PoliteBot")
    return spread_join(page_paths(spark, sf), bound, "host", "page_id", "left").select("page_id", "host", F.coalesce(F.size("rules"), F.lit(0)).cast("bigint").alias("rules"))


def blocks_join(spark, sf):
    """Hard-filter outcome counts per person."""
    from listingspark.operators import gates

    rows = gates.hard_filter(spark, view(spark, sf, "v_listings"), preferences(spark, sf))
    return rows.groupBy("owner_id", c("blocked").alias("reason")).agg(F.count("*").alias("listings"))


def claims(spark, sf):
    """Claims as an extractor would return them: most are on the page, some are invented."""
    pages = view(spark, sf, "pages")
    return pages.selectExpr(
        "page_id", "explode(array(0, 1)) AS k", "url AS page_url",
        "regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS head", "html",
    ).selectExpr(
        "page_id", "CASE WHEN k = 0 OR page_id % 3 = 0 THEN page_url ELSE 'https://invented.example.com/x' END AS url", "head AS title",
        "CASE WHEN page_id % 5 = 1 AND k = 1 THEN concat(head, ' nowhere') ELSE concat(' ', head, ' ') END AS description", "CASE WHEN page_id % 7 = 2 THEN 'Atlantis' ELSE '' END AS location",
    )


def grounding_join(spark, sf):
    return link_ops.claims_grounded(claims(spark, sf), view(spark, sf, "pages"))


# the evidence text of a page starts with its title, so a title is always found in it
GROUND_SQL = (
    "SELECT page_id, count(*) AS claims, bool_and(ok) AS grounded, count(*) FILTER (WHERE NOT ok) AS unsupported FROM ("
    "SELECT page_id, (k = 0 OR page_id % 3 = 0) AND contains(ev, lower(norm)) AND (NOT (page_id % 5 = 1 AND k = 1) OR contains(ev, concat(lower(norm), ' nowhere'))) "
    "AND (page_id % 7 <> 2 OR contains(ev, 'atlantis')) AS ok FROM ("
    f"SELECT page_id, k, {duck.collapse(chr(114) + 'egexp_extract(html, ' + duck.q('(?s)<title>(.*?)</title>') + ', 1)')} AS norm, lower({duck.collapse('substr(' + duck.html_to_text('html') + ', 1, 24000)')}) AS ev "
    "FROM pages CROSS JOIN (VALUES (0), (1)) v(k))) GROUP BY page_id"
)

QUERIES = {
    "board_join": board_join, "saved_join": saved_join, "scored_join": scored_join, "alerts_join": alerts_join,
    "candidates_join": with_source("v_candidates", "candidate_id"), "watchlist_join": with_source("v_watchlist", "watch_id"),
    "eval_candidates": eval_candidates, "missing_refs": missing_refs, "latest_run": latest_run, "runs_complete": runs_complete,
    "link_by_key": link_by_key, "country_join": country_join, "robots_join": robots_join, "blocks_join": blocks_join, "grounding_join": grounding_join,
}

REFS_SQL = "refs AS (SELECT * FROM v_refs UNION ALL SELECT * FROM v_refs_more)"
HOSTS_SQL = f"hosts AS (SELECT {HOST} AS host, min(page_id) AS n FROM pages GROUP BY 1)"

ORACLE = {
    "board_join": sql("v_listings v_matches v_saved", "SELECT job_id, CAST(score AS BIGINT) AS score, status FROM b", BOARD_JOIN_SQL),
    "saved_join": sql("v_saved v_listings", "SELECT s.user_id, s.job_id, s.status, l.company FROM v_saved s JOIN v_listings l ON l.job_id = s.job_id WHERE NOT archived"),
    "scored_join": sql("v_matches v_listings", "SELECT m.user_id, m.job_id, CAST(m.score AS BIGINT) AS score, l.company, l.location FROM v_matches m JOIN v_listings l ON l.job_id = m.job_id WHERE NOT archived"),
    "alerts_join": sql("v_alerts v_listings", "SELECT alert_id, a.user_id, a.job_id, l.title AS job_title, l.lifecycle FROM v_alerts a LEFT JOIN v_listings l ON l.job_id = a.job_id"),
    "candidates_join": sql("v_candidates v_sources", "SELECT candidate_id, user_id, c.source_id, provider, s.enabled FROM v_candidates c LEFT JOIN v_sources s ON s.source_id = c.source_id"),
    "watchlist_join": sql("v_watchlist v_sources", "SELECT watch_id, user_id, c.source_id, provider, s.enabled FROM v_watchlist c LEFT JOIN v_sources s ON s.source_id = c.source_id"),
    "eval_candidates": sql("v_listings v_matches v_refs v_sources v_prefs", "SELECT user_id, job_id FROM ev", MATCHES_SQL, EVAL_SQL),
    "missing_refs": sql("v_refs v_refs_more v_incoming", "SELECT source_id, external_id, job_id FROM refs r WHERE active AND NOT EXISTS (SELECT 1 FROM v_incoming i WHERE i.source_id = r.source_id AND i.external_id = r.external_id)", REFS_SQL),
    "latest_run": sql("v_sources v_runs", "SELECT s.source_id, r.run_id, r.status, r.started_at FROM v_sources s LEFT JOIN (SELECT * FROM v_runs QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) = 1) r ON r.source_id = s.source_id"),
    "runs_complete": sql("v_sources v_runs", "SELECT r.run_id, r.source_id % 20 AS user_id FROM v_runs r LEFT JOIN v_sources s ON s.source_id = r.source_id WHERE r.status NOT IN ('Succeeded','Partial') OR s.owner_id IS NULL OR s.owner_id <> r.source_id % 20"),
    "link_by_key": sql("v_candidates v_watchlist", "SELECT user_id, candidate_id, watch_id, wd = '' AND candidate_id = lead_id AS backfill, domain FROM (SELECT c.user_id, candidate_id, w.watch_id, w.domain AS wd, c.domain, min(candidate_id) OVER (PARTITION BY w.watch_id) AS lead_id, arg_min(c.domain, candidate_id) OVER (PARTITION BY w.watch_id) AS lead_domain FROM v_candidates c JOIN v_watchlist w ON w.user_id = c.user_id AND "
        f"{duck.normalized('w.company')} = {duck.normalized('c.name')} AND true) WHERE domain = CASE WHEN wd = '' THEN lead_domain ELSE wd END"),
    "country_join": sql("v_listings", "SELECT code, count(*) AS listings FROM v_listings JOIN hits USING (country, location) GROUP BY code", *coverage_ctes()),
    "robots_join": sql("", f"SELECT page_id, h.host, CAST(CASE WHEN n % 3 = 0 THEN 3 ELSE 2 + CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS rules FROM (SELECT page_id, {HOST} AS host FROM pages) p JOIN hosts h ON h.host = p.host", HOSTS_SQL),
    "blocks_join": sql("v_listings v_prefs", f"SELECT owner_id, {BLOCKED} AS reason, count(*) AS listings {BLOCKED_FROM} GROUP BY ALL", *coverage_ctes()),
    "grounding_join": GROUND_SQL,
}
