"""Gates and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from listingspark.functions import urls
from listingspark.functions.countries import country_coverage, country_match
from listingspark.operators import contracts, gates, links as link_ops, reports
from listingspark.operators.joins import spread_join

from . import duck
from .views import sql, view

c, q = F.col, duck.q
USER = 7
EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-02 00:00:00"
LISTINGS_AS_OF = "2024-01-25 12:00:00"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def instant(text: str):
    return F.lit(text).cast("timestamp")


def preferences(spark, sf) -> DataFrame:
    prefs = view(spark, sf, "v_prefs")
    return prefs.withColumn("include_keywords", F.when(c("include_none"), F.array().cast("array<string>")).otherwise(c("include_keywords")))


def keyword_gate(spark, sf):
    return gates.keyword_gate(view(spark, sf, "v_listings"), preferences(spark, sf)).select("job_id", "passed", "reason", "keyword")


def _first(list_: str) -> str:
    return f"list_filter(list_transform({list_}, lambda k: {duck.normalized('k')}), lambda k: k <> '' AND contains(t, k))[1]"


KEYWORD_SQL = sql(
    "v_listings v_prefs",
    "SELECT job_id, neg IS NULL AND (len(inc) = 0 OR hit IS NOT NULL) AS passed, CASE WHEN neg IS NOT NULL THEN concat('Excluded keyword \"', neg, '\"') WHEN len(inc) > 0 AND hit IS NULL THEN 'No required keyword found' END AS reason, "
    "CASE WHEN neg IS NOT NULL THEN neg WHEN len(inc) > 0 AND hit IS NULL THEN '' END AS keyword FROM h",
    "j AS (SELECT job_id, " + duck.normalized("concat(title, ' ', company, ' ', description)") + " AS t, CASE WHEN include_none THEN CAST([] AS VARCHAR[]) ELSE include_keywords END AS inc, negative_keywords FROM v_listings JOIN v_prefs ON owner_id = user_id)",
    f"h AS (SELECT *, {_first('negative_keywords')} AS neg, {_first('inc')} AS hit FROM j)",
)

# Country names and aliases that occur in the location texts of the views.
TERMS = [
    ("CA", "canada"), ("US", r"united states|us|usa|u\.s\.|u\.s\.a\.|united states of america"),
    ("GB", r"united kingdom|uk|u\.k\.|great britain|england|scotland|wales|northern ireland"), ("DE", "germany"), ("ES", "spain"), ("FR", "france"),
    ("KR", "south korea"), ("PG", "papua new guinea"), ("GN", "guinea"), ("GW", "guinea-bissau"), ("VI", r"u\.s\. virgin islands"), ("JE", "jersey"),
    ("GE", "georgia"), ("NO", "norway"), ("IE", "ireland"), ("IT", "italy"),
]
EUROPE = "AL AD AT BY BE BA BG HR CY CZ DK EE FI FR DE GR HU IS IE IT LV LI LT LU MT MD MC ME NL MK NO PL PT RO RU SM RS SK SI ES SE CH UA GB VA".split()


def coverage_ctes() -> list[str]:
    codes = ",".join(q(x) for x in ("CA", "US", "DE", "ES", "FR", "GB"))
    terms = ", ".join(f"({q(code)}, {q(rx)})" for code, rx in TERMS)
    europe = ", ".join(f"({q(x)})" for x in EUROPE)
    return [
        "places AS (SELECT DISTINCT country, location, concat(country, ' ', location) AS t FROM v_listings)",
        f"hits AS (SELECT country, location, code FROM places, (VALUES {terms}) v(code, rx) WHERE regexp_matches(t, concat('(?i)(^|[^a-z])(', rx, ')($|[^a-z])')) "
        f"UNION SELECT country, location, upper(trim(u.k)) FROM places, unnest(string_split(replace(country, '/', ','), ',')) u(k) WHERE upper(trim(u.k)) IN ({codes}) "
        f"UNION SELECT country, location, upper(location) FROM places WHERE upper(location) IN ({codes}) "
        rf"UNION SELECT country, location, code FROM places, (VALUES {europe}) v(code) WHERE regexp_matches(t, '(?i)\beurope(an union)?\b'))",
        "coverage AS (SELECT p.country, p.location, list_sort(list(code) FILTER (WHERE code IS NOT NULL)) AS codes, "
        r"count(code) = 0 AND regexp_matches(any_value(t), '(?i)\b(worldwide|anywhere|global|world wide|work from anywhere)\b') AS worldwide "
        "FROM places p LEFT JOIN hits h ON h.country = p.country AND h.location = p.location GROUP BY p.country, p.location)",
    ]


def country_coverage_q(spark, sf):
    rows = view(spark, sf, "v_listings").select("job_id", country_coverage(c("country"), c("location")).alias("cov"))
    return rows.select("job_id", F.array_join("cov.codes", ",").alias("codes"), c("cov.worldwide").alias("worldwide"))


MATCH = "CASE WHEN len(countries) = 0 THEN true WHEN len(coalesce(codes, [])) > 0 THEN list_has_any(codes, countries) WHEN worldwide THEN include_worldwide ELSE include_unknown END"


def country_match_q(spark, sf):
    listings = view(spark, sf, "v_listings").withColumn("cov", country_coverage(c("country"), c("location")))
    prefs = preferences(spark, sf).select(c("user_id").alias("owner_id"), "countries", "include_worldwide", "include_unknown")
    joined = spread_join(listings, prefs, "owner_id", "job_id", shuffled=True)
    return joined.select("job_id", country_match(c("cov"), c("countries"), c("include_worldwide"), c("include_unknown")).alias("matches"))


def hard_filter(spark, sf):
    return gates.hard_filter(spark, view(spark, sf, "v_listings"), preferences(spark, sf)).select("job_id", "owner_id", c("blocked").alias("reason"))


BLOCKED = (
    f"CASE WHEN NOT ({MATCH}) THEN 'The job is outside your selected countries.' "
    "WHEN hard_location AND len(included_locations) > 0 AND NOT (list_contains(work_types, 'Remote') AND l.work_type = 'Remote') "
    "AND len(list_filter(list_transform(included_locations, lambda w: lower(trim(w))), lambda w: w <> '' AND contains(lower(concat(l.location, ' ', l.country, ' ', l.work_type)), w))) = 0 THEN 'The location does not meet your hard location requirement.' "
    "WHEN hard_employment AND len(employment_types) > 0 AND NOT list_contains(employment_types, l.employment_type) THEN 'The employment type does not meet your hard requirement.' "
    "WHEN hard_seniority AND len(seniority_levels) > 0 AND l.seniority <> 'Unknown' AND NOT list_contains(seniority_levels, l.seniority) THEN 'The seniority does not meet your hard requirement.' "
    "WHEN hard_salary AND p.salary_min IS NOT NULL AND (NOT (l.salary_period = 'year' AND l.currency = p.currency AND l.salary_min IS NOT NULL) OR l.salary_min < p.salary_min) THEN 'Comparable compensation is missing or below your hard minimum.' END"
)
BLOCKED_FROM = "FROM v_listings l JOIN v_prefs p ON p.user_id = l.owner_id JOIN coverage cv ON cv.country = l.country AND cv.location = l.location"


def visible_rows(spark, sf):
    return view(spark, sf, "v_listings").filter(gates.visible(c("owner_id"), USER)).select("job_id", "owner_id")


def active_rows(spark, sf):
    return view(spark, sf, "v_listings").filter(~c("archived")).select("job_id")


def archived_rows(spark, sf):
    return view(spark, sf, "v_listings").filter(c("archived")).select("job_id")


BOARD_FILTERS = {
    "text": dict(q="e_o"), "work": dict(work="Remote"), "saved": dict(view="saved"), "applications": dict(view="applications"),
    "score": dict(score=60), "archived": dict(view="archived", q="e"),
}


def board_filter(spark, sf):
    rows = reports.board_join(view(spark, sf, "v_listings"), view(spark, sf, "v_matches"), view(spark, sf, "v_saved"), USER)
    parts = [
        rows.filter(reduce(lambda a, b: a & b, gates.board_conditions(**f))).select(F.lit(name).alias("board"), "job_id")
        for name, f in BOARD_FILTERS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


BOARD_JOIN_SQL = (
    f"b AS (SELECT l.*, m.score, m.evaluated_at, s.status FROM v_listings l LEFT JOIN v_matches m ON m.job_id = l.job_id AND m.user_id = {USER} "
    f"LEFT JOIN v_saved s ON s.job_id = l.job_id AND s.user_id = {USER} WHERE owner_id IS NULL OR owner_id = {USER})"
)


def contract_check(spark, sf):
    rows = view(spark, sf, "v_listings").withColumns({
        "currency": F.when(c("job_id") % 17 == 0, "JPY").otherwise(c("currency")),
        "job_url": F.when(c("job_id") % 19 == 0, "ftp://x").otherwise(c("job_url")),
    })
    return contracts.check_listings(rows).select("job_id", F.array_join("violations", ",").alias("violations"))


def weights_check(spark, sf):
    return view(spark, sf, "v_prefs").select("user_id", contracts.weights_violation({f: c(f"w_{f}") for f in contracts.FACTORS}).alias("problem"))


def factors_check(spark, sf):
    rows = view(spark, sf, "v_factors").withColumns({
        "reasons": F.expr("CASE row_id % 4 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('good', ' ') ELSE array('good') END"),
        "gaps": F.expr("CASE WHEN row_id % 7 = 0 THEN array_repeat('gap', 9) ELSE CAST(array() AS array<string>) END"),
    })
    problem = contracts.factors_violation({f: c(f) for f in contracts.FACTORS}, c("reasons"), c("gaps"))
    return rows.select("row_id", "part_key", problem.alias("problem"))


URL_KINDS = (
    "CASE page_id % 9 WHEN 0 THEN replace(url, 'http://', 'https://') WHEN 1 THEN 'https://user:pw@acme.com/x' WHEN 2 THEN 'https://acme.com:8443/' WHEN 3 THEN 'https://acme.com:443/ok' "
    "WHEN 4 THEN 'https://acme.com./x' WHEN 5 THEN 'https://localhost/x' WHEN 6 THEN 'https://10.1.2.3/x' ELSE url END"
)


def url_admission(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", f"{URL_KINDS} AS raw")
    return rows.select("page_id", urls.url_admitted(c("raw")).alias("admitted"))


TARGETS = (
    "CASE page_id % 6 WHEN 0 THEN 'https://jobs.lever.co/acme' WHEN 1 THEN concat('https://other.', regexp_extract(url, '([^./]+[.][^./]+[.][a-z]+)/', 1), '/x') "
    "WHEN 2 THEN 'https://apply.workable.com/acme' WHEN 3 THEN 'https://elsewhere.org/x' WHEN 4 THEN 'https://acme.wd5.myworkdayjobs.com/x' ELSE replace(url, 'https://', 'http://') END"
)


def host_allowed(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", "url", f"{TARGETS} AS target")
    return rows.select("page_id", "target", urls.host_allowed(c("target"), urls.host_of(c("url"))).alias("allowed"))


MARKED = "CASE page_id % 8 WHEN 1 THEN concat(html, '<div class=\"G-reCAPTCHA\">') WHEN 3 THEN concat(html, 'Verify you are a human') WHEN 5 THEN concat('<i>cf-challenge</i>', html) ELSE html END"


def challenge_page(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", f"{MARKED} AS html")
    return rows.select("page_id", link_ops.challenge_page(c("html")).alias("challenged"))


def due_candidates(spark, sf):
    return gates.due_candidates(view(spark, sf, "v_candidates"), instant(EVENTS_AS_OF), limit=20).select("candidate_id", "status")


def throttled_sources(spark, sf):
    found = gates.throttled_sources(view(spark, sf, "v_sources"), view(spark, sf, "v_runs"), moment("2024-01-30 23:30:00"))
    return found.select("source_id", "provider", "last_success", "allowed_at")


def prefs_defaults(spark, sf):
    stored = view(spark, sf, "customer").selectExpr(
        "c_custkey AS user_id",
        "CASE c_custkey % 4 WHEN 0 THEN '{}' WHEN 1 THEN concat('{\"notifyMinScore\":', c_custkey % 120, ',\"digestEnabled\":true}') "
        "WHEN 2 THEN concat('{\"evaluationBatchSize\":', c_custkey % 30, ',\"includeWorldwideJobs\":false}') ELSE concat('{\"digestHourUtc\":', c_custkey % 26, '}') END AS data",
    )
    rows = contracts.fill_preferences(stored)
    return rows.select("user_id", "includeWorldwideJobs", "digestEnabled", *[c(n).cast("bigint").alias(n) for n in ("evaluationBatchSize", "notifyMinScore", "digestMinScore", "digestHourUtc", "aiMonthlyBudgetMicros")], "problem")


QUERIES = {
    "keyword_gate": keyword_gate, "country_coverage": country_coverage_q, "country_match": country_match_q, "hard_filter": hard_filter,
    "visible_rows": visible_rows, "active_rows": active_rows, "archived_rows": archived_rows, "board_filter": board_filter,
    "contract_check": contract_check, "weights_check": weights_check, "factors_check": factors_check, "url_admission": url_admission,
    "host_allowed": host_allowed, "challenge_page": challenge_page, "due_candidates": due_candidates, "throttled_sources": throttled_sources,
    "prefs_defaults": prefs_defaults,
}

_F_OK = " AND ".join(f"{f} BETWEEN 0 AND 1 AND NOT isnan({f})" for f in contracts.FACTORS)
_W_OK = " AND ".join(f"w_{f} BETWEEN 0 AND 100" for f in contracts.FACTORS)
_W_SUM = " + ".join(f"w_{f}" for f in contracts.FACTORS)

ORACLE = {
    "keyword_gate": KEYWORD_SQL,
    "country_coverage": sql("v_listings", "SELECT job_id, coalesce(array_to_string(codes, ','), '') AS codes, worldwide FROM v_listings JOIN coverage USING (country, location)", *coverage_ctes()),
    "country_match": sql("v_listings v_prefs", f"SELECT job_id, {MATCH} AS matches {BLOCKED_FROM}", *coverage_ctes()),
    "hard_filter": sql("v_listings v_prefs", f"SELECT job_id, owner_id, {BLOCKED} AS reason {BLOCKED_FROM}", *coverage_ctes()),
    "visible_rows": sql("v_listings", f"SELECT job_id, owner_id FROM v_listings WHERE owner_id IS NULL OR owner_id = {USER}"),
    "active_rows": sql("v_listings", "SELECT job_id FROM v_listings WHERE NOT archived"),
    "archived_rows": sql("v_listings", "SELECT job_id FROM v_listings WHERE archived"),
    "board_filter": sql("v_listings v_matches v_saved", " UNION ALL ".join(f"SELECT {q(n)} AS board, job_id FROM b WHERE {w}" for n, w in {
        "text": "NOT archived AND (contains(lower(title), 'e_o') OR contains(lower(company), 'e_o') OR contains(lower(location), 'e_o'))",
        "work": "NOT archived AND work_type = 'Remote'", "saved": "NOT archived AND status = 'Saved'",
        "applications": "NOT archived AND status IN ('Preparing Application','Applied','Interviewing','Offer','Rejected','Withdrawn')",
        "score": "NOT archived AND score >= 60",
        "archived": "archived AND (contains(lower(title), 'e') OR contains(lower(company), 'e') OR contains(lower(location), 'e'))",
    }.items()), BOARD_JOIN_SQL),
    "contract_check": sql("v_listings", f"SELECT job_id, {duck.violations()} AS violations FROM x",
        "x AS (SELECT * REPLACE (CASE WHEN job_id % 17 = 0 THEN 'JPY' ELSE currency END AS currency, CASE WHEN job_id % 19 = 0 THEN 'ftp://x' ELSE job_url END AS job_url) FROM v_listings)"),
    "weights_check": sql("v_prefs", f"SELECT user_id, CASE WHEN NOT ({_W_OK}) THEN 'weight_range' WHEN abs({_W_SUM} - 100) >= 0.001 THEN 'weight_total' END AS problem FROM v_prefs"),
    "factors_check": sql("v_factors", f"SELECT row_id, part_key, CASE WHEN NOT ({_F_OK}) THEN 'factor_range' WHEN row_id % 4 < 2 THEN 'reasons' WHEN row_id % 7 = 0 THEN 'gaps' END AS problem FROM v_factors"),
    "url_admission": "SELECT page_id, CASE page_id % 9 WHEN 0 THEN true WHEN 3 THEN true WHEN 7 THEN starts_with(url, 'https://') WHEN 8 THEN starts_with(url, 'https://') ELSE false END AS admitted FROM pages",
    "host_allowed": f"SELECT page_id, target, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 4 THEN true ELSE false END AS allowed FROM (SELECT page_id, {TARGETS} AS target FROM pages)",
    "challenge_page": f"SELECT page_id, regexp_matches({MARKED}, '(?i)g-recaptcha|hcaptcha|cf-challenge|turnstile|verify you are (a )?human|are you a robot|enable javascript and cookies to continue') AS challenged FROM pages",
    "due_candidates": sql("v_candidates", f"SELECT candidate_id, status FROM v_candidates WHERE status = 'Pending' OR (status = 'Resolving' AND last_checked_at < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 15 MINUTE) ORDER BY created_at, candidate_id LIMIT 20"),
    "throttled_sources": sql("v_sources v_runs", "SELECT source_id, provider, last_success, last_success + to_hours(h) AS allowed_at FROM (SELECT s.source_id, provider, max(started_at) AS last_success, CASE provider WHEN 'Jobicy' THEN 1 ELSE 6 END AS h "
        "FROM v_sources s JOIN v_runs r ON r.source_id = s.source_id WHERE provider IN ('Jobicy', 'Remotive') AND status = 'Succeeded' GROUP BY ALL) WHERE last_success + to_hours(h) > TIMESTAMP '2024-01-30 23:30:00'"),
    "prefs_defaults": "SELECT user_id, w AS \"includeWorldwideJobs\", d AS \"digestEnabled\", b AS \"evaluationBatchSize\", m AS \"notifyMinScore\", CAST(85 AS BIGINT) AS \"digestMinScore\", h AS \"digestHourUtc\", CAST(250000 AS BIGINT) AS \"aiMonthlyBudgetMicros\", "
        "CASE WHEN b NOT BETWEEN 1 AND 20 THEN 'evaluationBatchSize' WHEN m > 100 THEN 'notifyMinScore' WHEN h > 23 THEN 'digestHourUtc' END AS problem FROM (SELECT c_custkey AS user_id, c_custkey % 4 <> 2 AS w, c_custkey % 4 = 1 AS d, "
        "CASE WHEN c_custkey % 4 = 2 THEN c_custkey % 30 ELSE 5 END AS b, CASE WHEN c_custkey % 4 = 1 THEN c_custkey % 120 ELSE 90 END AS m, CASE WHEN c_custkey % 4 = 3 THEN c_custkey % 26 ELSE 13 END AS h FROM customer)",
}
