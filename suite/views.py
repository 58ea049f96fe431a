"""Input views: the given tables read as listings, preferences, runs and so on.

A view is a list of columns over a table or another view. Where the two engines spell
an expression differently it is given twice (Spark, checking engine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

Expr = str | tuple[str, str]

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def pick(choices: str, index: str) -> str:
    n = len(choices.split("|"))
    return f"split_part('{choices}', '|', CAST({index} % {n} AS INT) + 1)"


def arr(text: str) -> Expr:
    """A comma list as an array, empty entries dropped."""
    return (
        f"filter(split({text}, ','), k -> k <> '')",
        f"list_filter(string_split({text}, ','), lambda k: k <> '')",
    )


def epoch(seconds: str) -> Expr:
    return (f"timestamp_seconds({seconds})", f"make_timestamp(CAST(({seconds}) * 1000000 AS BIGINT))")


def plain(x: str) -> Expr:
    return (f"regexp_replace({x}, '[^A-Za-z0-9 ]+', ' ')", f"regexp_replace({x}, '[^A-Za-z0-9 ]+', ' ', 'g')")


PLACES = (
    "Remote|Anywhere|London, United Kingdom|Berlin, Germany|Europe|Austin, TX|Remote - Canada|Papua New Guinea|"
    "Bissau, Guinea-Bissau|St. Thomas, U.S. Virgin Islands|Trenton, New Jersey|CA|Work from anywhere|Paris; Madrid, Spain|"
    "Toronto, Ontario, Canada or USA|Global|European Union|Seoul, South Korea|Remote (UK)|Tbilisi, Georgia|"
)
STATUSES = "Saved|Applied|Interviewing|Rejected|Offer|Withdrawn|Preparing Application|Ignored"

VIEWS: dict[str, tuple[str, dict[str, Expr], str | None]] = {
    "v_listings": ("documents", {
        "job_id": "doc_id",
        "owner_id": "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 20 END",
        "title": "substr(text, 1, 60)",
        "company": "source",
        "description": "text",
        "location": pick(PLACES, "doc_id"),
        "country": "CASE WHEN doc_id % 3 = 0 THEN upper(lang) WHEN doc_id % 7 = 0 THEN 'us/ca' ELSE '' END",
        "industry": "concat('Sector ', doc_id % 5)",
        "work_type": pick("Remote|Hybrid|On-site|Unknown", "doc_id"),
        "employment_type": pick("Full-time|Contract|Unknown", "doc_id"),
        "seniority": pick("VP|Director|Manager|Founder|Unknown", "doc_id"),
        "salary_min": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 40000 + (doc_id * 7919) % 160000 END",
        "salary_max": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 60000 + (doc_id * 7919) % 150000 END",
        "salary_period": "CASE WHEN doc_id % 7 = 0 THEN 'hour' ELSE 'year' END",
        "currency": "CASE WHEN doc_id % 2 = 0 THEN 'CAD' ELSE 'USD' END",
        "job_url": "concat('https://jobs.example.com/p/', doc_id)",
        "archived": "(doc_id % 11 = 0)",
        "discovered_seq": "(doc_id * 37) % 1000",
        "discovered_at": epoch("1704067200 + ((doc_id * 37) % 1000) * 2600"),
        "updated_at": epoch("1704067200 + ((doc_id * 53) % 1000) * 2600"),
        "lifecycle": "CASE WHEN doc_id % 13 = 0 THEN 'Removed' ELSE 'Active' END",
    }, None),
    "v_prefs": ("customer", {
        "user_id": "c_custkey",
        "countries": arr(pick("|CA,US|GB|DE,FR,ES|GN,PG|US", "c_custkey")),
        "include_worldwide": "(c_custkey % 3 <> 0)",
        "include_unknown": "(c_custkey % 4 = 1)",
        "include_keywords": ("split(" + pick("platform|  the ,und,de|,  |la,en", "c_custkey") + ", ',')",
                             "string_split(" + pick("platform|  the ,und,de|,  |la,en", "c_custkey") + ", ',')"),
        "include_none": "(c_custkey % 3 = 0)",
        "negative_keywords": arr(pick("|terraform|ein  und|que,la de", "c_custkey")),
        "hard_location": "(c_custkey % 2 = 0)",
        "hard_employment": "(c_custkey % 3 = 1)",
        "hard_seniority": "(c_custkey % 5 < 2)",
        "hard_salary": "(c_custkey % 7 = 1)",
        "included_locations": arr(pick("|london,canada|  Berlin |texas,austin", "c_custkey")),
        "work_types": arr(pick("Remote,Hybrid|On-site|", "c_custkey")),
        "employment_types": arr(pick("Full-time,Contract|Full-time|", "c_custkey")),
        "seniority_levels": arr(pick("VP,Director|Manager|", "c_custkey")),
        "salary_min": "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 50000 + (c_custkey * 311) % 90000 END",
        "currency": "CASE WHEN c_custkey % 2 = 0 THEN 'CAD' ELSE 'USD' END",
        "w_role": "CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE 20 END",
        "w_experience": "CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE 20 END",
        "w_skills": "CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE 15 END",
        "w_leadership": "CASE WHEN c_custkey % 9 = 4 THEN 0 ELSE 15 END",
        "w_industry": "CASE WHEN c_custkey % 9 = 4 THEN 60 ELSE 10 END",
        "w_location": "CASE WHEN c_custkey % 9 = 4 THEN 20 ELSE 10 END",
        "w_compensation": "CASE WHEN c_custkey % 9 = 4 THEN 10 ELSE 5 END",
        "w_direction": "CASE WHEN c_custkey % 9 = 4 THEN 10 WHEN c_custkey % 17 = 3 THEN 6 ELSE 5 END",
        "batch_size": "CAST(c_custkey % 6 + 1 AS INT)",
        "budget_micros": "CAST(20000 + (c_custkey * 7919) % 60000 AS BIGINT)",
        "notifications_enabled": "(c_custkey % 5 <> 0)",
        "notify_min": "CAST(80 + c_custkey % 15 AS INT)",
        "digest_min": "CAST(60 + c_custkey % 20 AS INT)",
        "digest_enabled": "(c_custkey % 2 = 0)",
        "digest_hour": "CAST(c_custkey % 24 AS INT)",
        "changed_at": epoch("1704067200 + (c_custkey % 40) * 86400"),
    }, None),
    "v_profiles": ("customer", {
        "user_id": "c_custkey",
        "current_role": "CASE WHEN c_custkey % 8 = 0 THEN '' ELSE concat('Head of ', lower(c_mktsegment)) END",
        "summary": "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('Worked with ', c_name) END",
        "years_experience": "CAST(c_custkey % 30 AS INT)",
        "skills": arr(pick("|python,spark|cloud", "c_custkey")),
        "industries": arr(pick("SaaS,FinTech||Payments", "c_custkey")),
        "leadership_experience": pick("|Teams of ten", "c_custkey"),
        "management_experience": pick("Budgets||Hiring", "c_custkey"),
    }, None),
    "v_matches": ("orders", {
        "user_id": "o_custkey % 20",
        "job_id": "o_orderkey",
        "score": "CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT)",
        "evaluated_at": "o_orderdate",
        "cost_micros": "CAST(floor(o_totalprice) AS BIGINT) % 5000",
        "reason": "concat('Because ', lower(o_orderpriority))",
    }, None),
    "v_saved": ("orders", {
        "user_id": "o_custkey % 20",
        "job_id": "o_orderkey",
        "status": pick(STATUSES, "(o_orderkey + o_custkey)"),
        "updated_at": "o_orderdate",
    }, "o_orderkey % 3 = 0"),
    "v_status_log": ("events", {
        "id": "event_id",
        "user_id": "user_id",
        "job_id": "event_id % 41",
        "status": pick(STATUSES, "event_id"),
        "created_at": "ts",
    }, None),
    "v_factors": ("lineitem", {
        "row_id": "l_orderkey * 10 + l_linenumber",
        "user_id": "l_orderkey % 150",
        "part_key": "l_partkey",
        "role": "l_discount * 10",
        "experience": "CASE WHEN l_orderkey % 101 = 0 THEN 1.5 ELSE l_tax * 12.5 END",
        "skills": "l_quantity / 50",
        "leadership": "((l_partkey * 3) % 101) / CAST(100.0 AS DOUBLE)",
        "industry": "((l_partkey * 7) % 101) / CAST(100.0 AS DOUBLE)",
        "location": "CASE WHEN l_orderkey % 103 = 0 THEN CAST('NaN' AS DOUBLE) ELSE ((l_partkey * 11) % 101) / CAST(100.0 AS DOUBLE) END",
        "compensation": "((l_partkey * 13) % 101) / CAST(100.0 AS DOUBLE)",
        "direction": "((l_partkey * 17) % 101) / CAST(100.0 AS DOUBLE)",
    }, None),
    "v_runs": ("events", {
        "run_id": "event_id",
        "source_id": "user_id",
        "started_at": "ts",
        "status": "CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'click' THEN 'Succeeded' WHEN 'view' THEN 'Partial' "
                  "WHEN 'error' THEN 'Failed' ELSE 'Running' END",
        "duration_ms": "CAST(floor(value * 1000) AS BIGINT)",
    }, None),
    "v_activity": ("events", {
        "id": "event_id",
        "user_id": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END",
        "candidate_id": "event_id % 37",
        "created_at": ("date_trunc('hour', ts)", "date_trunc('hour', ts)"),
        "stage": "event_type",
        "cost_micros": "CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) * 10 ELSE NULL END",
    }, None),
    "v_sources": ("supplier", {
        "source_id": "s_suppkey",
        "owner_id": "CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 20 END",
        "provider": pick("Greenhouse|Lever|Jobicy|Remotive|Ashby|JSON-LD|Workable|TheMuse", "s_suppkey"),
        "board": "concat('board', s_suppkey % 60)",
        "company": "s_name",
        "source_url": "CASE WHEN s_suppkey % 8 = 5 THEN concat('https://site', s_suppkey, '.example.com/jobs?utm_source=a&z=1&b=2#x') ELSE NULL END",
        "enabled": "(s_suppkey % 4 <> 0)",
        "schedule": pick("Manual|Hourly|Every 4 hours|Twice daily|Daily", "s_suppkey"),
        "next_run_at": ("CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE timestamp_seconds(1706659200 - (s_suppkey % 9) * 3600 + 14400) END",
                        "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE make_timestamp(CAST((1706659200 - (s_suppkey % 9) * 3600 + 14400) * 1000000 AS BIGINT)) END"),
    }, None),
    "v_stored": ("documents", {
        "owner_id": "doc_id % 20",
        "canonical_hash": ("sha2(concat('https://jobs.example.com/p/', doc_id), 256)", "sha256(concat('https://jobs.example.com/p/', doc_id))"),
        "job_id": "doc_id",
        "title": "substr(text, 1, 60)",
        "description_hash": ("sha2(text, 256)", "sha256(text)"),
        "lifecycle": "CASE WHEN doc_id % 13 = 0 THEN 'Removed' ELSE 'Active' END",
        "archived": "(doc_id % 11 = 0)",
        "discovered_at": "CAST(doc_id % 500 AS BIGINT)",
        "last_seen": "CAST(500 AS BIGINT)",
    }, "doc_id % 3 <> 0"),
    "v_incoming": ("documents", {
        "owner_id": "doc_id % 20",
        "canonical_hash": ("sha2(concat('https://jobs.example.com/p/', doc_id), 256)", "sha256(concat('https://jobs.example.com/p/', doc_id))"),
        "job_id": "doc_id",
        "title": "concat('New ', substr(text, 1, 40))",
        "description_hash": ("sha2(CASE WHEN doc_id % 10 = 0 THEN concat(text, ' v2') ELSE text END, 256)",
                             "sha256(CASE WHEN doc_id % 10 = 0 THEN concat(text, ' v2') ELSE text END)"),
        "source_id": "doc_id % 20",
        "external_id": "CAST(doc_id AS VARCHAR(20))",
        "ordinal": "doc_id",
    }, "doc_id % 2 = 0"),
    "v_refs": ("documents", {
        "source_id": "doc_id % 20",
        "external_id": "CAST(doc_id AS VARCHAR(20))",
        "job_id": "doc_id",
        "active": "(doc_id % 7 <> 0)",
        "last_seen": "CAST(500 AS BIGINT)",
    }, None),
    "v_refs_more": ("documents", {
        "source_id": "(doc_id + 1) % 20",
        "external_id": "concat('x', doc_id)",
        "job_id": "doc_id",
        "active": "(doc_id % 5 <> 0)",
        "last_seen": "CAST(500 AS BIGINT)",
    }, "doc_id % 4 = 0"),
    "v_vectors": ("embeddings", {
        "vec_id": "vec_id", "user_id": "CAST(label AS BIGINT)", "embedding": "embedding",
    }, None),
    "v_watchlist": ("supplier", {
        "watch_id": "s_suppkey",
        "user_id": "s_suppkey % 20",
        "company": "concat(' Supplier  ', s_suppkey % 50, ' ')",
        "domain": "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('acme', s_suppkey % 40, '.example.com') END",
        "source_id": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey END",
    }, None),
    "v_candidates": ("customer", {
        "candidate_id": "c_custkey",
        "user_id": "c_custkey % 20",
        "name": "concat('supplier ', c_custkey % 50)",
        "domain": "concat('acme', c_custkey % 40, '.example.com')",
        "status": pick("Pending|Resolving|Resolved|Blocked|Failed|Unsupported|NoCareersPage", "c_custkey"),
        "attempts": "CAST(c_custkey % 4 AS INT)",
        "last_checked_at": epoch("1706659200 - (c_custkey % 60) * 60"),
        "created_at": epoch("1704067200 + (c_custkey * 7919) % 1000000"),
        "source_id": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 120 END",
        "watch_id": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 150 END",
    }, None),
    "v_alerts": ("orders", {
        "alert_id": "o_orderkey",
        "user_id": "o_custkey % 20",
        "job_id": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2000 END",
        "dedupe_key": ("concat('match:', o_orderkey, ':', CAST(floor(o_totalprice) AS BIGINT) % 101, ':', unix_millis(CAST(o_orderdate AS TIMESTAMP)))",
                       "concat('match:', o_orderkey, ':', CAST(floor(o_totalprice) AS BIGINT) % 101, ':', epoch_ms(o_orderdate))"),
        "created_at": "o_orderdate",
        "is_read": "(o_orderkey % 2 = 0)",
    }, "o_orderkey % 5 <> 1"),
    "v_feed": ("documents", {
        "n": "doc_id",
        "source_id": "CAST(doc_id % 50 AS BIGINT)",
        "board": "concat('board', doc_id % 13)",
        "company": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Co ', doc_id % 11) END",
        "page_no": "CAST(doc_id % 12 + 1 AS INT)",
        "title": "concat('Role ', doc_id % 97, ' &amp; ', CASE WHEN doc_id % 9 = 0 THEN 'remote ' ELSE '' END, lang)",
        "body": "concat('<p>', text, '</p><br/>R&amp;D &#233;t&#xE9; &copy;<script>x(\"</p>\")</script><ul><li>a</li></ul>')",
        "clean": plain("text"),
        "place": pick(PLACES, "doc_id"),
        "dept": "concat('Dept ', doc_id % 6)",
        "kind": pick("full-time|Contract|part time|Intern|Freelance contract|permanent full time|", "doc_id"),
        "url": "concat('https://jobs.example.com/p/', doc_id, '?ref=x')",
        "posted": "concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(2)), 2, '0'), 'T', lpad(CAST(doc_id % 24 AS VARCHAR(2)), 2, '0'), ':15:00Z')",
        "lo": "CAST(40000 + (doc_id * 7919) % 160000 AS BIGINT)",
        "hi": "CAST(60000 + (doc_id * 6007) % 160000 AS BIGINT)",
        "cur": pick("CAD|USD|EUR|GBP|JPY", "doc_id"),
        "unit": pick("year|HOUR|monthly|Annual|week|day|fortnight", "doc_id"),
    }, None),
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    source, columns, where = VIEWS[name]
    df = view(spark, sf, source)
    if where:
        df = df.filter(where)
    return df.selectExpr(*[f"{e if isinstance(e, str) else e[0]} AS `{c}`" for c, e in columns.items()])


def ctes(*names: str) -> str:
    """``WITH`` clause (without the keyword) defining the views and what they are built on."""
    done: list[str] = []
    parts: list[str] = []

    def add(name: str) -> None:
        if name not in VIEWS or name in done:
            return
        source, columns, where = VIEWS[name]
        add(source)
        done.append(name)
        body = ", ".join(f'{e if isinstance(e, str) else e[1]} AS "{c}"' for c, e in columns.items())
        parts.append(f"{name} AS (SELECT {body} FROM {source}{' WHERE ' + where if where else ''})")

    for n in names:
        add(n)
    return ", ".join(parts)


def sql(views: str, body: str, *more: str) -> str:
    """Checking SQL: ``views`` are set up first, then further CTEs, then the body."""
    head = [c for c in [ctes(*views.split())] if c] + list(more)
    return ("WITH " + ", ".join(head) + " " if head else "") + body
