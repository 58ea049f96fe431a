"""Scalar expressions, each applied to a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from listingspark.functions import dates, labels, numbers, text, urls
from listingspark.operators import reports

from . import duck
from .views import epoch, pick, plain, sql, view

c = F.col
H, q = duck.html_to_text, duck.q


def hashed(col: Column, *more: Column) -> list[Column]:
    """A long text as its hash and length."""
    return [F.sha2(col, 256).alias("text_hash"), F.length(col).cast("bigint").alias("n_chars"), *more]


def hashed_sql(x: str) -> str:
    return f"sha256({x}) AS text_hash, length({x}) AS n_chars"


def html_to_text(spark, sf):
    rows = view(spark, sf, "pages").select("page_id", text.html_to_text(c("html")).alias("t"))
    return rows.select("page_id", *hashed(c("t")))


TRICKY = "concat('<scriptable>x</scriptable>', html, '<script>open <SCRIPT a=1>b</Script>', '<script>never closed')"


def strip_element(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", f"{TRICKY} AS h")
    return rows.select("page_id", text.strip_element(c("h"), "script").alias("t")).select("page_id", *hashed(c("t")))


ENTITIES = "concat(text, ' &amp;lt; &#x41;&#66; &copy; &NBSP;| &#', doc_id % 900 + 60, '; &#xZZ; &amp &quot; &#000000065; &#x00000004a; &#00000000000000000000066;')"


def decode_entities(spark, sf):
    rows = view(spark, sf, "documents").selectExpr("doc_id", f"{ENTITIES} AS h")
    return rows.select("doc_id", text.decode_entities(c("h")).alias("t")).select("doc_id", *hashed(c("t")))


def iso_date(spark, sf):
    rows = view(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 6 WHEN 0 THEN concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T05:06:07.250Z') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
        "WHEN 2 THEN 'soon' WHEN 3 THEN concat('Mon, ', date_format(o_orderdate, 'dd MMM yyyy'), ' 22:00:00 +0200') WHEN 4 THEN '' "
        "ELSE concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T23:30:00-01:00') END AS raw",
    )
    return rows.select("o_orderkey", "raw", F.unix_millis(dates.iso_date(c("raw"))).alias("millis"))


N = "CAST(floor(l_extendedprice) AS BIGINT)"
RAW_PAY = f"CASE l_linenumber % 7 WHEN 0 THEN concat({N}, '.5') WHEN 1 THEN concat({N}, 'k') WHEN 2 THEN concat('$', {N}, '-60/hr') WHEN 3 THEN '0' WHEN 4 THEN concat(' ', {N}, ' ') WHEN 5 THEN concat({N}, '00000') ELSE 'Competitive' END"
ROW = "l_orderkey, l_linenumber, l_partkey"
INT_SQL = f"CASE l_linenumber % 7 WHEN 0 THEN {N} + 1 WHEN 4 THEN CASE WHEN {N} > 0 THEN {N} END WHEN 5 THEN CASE WHEN {N} * 100000 <= 10000000 AND {N} > 0 THEN {N} * 100000 END END"


def salary_int(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{RAW_PAY} AS raw")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numbers.salary_int(c("raw")).cast("bigint").alias("salary"))


def salary_range(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{RAW_PAY} AS raw", "CAST(l_partkey * 7 AS STRING) AS other")
    low, high = numbers.salary_range(c("raw"), c("other"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", low.cast("bigint").alias("salary_min"), high.cast("bigint").alias("salary_max"))


def salary_lenient(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{RAW_PAY} AS raw")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numbers.salary_lenient(c("raw")).alias("salary"))


def currency_of(spark, sf):
    rows = view(spark, sf, "v_feed").select("n", "cur")
    return rows.groupBy(numbers.currency_of(c("cur")).alias("currency"), "cur").agg(F.count("*").alias("listings"))


WORDS = pick("year|per HOUR|monthly|Annual salary|weekly|daily|fortnight|WEEK|", "l_orderkey")
CODES = pick("PA|ph|PM| pw |PD|XX", "l_orderkey")


def period_of(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr(f"{WORDS} AS word", f"{CODES} AS code")
    return rows.groupBy(
        "word", "code", labels.period_word(c("word")).alias("by_word"), labels.period_unit(c("word")).alias("by_unit"), labels.period_code(c("code")).alias("by_code")
    ).agg(F.count("*").alias("items"))


KIND_PROVIDERS = ("Lever", "Workable", "Personio", "SmartRecruiters", "Rippling", "Jobicy", "Remotive", "USAJOBS", "Adzuna", "JSON-LD")
KINDS = "concat(" + pick("full-time|Contract|part time|Intern|Freelance contract|permanent full time|Salaried_FT|trainee|temp|", "l_orderkey") + ", ' ', lower(l_returnflag))"


def employment_class(spark, sf):
    rows = view(spark, sf, "lineitem").selectExpr(f"{KINDS} AS kind")
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("provider"), labels.employment_class(p, c("kind")).alias("employment")) for p in KIND_PROVIDERS]))
    return rows.select("kind", each.alias("e")).groupBy("kind", "e.provider", "e.employment").agg(F.count("*").alias("items"))


# What each feed's rules make of the ten wordings of KINDS, in their order: F full-time, C contract, T temporary, P permanent, - unknown.
EMPLOYMENT_EXPECTED = {
    "Lever": "FCT-CF----", "Workable": "FCTTCF----", "Personio": "FC-TCP-T--", "SmartRecruiters": "FCTTCP----", "Rippling": "FCTTCFF-C-",
    "Jobicy": "FC--CF----", "Remotive": "FCT-CF----", "USAJOBS": "F-TT-F----", "Adzuna": "FCT-CP----", "JSON-LD": "FCT-CF--T-",
}


def _rules_sql(p: str) -> str:
    letter = f"substr({q(EMPLOYMENT_EXPECTED[p])}, CAST(i AS INT) + 1, 1)"
    return f"SELECT kind, {q(p)} AS provider, CASE {letter} WHEN 'F' THEN 'Full-time' WHEN 'C' THEN 'Contract' WHEN 'T' THEN 'Temporary' WHEN 'P' THEN 'Permanent' ELSE 'Unknown' END AS employment FROM k"


def work_class(spark, sf):
    rows = view(spark, sf, "v_listings")
    label = labels.work_class(F.concat_ws(" ", "title", "location").rlike("(?i)remote|work from home"), c("location") != "")
    return rows.select("job_id", label.alias("work"))


URLS = "concat(url, CASE WHEN instr(url, '?') > 0 THEN '&' ELSE '?' END, 'z=1&UTM_medium=q&a=b&a=a&Source=k', CASE WHEN page_id % 3 = 0 THEN '#frag' ELSE '' END)"


def canonical_url(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", "CASE WHEN page_id % 9 = 0 THEN 'not a url' WHEN instr(url, '#') > 0 THEN url ELSE " + URLS + " END AS raw")
    return rows.select("page_id", urls.canonical_url(c("raw")).alias("canonical"))


def content_hash(spark, sf):
    return view(spark, sf, "documents").select("doc_id", text.content_hash(c("text")).alias("hash"))


def keyword_text(spark, sf):
    rows = view(spark, sf, "v_listings").select("job_id", text.keyword_text(c("title"), c("company"), c("description")).alias("t"))
    return rows.select("job_id", *hashed(c("t")))


def company_key(spark, sf):
    rows = view(spark, sf, "supplier").selectExpr("s_suppkey", "concat('  ', upper(s_name), chr(9), '  Inc ') AS company")
    return rows.select("s_suppkey", text.company_key(c("company")).alias("key"))


HOSTS = "CASE page_id % 8 WHEN 0 THEN 'jobs.acme.co.uk' WHEN 1 THEN 'localhost' WHEN 2 THEN '10.0.0.1' WHEN 3 THEN concat('WWW.Acme', page_id, '.com.') WHEN 4 THEN 'co.uk' WHEN 5 THEN 'a..b.com' ELSE regexp_extract(url, '://([^/?#]*)', 1) END"


def registrable_domain(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", f"{HOSTS} AS host")
    return rows.select("page_id", "host", urls.registrable_domain(c("host")).alias("domain"))


POINTERS = pick("/a~1b/0|/m~0n|/list/1/name|/list/7/name|/obj/2|bad|/nothing|/num", "doc_id")


def json_pointer(spark, sf):
    rows = view(spark, sf, "documents").selectExpr(
        "doc_id", f"{POINTERS} AS pointer",
        "to_json(map('a/b', array(source), 'm~n', array(lang))) AS one",
        "to_json(named_struct('a/b', array(source), 'm~n', lang, 'list', array(named_struct('name', 'x'), named_struct('name', source)), 'obj', map('2', concat(' ', lang, ' ')), 'num', n_chars)) AS doc",
    )
    return rows.select("doc_id", "pointer", urls.pointer_text(F.try_parse_json("doc"), c("pointer")).alias("found"))


def match_band(spark, sf):
    rows = view(spark, sf, "v_matches")
    return rows.groupBy("score", labels.match_band(c("score")).alias("band")).agg(F.count("*").alias("matches"))


SCHEDULES = pick("Manual|Hourly|Every 4 hours|Twice daily|Daily", "event_id")


def next_slot(spark, sf):
    rows = view(spark, sf, "events").selectExpr("event_id", f"{SCHEDULES} AS schedule", "ts")
    return rows.select("event_id", F.unix_seconds(dates.next_slot(c("schedule"), c("ts"))).alias("next_s"))


def approx_tokens(spark, sf):
    return view(spark, sf, "documents").select("doc_id", numbers.approx_tokens(c("text"), c("source"), c("lang")).alias("tokens"))


def cost_micros(spark, sf):
    rows = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c("l_quantity").cast("int").alias("qty"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", numbers.cost_micros(c("l_partkey"), c("l_suppkey"), c("qty")).alias("micros"))


ROLES = (
    "CASE user_id % 3 WHEN 0 THEN CAST(array() AS array<struct<title:string,`group`:string,weight:int>>) WHEN 1 THEN array(named_struct('title', 'CTO', 'group', '', 'weight', 8)) "
    "ELSE array(named_struct('title', 'CTO', 'group', 'Exec', 'weight', 8), named_struct('title', 'VP', 'group', '', 'weight', 5)) END"
)
SKILLS = "array(named_struct('name', 'Spark', 'preference', CASE WHEN user_id % 2 = 0 THEN 'Required' ELSE 'Preferred' END), named_struct('name', 'SQL', 'preference', CASE WHEN user_id % 4 < 2 THEN 'Required' ELSE 'Neutral' END))"


def target_text(spark, sf):
    profiles = view(spark, sf, "v_profiles")
    prefs = view(spark, sf, "v_prefs").select("user_id", "work_types", "included_locations", "countries", c("seniority_levels").alias("seniority"))
    rows = profiles.join(prefs, "user_id").withColumns({"target_roles": F.expr(ROLES), "pref_skills": F.expr(SKILLS)})
    profile = {n: c(n) for n in ("current_role", "years_experience", "skills", "industries", "leadership_experience", "management_experience", "summary")}
    wanted = {n: c(n) for n in ("target_roles", "work_types", "seniority", "included_locations", "countries")}
    built = labels.target_text(profile, {**wanted, "skills": c("pref_skills"), "industries": F.slice("industries", 2, 1)})
    return rows.select("user_id", built.alias("t")).select("user_id", *hashed(c("t")))


def _listed(x: str, empty: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN array_to_string({x}, ', ') ELSE {q(empty)} END"


def _stated(x: str) -> str:
    return f"CASE WHEN {x} <> '' THEN {x} ELSE 'Not specified' END"


TARGET_SQL = "concat_ws(chr(10), " + ", ".join([
    "concat('Target roles: ', CASE user_id % 3 WHEN 0 THEN 'Not specified' WHEN 1 THEN 'CTO (8/10)' ELSE 'CTO (Exec/10); VP (5/10)' END)",
    f"concat('Current role: ', {_stated('current_role')})",
    "concat('Years of experience: ', years_experience)",
    f"concat('Skills: ', {_listed('skills', 'Not specified')})",
    f"concat('Industries: ', {_listed('industries', 'Not specified')})",
    f"concat('Leadership: ', {_stated('leadership_experience')})",
    f"concat('Management: ', {_stated('management_experience')})",
    f"concat('Preferred work arrangement: ', {_listed('work_types', 'Not specified')})",
    f"concat('Preferred seniority: ', {_listed('seniority_levels', 'Not specified')})",
    f"concat('Preferred locations: ', {_listed('included_locations', 'Open')})",
    f"concat('Selected countries: ', {_listed('countries', 'All')})",
    f"concat('Preferred industries: ', {_listed('industries[2:2]', 'Open')})",
    "concat('Required skills: ', CASE WHEN user_id % 2 = 0 AND user_id % 4 < 2 THEN 'Spark, SQL' WHEN user_id % 2 = 0 THEN 'Spark' WHEN user_id % 4 < 2 THEN 'SQL' ELSE 'None' END)",
    "'Missing listing values: when a listing does not state work arrangement or seniority, infer it from the description. Do not treat a missing value as a mismatch by itself.'",
    f"concat('Summary: ', {_stated('summary')})",
]) + ")"


def listing_text(spark, sf):
    names = ("title", "company", "location", "work_type", "employment_type", "seniority", "industry", "description")
    rows = view(spark, sf, "v_listings").select("job_id", labels.listing_text(*[c(n) for n in names]).alias("t"))
    return rows.select("job_id", *hashed(c("t")))


LISTING_SQL = (
    "concat_ws(chr(10), concat('Title: ', title), concat('Company: ', company), concat('Location: ', CASE WHEN location = '' THEN 'Unknown' ELSE location END), "
    "concat('Work: ', work_type, CASE WHEN work_type = 'Unknown' THEN ' (not stated)' ELSE '' END), concat('Employment: ', employment_type), "
    "concat('Seniority: ', seniority, CASE WHEN seniority = 'Unknown' THEN ' (not stated)' ELSE '' END), concat('Industry: ', industry), concat('Description: ', description))"
)


def alert_key(spark, sf):
    rows = view(spark, sf, "v_matches")
    return rows.select("user_id", "job_id", dates.alert_key(c("job_id"), c("score"), c("evaluated_at")).alias("dedupe_key"))


def digest_key(spark, sf):
    rows = view(spark, sf, "events")
    return rows.groupBy(dates.digest_key(c("ts")).alias("dedupe_key")).agg(F.countDistinct("user_id").alias("users"))


def source_identity(spark, sf):
    rows = view(spark, sf, "v_sources")
    return rows.select("source_id", labels.source_identity(c("provider"), c("board"), c("source_url")).alias("identity"))


def external_id(spark, sf):
    rows = view(spark, sf, "v_listings").selectExpr("job_id", "CASE job_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN concat(' id', job_id) ELSE CAST(job_id AS STRING) END AS raw", "job_url")
    return rows.select("job_id", labels.external_id(c("raw"), c("job_url")).alias("external_id"))


def redact_url(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", "CASE WHEN page_id % 5 = 0 THEN concat('junk ', page_id) ELSE url END AS raw")
    return rows.select("page_id", urls.redact_url(c("raw")).alias("shown"))


def alert_text(spark, sf):
    rows = reports.scored_join(view(spark, sf, "v_matches"), view(spark, sf, "v_listings"))
    return rows.select(
        "user_id", "job_id", labels.alert_title(c("score"), c("title")).alias("title"),
        labels.alert_body(c("company"), c("location"), c("score"), c("reason")).alias("body"),
    )


QUERIES = {f.__name__: f for f in (
    html_to_text, strip_element, decode_entities, iso_date, salary_int, salary_range, salary_lenient, currency_of, period_of, employment_class,
    work_class, canonical_url, content_hash, keyword_text, company_key, registrable_domain, json_pointer, match_band, next_slot, approx_tokens,
    cost_micros, target_text, listing_text, alert_key, digest_key, source_identity, external_id, redact_url, alert_text,
)}

OTHER = "CASE WHEN l_partkey > 0 THEN l_partkey * 7 END"
CANON_KEPT = (
    "list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(raw, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_|ref$|source$)')), "
    "lambda p, i: {'k': split_part(p, '=', 1), 'i': i, 'p': p})), lambda s: s.p)"
)

ORACLE = {
    "html_to_text": f"SELECT page_id, {hashed_sql('t')} FROM (SELECT page_id, {H('html')} AS t FROM pages)",
    "strip_element": f"SELECT page_id, {hashed_sql('t')} FROM (SELECT page_id, {duck.strip_element(TRICKY, 'script')} AS t FROM pages)",
    "decode_entities": f"SELECT doc_id, {hashed_sql('t')} FROM (SELECT doc_id, {duck.decode_entities(ENTITIES)} AS t FROM documents)",
    "iso_date": "SELECT o_orderkey, raw, CAST(millis AS BIGINT) AS millis FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(strftime(o_orderdate, '%Y-%m-%d'), 'T05:06:07.250Z') "
        "WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'soon' WHEN 3 THEN concat('Mon, ', strftime(o_orderdate, '%d %b %Y'), ' 22:00:00 +0200') WHEN 4 THEN '' ELSE concat(strftime(o_orderdate, '%Y-%m-%d'), 'T23:30:00-01:00') END AS raw, "
        "CASE o_orderkey % 6 WHEN 0 THEN epoch_ms(date_trunc('day', o_orderdate)) + 18367250 WHEN 1 THEN epoch_ms(date_trunc('day', o_orderdate)) WHEN 3 THEN epoch_ms(date_trunc('day', o_orderdate)) + 72000000 "
        "WHEN 5 THEN epoch_ms(date_trunc('day', o_orderdate)) + 88200000 END AS millis FROM orders)",
    "salary_int": f"SELECT {ROW}, {INT_SQL} AS salary FROM lineitem",
    "salary_range": f"SELECT {ROW}, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE a END AS salary_min, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) ELSE b END AS salary_max FROM (SELECT *, {INT_SQL} AS a, {OTHER} AS b FROM lineitem)",
    "salary_lenient": f"SELECT {ROW}, CASE l_linenumber % 7 WHEN 0 THEN {N} + 1 WHEN 1 THEN {N} WHEN 2 THEN {N} * 100 + 60 WHEN 3 THEN 0 WHEN 4 THEN {N} WHEN 5 THEN {N} * 100000 END AS salary FROM lineitem",
    "currency_of": sql("v_feed", "SELECT CASE WHEN cur IN ('CAD','USD','EUR','GBP') THEN cur ELSE 'Unknown' END AS currency, cur, count(*) AS listings FROM v_feed GROUP BY ALL"),
    "period_of": f"SELECT word, code, CASE WHEN regexp_matches(lower(word), 'year|annual') THEN 'year' WHEN lower(word) LIKE '%hour%' THEN 'hour' WHEN lower(word) LIKE '%month%' THEN 'month' WHEN lower(word) LIKE '%week%' THEN 'week' WHEN lower(word) LIKE '%day%' THEN 'day' ELSE 'unknown' END AS by_word, "
        "CASE WHEN upper(word) IN ('YEAR','MONTH','WEEK','DAY','HOUR') THEN lower(word) ELSE 'unknown' END AS by_unit, CASE upper(trim(code)) WHEN 'PA' THEN 'year' WHEN 'PH' THEN 'hour' WHEN 'PM' THEN 'month' WHEN 'PW' THEN 'week' WHEN 'PD' THEN 'day' ELSE 'unknown' END AS by_code, "
        f"count(*) AS items FROM (SELECT {WORDS} AS word, {CODES} AS code FROM lineitem) GROUP BY ALL",
    "employment_class": f"WITH k AS (SELECT {KINDS} AS kind, l_orderkey % 10 AS i FROM lineitem) SELECT kind, provider, employment, count(*) AS items FROM (" + " UNION ALL ".join(_rules_sql(p) for p in KIND_PROVIDERS) + ") GROUP BY ALL",
    "work_class": sql("v_listings", "SELECT job_id, CASE WHEN regexp_matches(lower(concat(title, ' ', location)), 'remote|work from home') THEN 'Remote' WHEN location <> '' THEN 'On-site' ELSE 'Unknown' END AS work FROM v_listings"),
    "canonical_url": f"SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN concat(regexp_extract(raw, '^([^?#]*)', 1), CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END) END AS canonical FROM (SELECT *, {CANON_KEPT} AS kept FROM (SELECT page_id, CASE WHEN instr(url, '#') > 0 THEN url ELSE {URLS} END AS raw FROM pages))",
    "content_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "keyword_text": sql("v_listings", f"SELECT job_id, {hashed_sql('t')} FROM (SELECT job_id, {duck.normalized(chr(99) + 'oncat(title, chr(32), company, chr(32), description)')} AS t FROM v_listings)"),
    "company_key": "SELECT s_suppkey, concat(lower(s_name), ' inc') AS key FROM supplier",
    "registrable_domain": f"SELECT page_id, host, CASE page_id % 8 WHEN 0 THEN 'acme.co.uk' WHEN 3 THEN concat('acme', page_id, '.com') WHEN 6 THEN two WHEN 7 THEN two END AS domain FROM (SELECT page_id, host, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM (SELECT page_id, {HOSTS} AS host FROM pages))",
    "json_pointer": f"SELECT doc_id, pointer, CASE pointer WHEN '/a~1b/0' THEN source WHEN '/m~0n' THEN lang WHEN '/list/1/name' THEN source WHEN '/obj/2' THEN lang WHEN '/num' THEN CAST(n_chars AS VARCHAR) ELSE '' END AS found FROM (SELECT *, {POINTERS} AS pointer FROM documents)",
    "match_band": sql("v_matches", f"SELECT score, {duck.band('score')} AS band, count(*) AS matches FROM v_matches GROUP BY ALL"),
    "next_slot": f"SELECT event_id, CASE {SCHEDULES} WHEN 'Hourly' THEN (s // 3600) * 3600 + 3600 WHEN 'Every 4 hours' THEN (s // 14400) * 14400 + 14400 WHEN 'Twice daily' THEN (s // 43200) * 43200 + 43200 WHEN 'Daily' THEN (s // 86400) * 86400 + 86400 END AS next_s FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)",
    "approx_tokens": "SELECT doc_id, (length(text) + length(source) + length(lang) + 2 + 3) // 4 AS tokens FROM documents",
    "cost_micros": "SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey * 75 + l_suppkey * 450 + CAST(l_quantity AS BIGINT) * 2 + 99) // 100 AS micros FROM lineitem",
    "target_text": sql("v_profiles v_prefs", f"SELECT user_id, {hashed_sql('t')} FROM (SELECT user_id, {TARGET_SQL} AS t FROM v_profiles JOIN (SELECT user_id, work_types, seniority_levels, included_locations, countries FROM v_prefs) USING (user_id))"),
    "listing_text": sql("v_listings", f"SELECT job_id, {hashed_sql('t')} FROM (SELECT job_id, {LISTING_SQL} AS t FROM v_listings)"),
    "alert_key": sql("v_matches", "SELECT user_id, job_id, concat('match:', job_id, ':', score, ':', epoch_ms(evaluated_at)) AS dedupe_key FROM v_matches"),
    "digest_key": "SELECT concat('digest:', strftime(ts, '%Y-%m-%d'), ':', hour(ts)) AS dedupe_key, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "source_identity": sql("v_sources", "SELECT source_id, CASE WHEN provider = 'JSON-LD' AND source_url IS NOT NULL THEN concat('https://site', source_id, '.example.com/jobs?b=2&z=1') WHEN provider IN ('Jobicy','Remotive','TheMuse') THEN concat(provider, ':', lower(provider)) ELSE concat(provider, ':', board) END AS identity FROM v_sources"),
    "external_id": sql("v_listings", "SELECT job_id, CASE job_id % 4 WHEN 2 THEN concat('id', job_id) WHEN 3 THEN CAST(job_id AS VARCHAR) ELSE job_url END AS external_id FROM v_listings"),
    "redact_url": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '[unparseable url]' ELSE regexp_extract(url, '^([^?#]*)', 1) END AS shown FROM pages",
    "alert_text": sql("v_matches v_listings", f"SELECT m.user_id, m.job_id, concat({duck.band('score')}, ': ', title) AS title, concat(company, CASE WHEN location <> '' THEN concat(' · ', location) ELSE '' END, ' scored ', score, '/100. ', reason) AS body FROM v_matches m JOIN v_listings l ON l.job_id = m.job_id WHERE NOT archived"),
}
