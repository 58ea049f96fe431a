"""Structured postings, saved responses, seed lists, landed documents and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingspark.functions import labels
from listingspark.operators import merge, pages as page_ops
from listingspark.session import working_folder
from listingspark.sources import bronze, registry, seeds, structured
from listingspark.sources.tables import BatchTable

from . import duck
from .feeds import COMPANY, OUTPUT, payloads, shown
from .views import pick, sql, view

H, q = duck.html_to_text, duck.q

POSTING_BASE = (
    "to_json(named_struct('@type', 'JobPosting', 'title', concat('Role ', n % 97, CASE WHEN n % 9 = 0 THEN ' remote' ELSE '' END), "
    "'description', concat('<p>', clean, '</p>'), 'url', {url}, 'datePosted', posted, "
    "'hiringOrganization', CASE WHEN n % 3 <> 0 THEN named_struct('name', concat('Org ', n % 7)) END, "
    "'jobLocationType', CASE WHEN n % 6 = 0 THEN 'TELECOMMUTE' END))"
)
POSTING_EXTRA = (
    """concat(CASE n % 4 WHEN 0 THEN concat(',"identifier":"ID-', n, '"') WHEN 1 THEN concat(',"identifier":', n) WHEN 2 THEN concat(',"identifier":{"value":"V-', n, '"}') ELSE ',"identifier":"  "' END, """
    """CASE n % 3 WHEN 0 THEN ',"employmentType":["CONTRACTOR","OTHER"]' WHEN 1 THEN ',"employmentType":"PART_TIME"' ELSE '' END, """
    """CASE n % 2 WHEN 0 THEN ',"jobLocation":{"address":{"addressLocality":"Oslo","addressRegion":"Viken","addressCountry":"NO"}}' ELSE ',"jobLocation":[{"address":{"addressLocality":"Rome","addressCountry":{"name":"Italy"}}},{"address":{}}]' END, """
    """CASE n % 5 WHEN 0 THEN ',"applicantLocationRequirements":[{"name":"Canada"},{"name":"USA"}]' WHEN 1 THEN ',"applicantLocationRequirements":{"name":"Spain"}' ELSE '' END, """
    """CASE n % 4 WHEN 0 THEN ',"baseSalary":{"currency":"eur","value":{"minValue":"50,000","maxValue":60000.4,"unitText":"YEAR"}}' WHEN 1 THEN ',"baseSalary":{"currency":"XXX","value":{"value":"Competitive","unitText":"HOUR"}}' WHEN 2 THEN concat(',"baseSalary":{"currency":"USD","value":{"value":', lo, ',"unitText":"month"}}') ELSE '' END)"""
)
PAGE_HTML = (
    """CASE n % 4 WHEN 0 THEN concat('<html><script type="application/ld+json">', p, '</script><h1>x</h1></html>') """
    """WHEN 1 THEN concat('<script type="application/ld+json">{oops</script><p>mid</p><script type="application/ld+json">[', p, ',{"@type":"Thing"}]</script>') """
    """WHEN 2 THEN concat('<script id="g" type="application/ld+json">{"@graph":[{"@type":"Organization"},', p, ']}</script>') """
    """ELSE concat('<SCRIPT TYPE=''application/ld+json''>{"@type":"JobPosting","title":5}</SCRIPT><script>var a="</b>";</script><script type="application/ld+json">', p, '</script>') END"""
)


def jsonld_pages(spark: SparkSession, sf: str, url: str = "url", page_url: str = "concat('https://careers.example.com/', n)") -> DataFrame:
    """Pages with one valid structured posting each, in a single block, an array, a graph, or next to broken ones."""
    feed = view(spark, sf, "v_feed").withColumn("b", F.expr(POSTING_BASE.format(url=url)))
    made = feed.withColumn("p", F.expr(f"concat(substr(b, 1, length(b) - 1), {POSTING_EXTRA}, '}}')"))
    return made.selectExpr("n AS page_id", f"{page_url} AS url", f"{PAGE_HTML} AS html", "source_id", "board", "company", "n", "posted", "clean")


_JSONLD = {
    "external_id": "CASE n % 4 WHEN 0 THEN concat('ID-', n) WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN concat('V-', n) ELSE {url} END",
    "title": "concat('Role ', n % 97, CASE WHEN n % 9 = 0 THEN ' remote' ELSE '' END)",
    "company": f"CASE WHEN n % 3 <> 0 THEN concat('Org ', n % 7) ELSE {COMPANY} END",
    "description": duck.trim_all("regexp_replace(clean, ' {2,}', ' ', 'g')"),
    "location": "concat(CASE WHEN n % 2 = 0 THEN 'Oslo, Viken' ELSE 'Rome' END, CASE n % 5 WHEN 0 THEN ' · Applicants: Canada, USA' WHEN 1 THEN ' · Applicants: Spain' ELSE '' END)",
    "country": "CASE WHEN n % 2 = 0 THEN 'NO' ELSE 'Italy' END",
    "industry": "''",
    "employment_type": "CASE n % 3 WHEN 0 THEN 'Contract' WHEN 1 THEN 'Temporary' ELSE 'Unknown' END",
    "seniority": "'Unknown'",
    "work_type": "CASE WHEN n % 6 = 0 OR n % 9 = 0 OR lower(clean) LIKE '%remote%' THEN 'Remote' ELSE 'Unknown' END",
    "salary_min": "CASE n % 4 WHEN 0 THEN 50000 WHEN 2 THEN lo END",
    "salary_max": "CASE n % 4 WHEN 0 THEN 60000 WHEN 2 THEN lo END",
    "salary_period": "CASE n % 4 WHEN 0 THEN 'year' WHEN 1 THEN 'hour' WHEN 2 THEN 'month' ELSE 'unknown' END",
    "currency": "CASE n % 4 WHEN 0 THEN 'EUR' WHEN 2 THEN 'USD' ELSE 'Unknown' END",
    "job_url": "{url}",
    "posted_at": "replace(replace(posted, 'T', ' '), 'Z', '')",
}


def _contract_sql(columns: dict[str, str], source: str, *ctes: str, views: str = "v_feed", extra: str = "") -> str:
    made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    picked = ", ".join({
        "description_hash": "sha256(description) AS description_hash", "violations": f"{duck.violations()} AS violations",
        "salary_min": "CAST(salary_min AS BIGINT) AS salary_min", "salary_max": "CAST(salary_max AS BIGINT) AS salary_max",
    }.get(c, c) for c in OUTPUT)
    return sql(views, f"SELECT {extra}{picked} FROM made", *ctes, f"made AS (SELECT {extra}{made} FROM {source})")


def norm_jsonld(spark, sf):
    return shown(structured.normalize_jsonld(jsonld_pages(spark, sf)))


CAREERS_URL = (
    "CASE WHEN n % 7 = 0 THEN concat('https://other.example.net/x', n) WHEN n % 11 = 0 THEN concat('https://jobs.lever.co/acme/', n) "
    "WHEN n % 2 = 0 THEN concat('/p/', n) ELSE concat('https://acme', n % 5, '.com/q/', n) END"
)
CAREERS_ABS = (
    "CASE WHEN n % 11 = 0 THEN concat('https://jobs.lever.co/acme/', n) WHEN n % 2 = 0 THEN concat('https://careers.acme', n % 5, '.com/p/', n) "
    "ELSE concat('https://acme', n % 5, '.com/q/', n) END"
)


def norm_careers(spark, sf):
    pages = jsonld_pages(spark, sf, CAREERS_URL, "concat('https://careers.acme', n % 5, '.com/list/', n)")
    pages = pages.withColumns({"source_id": F.expr("n % 5"), "start_url": F.expr("concat('https://www.acme', n % 5, '.com/careers')")})
    return shown(structured.normalize_careers(pages))


ITEM = (
    "CASE WHEN s % 5 = 0 THEN to_json(named_struct('a/b', {title}, 'links', named_struct('self', {url}), 'ref', n, 'loc', array(named_struct('city', place)), 'body', clean, 'when', posted)) "
    "ELSE to_json(named_struct('ttl', {title}, 'links', named_struct('self', {url}), 'ref', n, 'loc', array(named_struct('city', place)), 'body', clean, 'when', posted)) END"
)
ITEM_URL = "CASE WHEN n % 5 = 0 THEN concat('http://plain.example.com/', n) ELSE concat('/p/', n, '{mark}') END"


def saved_pages(spark, sf):
    """Landed pages of saved requests: two items a page, some pages empty, postings at one of three places."""
    feed = view(spark, sf, "v_feed").withColumn("s", F.expr("n % 100"))
    first = ITEM.format(title="concat('Role ', n)", url=ITEM_URL.format(mark="a"))
    second = ITEM.format(title="CASE WHEN n % 3 <> 0 THEN concat('Role remote ', n) END", url=ITEM_URL.format(mark="b"))
    items = f"CASE WHEN n % 70 = 33 THEN '[]' ELSE concat('[', {first}, ',', {second}, ']') END"
    wrapped = feed.withColumn("i", F.expr(items))
    payload = """CASE s % 3 WHEN 0 THEN i WHEN 1 THEN concat('{"data":{"jobs":', i, '}}') ELSE concat('{"items":', i, '}') END"""
    return wrapped.selectExpr("s AS source_id", "board", "company", "CAST(n DIV 100 + 1 AS INT) AS page_no", f"{payload} AS payload")


def saved_patterns(spark, sf):
    return view(spark, sf, "supplier").selectExpr(
        "s_suppkey AS source_id", "concat('https://api.acme', s_suppkey, '.com/v1?page={page}') AS url_template",
        "CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/data/jobs' ELSE '/items' END AS jobs_path",
        "CASE WHEN s_suppkey % 5 = 0 THEN '/a~1b' ELSE '/ttl' END AS p_title", "'/links/self' AS p_url",
        "CASE WHEN s_suppkey % 2 = 0 THEN '/ref' END AS p_id", "'/loc/0/city' AS p_location", "'/body' AS p_description", "'/when' AS p_posted_at",
    )


SAVED = (
    "saved AS (SELECT *, n % 100 AS s, n // 100 + 1 AS page FROM v_feed JOIN supplier ON s_suppkey = n % 100)",
    "stops AS (SELECT s, min(CASE WHEN n % 70 = 33 THEN page END) AS stop, max(page) AS last_page FROM saved GROUP BY s)",
    "items AS (SELECT saved.*, k, CASE WHEN k = 0 THEN concat('Role ', n) WHEN n % 3 <> 0 THEN concat('Role remote ', n) END AS t, "
    "concat('https://api.acme', s, '.com/p/', n, CASE WHEN k = 0 THEN 'a' ELSE 'b' END) AS u, stop, last_page FROM saved JOIN stops USING (s) CROSS JOIN (VALUES (0), (1)) v(k) "
    "WHERE (stop IS NULL OR page < stop) AND n % 5 <> 0)",
    "usable AS (SELECT * FROM items WHERE t IS NOT NULL)",
)


def norm_field_map(spark, sf):
    return shown(structured.normalize_field_map(saved_pages(spark, sf), saved_patterns(spark, sf)))


def paged_payloads(spark, sf):
    items = structured.captured_items(saved_pages(spark, sf), saved_patterns(spark, sf))
    return structured.replay_status(items).withColumn("items", F.col("items").cast("bigint"))


def norm_crawled(spark, sf):
    rows = page_ops.page_posting(view(spark, sf, "pages")).withColumns({
        "id": F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" c"), F.col("page_id"))), "company": F.lit("Crawl Co"),
        "board": F.lit("b"), "source_id": F.col("page_id") % 10,
    })
    return shown(structured.normalize_crawled(rows))


ARTICLE = r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article', 1)"
HEADING = r"regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1)"
CRAWLED = {
    "external_id": "CASE WHEN page_id % 3 = 0 THEN concat('c', page_id) ELSE canonical END",
    "title": H(HEADING), "company": "'Crawl Co'",
    "description": "CASE WHEN length(body) >= 20 THEN body ELSE concat('No description was captured for this posting. See the original listing at ', url) END",
    "location": "''", "country": "''", "industry": "''", "employment_type": "'Unknown'", "seniority": "'Unknown'",
    "work_type": f"CASE WHEN lower({H(HEADING)}) LIKE '%remote%' THEN 'Remote' ELSE 'Unknown' END",
    "salary_min": "NULL", "salary_max": "NULL", "salary_period": "'unknown'", "currency": "'Unknown'", "job_url": "url", "posted_at": "NULL",
}

# Canonical form of the page URLs: their queries hold only plain characters.
CANONICAL_PAGE = (
    "concat(regexp_extract(url, '^([^?#]*)', 1), CASE WHEN len(kept) > 0 THEN concat('?', array_to_string(kept, '&')) ELSE '' END)"
)
KEPT_PARAMS = (
    "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '(?i)^(utm_|ref$|source$)')))"
)


def bronze_payloads(spark, sf):
    """Landed documents of two formats; some are cut off."""
    feed = view(spark, sf, "v_feed")
    return feed.selectExpr(
        "source_id", "CAST(n AS BIGINT) AS page_no", "CASE WHEN n % 3 = 0 THEN 'xml' ELSE 'json' END AS format",
        "CASE WHEN n % 3 = 0 THEN concat('<rss><t>', clean, CASE WHEN n % 4 = 1 THEN '' ELSE '</t></rss>' END) "
        "ELSE concat('{\"t\":\"', clean, CASE WHEN n % 4 = 1 THEN '' ELSE '\"}' END) END AS payload",
    )


def bronze_status(fmt: str):
    def run(spark, sf):
        rows = bronze_payloads(spark, sf)
        previous = rows.filter("page_no % 5 = 0").select("source_id", "page_no", F.sha2("payload", 256).alias("payload_hash"))
        return bronze.document_status(rows, previous).filter(F.col("format") == fmt).select("source_id", "page_no", "status")

    return run


def bronze_sql(fmt: str) -> str:
    return sql("v_feed", "SELECT source_id, CAST(n AS BIGINT) AS page_no, CASE WHEN n % 4 = 1 THEN 'invalid' WHEN n % 5 = 0 THEN 'unchanged' ELSE 'ok' END AS status "
               f"FROM v_feed WHERE (n % 3 = 0) = {'true' if fmt == 'xml' else 'false'}")


def bad_row_split(spark, sf):
    rows = registry.split_rows(payloads(spark, sf, "TheMuse"), "TheMuse")
    return rows.groupBy("source_id", "page_no", "ordinal", "fate", "reason").agg(F.count("*").alias("items")).select(
        F.col("source_id").cast("bigint").alias("source_id"), F.col("page_no").cast("bigint").alias("page_no"),
        F.col("ordinal").cast("bigint").alias("ordinal"), "fate", "reason", "items",
    )


def scan_pages_view(spark, sf):
    return view(spark, sf, "events").selectExpr(
        "event_id DIV 12 AS run_id", "CAST(event_id % 12 AS INT) + 1 AS page_no", "CAST(floor(value * 8) AS BIGINT) AS jobs",
        "(event_id * 7) % 11 = 3 AS complete", "(event_id * 5) % 13 <> 4 AS has_next", "event_type <> 'error' AS can_mark_removals",
    )


def scan_pages(spark, sf):
    return bronze.scan_summary(scan_pages_view(spark, sf)).withColumn("discovered", F.col("discovered").cast("bigint"))


SCAN_SQL = sql(
    "", "SELECT run_id, count(*) AS pages, CAST(sum(jobs) AS BIGINT) AS discovered, CASE WHEN arg_max(complete, page_no) THEN 'Succeeded' ELSE 'Partial' END AS status, "
    "arg_max(complete, page_no) AND bool_and(allow) AS may_retire, CASE WHEN arg_max(complete, page_no) AND bool_and(allow) THEN '' "
    "WHEN arg_max(complete, page_no) THEN 'This scan cannot prove the complete job inventory. Missing listings are not marked removed.' "
    "WHEN arg_max(has_next, page_no) THEN 'Scan ended before its last page; no removals were marked.' "
    "ELSE 'Source returned an incomplete page without a continuation cursor; no removals were marked.' END AS note "
    "FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.run_id = s.run_id AND b.page_no < s.page_no AND b.stops) GROUP BY run_id",
    "e AS (SELECT event_id // 12 AS run_id, event_id % 12 + 1 AS page_no, CAST(floor(value * 8) AS BIGINT) AS jobs, (event_id * 7) % 11 = 3 AS complete, "
    "(event_id * 5) % 13 <> 4 AS has_next, event_type <> 'error' AS allow FROM events)",
    "s AS (SELECT *, complete OR NOT has_next AS stops FROM e)",
)


def seed_lines(spark, sf):
    """Pasted company lists: one list per eleven suppliers' worth of customers, with every kind of line."""
    return view(spark, sf, "customer").selectExpr(
        "concat('list', c_custkey % 3) AS list_id", "CAST(c_custkey DIV 3 + 1 AS INT) AS line",
        "CASE WHEN c_custkey % 17 = 0 THEN concat('Only Name ', c_custkey) WHEN c_custkey % 19 = 0 THEN '   ' "
        "WHEN c_custkey % 23 = 0 THEN concat(repeat('long', 60), ',site', c_custkey, '.com') "
        "WHEN c_custkey % 5 = 0 THEN concat('\"Acme, ', c_custkey, '\"', chr(9), 'www.site', c_custkey % 400, '.com') "
        "WHEN c_custkey % 5 = 1 THEN concat('http://jobs.site', c_custkey, '.co.uk/careers?x=1#y') "
        "WHEN c_custkey % 5 = 2 THEN concat('Co ', c_custkey, ', site', c_custkey, '.com') "
        "WHEN c_custkey % 5 = 3 THEN concat('10.0.0.', c_custkey % 200, ', Bad ', c_custkey) ELSE concat('SITE', c_custkey, '.org') END AS text",
    )


SEED_CTES = (
    "l AS (SELECT c_custkey AS c, concat('list', c_custkey % 3) AS list_id, CAST(c_custkey // 3 + 1 AS BIGINT) AS line, "
    "CASE WHEN c_custkey % 17 = 0 THEN 'name' WHEN c_custkey % 19 = 0 THEN 'blank' WHEN c_custkey % 23 = 0 THEN 'long' ELSE CAST(c_custkey % 5 AS VARCHAR) END AS kind FROM customer)",
    "p AS (SELECT *, CASE kind WHEN 'long' THEN concat('site', c, '.com') WHEN '0' THEN concat('site', c % 400, '.com') WHEN '1' THEN concat('jobs.site', c, '.co.uk') "
    "WHEN '2' THEN concat('site', c, '.com') WHEN '4' THEN concat('site', c, '.org') END AS domain, "
    "CASE kind WHEN 'name' THEN concat('Only Name ', c) WHEN 'long' THEN repeat('long', 60) WHEN '0' THEN concat('Acme, ', c) WHEN '2' THEN concat('Co ', c) "
    "WHEN '3' THEN concat('10.0.0.', c % 200) ELSE '' END AS name, "
    "CASE kind WHEN '0' THEN concat('https://www.site', c % 400, '.com/') WHEN '1' THEN concat('https://jobs.site', c, '.co.uk/careers?x=1') END AS site FROM l WHERE kind <> 'blank')",
    "t AS (SELECT list_id, domain, min(line) AS taken, row_number() OVER (PARTITION BY list_id ORDER BY min(line)) AS place FROM p WHERE domain IS NOT NULL AND length(name) <= 200 GROUP BY list_id, domain)",
)


def seed_import(spark, sf):
    return seeds.import_seeds(seed_lines(spark, sf)).withColumn("line", F.col("line").cast("bigint"))


SEED_SQL = sql(
    "", "SELECT p.list_id, p.line, CASE WHEN name <> '' THEN name ELSE p.domain END AS name, p.domain, site AS website_url, "
    "CASE WHEN p.domain IS NULL THEN 'No domain found' WHEN p.line = t.taken THEN 'imported' WHEN p.line > t.taken THEN 'Duplicate domain' "
    "ELSE 'Company name or domain is too long' END AS outcome "
    "FROM p LEFT JOIN t ON t.list_id = p.list_id AND t.domain = p.domain",
    *SEED_CTES,
)


def provider_alias(spark, sf):
    names = view(spark, sf, "supplier").selectExpr("s_suppkey", f"concat(' ', upper({pick('remote-ok|wwr|Jsonld|usa-jobs|smart-recruiters|captured-api|monster|Lever', 's_suppkey')}), ' ') AS alias")
    known = labels.provider_name(F.col("alias"))
    return names.select("s_suppkey", known.alias("provider"), known.isNull().alias("unsupported"))


def sink_upsert(spark, sf):
    """Two landings into one table; the second merges over the first."""
    keys = ["owner_id", "canonical_hash"]
    table = BatchTable(spark, working_folder(spark, "sink-upsert"), *keys)
    columns = ["title", "description_hash"]
    def into(base, rows):
        if base is None:
            return rows
        return merge.merge(base, rows, keys, touch=columns).drop("outcome")
    table.upsert(view(spark, sf, "v_stored").select(*keys, *columns), into, 0)
    table.upsert(view(spark, sf, "v_incoming").select(*keys, *columns), into, 1)
    return table.current()


QUERIES = {
    "norm_jsonld": norm_jsonld,
    "norm_careers_jsonld": norm_careers,
    "norm_field_map": norm_field_map,
    "norm_crawled": norm_crawled,
    "bronze_json": bronze_status("json"),
    "bronze_xml": bronze_status("xml"),
    "bad_row_split": bad_row_split,
    "scan_pages": scan_pages,
    "paged_payloads": paged_payloads,
    "seed_import": seed_import,
    "provider_alias": provider_alias,
    "sink_upsert": sink_upsert,
}

ORACLE = {
    "norm_jsonld": _contract_sql({k: v.replace("{url}", "url") for k, v in _JSONLD.items()}, "v_feed"),
    "norm_careers_jsonld": _contract_sql(
        {k: v.replace("{url}", "abs") for k, v in _JSONLD.items()}, "capped",
        f"kept AS (SELECT *, {CAREERS_ABS} AS abs FROM v_feed WHERE n % 7 <> 0)",
        "capped AS (SELECT * FROM kept)",
    ),
    "norm_field_map": _contract_sql({
        "external_id": "CASE WHEN s % 2 = 0 THEN CAST(n AS VARCHAR) ELSE u END", "title": "t",
        "company": COMPANY, "description": f"CASE WHEN length({duck.trim_all('clean')}) >= 20 THEN {duck.trim_all('clean')} ELSE concat('No description was captured for this posting. See the original listing at ', u) END",
        "location": "place", "country": "''", "industry": "''", "employment_type": "'Unknown'", "seniority": "'Unknown'",
        "work_type": "CASE WHEN lower(concat(t, ' ', place)) LIKE '%remote%' THEN 'Remote' ELSE 'Unknown' END", "salary_min": "NULL", "salary_max": "NULL",
        "salary_period": "'unknown'", "currency": "'Unknown'", "job_url": "u", "posted_at": "replace(replace(posted, 'T', ' '), 'Z', '')",
    }, "usable", *SAVED),
    "norm_crawled": _contract_sql(CRAWLED, "(SELECT * FROM c3 WHERE title0 <> '')",
        f"c1 AS (SELECT *, {KEPT_PARAMS} AS kept FROM pages)",
        f"c2 AS (SELECT *, {duck.trim_all(H(ARTICLE))} AS body, {H(HEADING)} AS title0 FROM c1)",
        f"c3 AS (SELECT *, {CANONICAL_PAGE} AS canonical FROM c2)", views=""),
    "bronze_json": bronze_sql("json"),
    "bronze_xml": bronze_sql("xml"),
    "bad_row_split": sql("v_feed",
        "SELECT source_id, CAST(page_no AS BIGINT) AS page_no, ordinal, fate, reason, count(*) AS items FROM ("
        "SELECT source_id, page_no, CAST(0 AS BIGINT) AS ordinal, CASE WHEN reason = '' THEN 'good' ELSE 'failed' END AS fate, reason FROM checked "
        "UNION ALL SELECT source_id, page_no, 1, 'skipped', 'shape' FROM v_feed) GROUP BY ALL",
        f"made AS (SELECT source_id, page_no, {H('title')} AS title, CASE WHEN n % 10 = 0 THEN '' ELSE 'x' END AS company, {H('body')} AS description, place AS location, '' AS country, "
        "dept AS industry, 'Unknown' AS employment_type, 'Unknown' AS seniority, 'Unknown' AS work_type, CAST(NULL AS BIGINT) AS salary_min, CAST(NULL AS BIGINT) AS salary_max, "
        "'unknown' AS salary_period, 'Unknown' AS currency, url AS job_url FROM v_feed)",
        f"checked AS (SELECT *, CASE WHEN company = '' THEN 'no_employer' ELSE {duck.violations()} END AS reason FROM made)"),
    "scan_pages": SCAN_SQL,
    "paged_payloads": sql("v_feed", "SELECT CAST(s AS BIGINT) AS source_id, count(*) AS items, true AS complete FROM usable GROUP BY s", *SAVED),
    "seed_import": SEED_SQL,
    "provider_alias": sql("", "SELECT s_suppkey, p AS provider, p IS NULL AS unsupported FROM (SELECT s_suppkey, ['RemoteOK','WeWorkRemotely','JSON-LD','USAJOBS','SmartRecruiters','CapturedApi',NULL,'Lever'][s_suppkey % 8 + 1] AS p FROM supplier)"),
    "sink_upsert": sql("v_stored v_incoming", "SELECT owner_id, canonical_hash, coalesce(i.title, s.title) AS title, coalesce(i.description_hash, s.description_hash) AS description_hash "
        "FROM v_stored s FULL OUTER JOIN v_incoming i USING (owner_id, canonical_hash)"),
}
