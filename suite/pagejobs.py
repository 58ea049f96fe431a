"""Page, link, robots and payload corpus jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from listingspark.operators import links as link_ops, pages as page_ops, payloads as payload_ops, robots, walk

from . import duck
from .joined import GROUND_SQL, claims, page_paths, robots_files
from .landed import PAGE_HTML, jsonld_pages, saved_pages, saved_patterns  # noqa: F401
from .totals import CAREER_PAGES, HOST_SQL, HOSTS_CTE, RULES_SQL, career_pages
from .views import pick, sql, view

c = F.col
H, q = duck.html_to_text, duck.q


def page_links(spark, sf):
    rows = link_ops.page_links(view(spark, sf, "pages"))
    return rows.select("page_id", c("pos").cast("bigint").alias("pos"), "href", "text")


_A = "(?is)<a\\b[^>]*href=[\"'']([^\"''#]+)[\"''][^>]*>(.*?)</a>"


def encode_path(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN unicode(ch) > 126 OR ch IN (' ', '\"', '<', '>', '`', '{{', '}}') THEN url_encode(ch) ELSE ch END), '')".replace("{{", "{").replace("}}", "}")


LINKS_CTE = (
    f"raw AS (SELECT page_id, {HOST_SQL} AS host, unnest(list_zip(regexp_extract_all(html, '{_A}', 1), regexp_extract_all(html, '{_A}', 2), range(0, len(regexp_extract_all(html, '{_A}', 1))))) AS z FROM pages), "
    "anchors AS (SELECT page_id, host, z[3] AS pos, z[1] AS h, " + duck.collapse("regexp_replace(z[2], '<[^>]+>', ' ', 'g')") + " AS text FROM raw)"
)


def rank_career_links(spark, sf):
    rows = link_ops.rank_career_links(career_pages(spark, sf)).filter(c("score") > 0)
    return rows.select("page_id", "href", c("score").cast("bigint").alias("score"), c("rank").cast("bigint").alias("rank"))


ATS_HTML = (
    "concat(html, CASE page_id % 14 WHEN 0 THEN '<iframe src=\"https://boards.greenhouse.io/embed/job_board?for=acme%20co\"></iframe>' WHEN 1 THEN '<script src=''https://api.lever.co/v0/postings/leverco?mode=json''></script>' "
    "WHEN 2 THEN '<a href=\"https://jobs.ashbyhq.com/ash\">Join</a>' WHEN 3 THEN '<a href=\"https://jobs.lever.co/partner\">our friends</a>' WHEN 4 THEN '<a href=\"https://apply.workable.com/j/ABC\">Apply</a><a href=\"https://wrk.workable.com/x\">Roles</a>' "
    "WHEN 5 THEN '<link href=\"https://per.jobs.personio.de/feed\">' WHEN 6 THEN '<a href=\"https://ats.rippling.com/rip/jobs\">x</a>' WHEN 7 THEN '<a href=\"https://wd.wd5.myworkdayjobs.com/en/careers\">work</a>' "
    "WHEN 8 THEN '<embed src=\"https://jobs.smartrecruiters.com/Smart/1\"><script src=\"https://x.icims.com/a\"></script>' WHEN 9 THEN '<iframe src=\"https://big.icims.com/jobs\">' WHEN 10 THEN '<a href=\"https://tal.taleo.net/c\">openings</a>' "
    "WHEN 11 THEN '<script src=\"https://boards-api.greenhouse.io/v1/boards/deep/jobs\"></script>' WHEN 12 THEN '<a href=\"https://api.ashbyhq.com/posting-api/x\">jobs</a>' ELSE '' END)"
)
CHAIN = "CASE WHEN page_id % 14 = 13 THEN array('not a url', 'https://job-boards.greenhouse.io/chained/') ELSE CAST(array() AS array<string>) END"


def detect_ats(spark, sf):
    pages = view(spark, sf, "pages").selectExpr("page_id", "url", f"{ATS_HTML} AS html", f"{CHAIN} AS chain")
    return link_ops.detect_ats(pages)


ATS_SQL = (
    "SELECT page_id, vendor, board, vendor IN ('Greenhouse','Lever','Ashby','Workable','Personio','SmartRecruiters','Rippling') AS supported FROM (SELECT page_id, "
    "['Greenhouse','Lever','Ashby',NULL,'Workable','Personio','Rippling','Workday','SmartRecruiters','iCIMS','Taleo','Greenhouse',NULL,'Greenhouse'][page_id % 14 + 1] AS vendor, "
    "['acme co','leverco','ash',NULL,'wrk','per','rip','wd','Smart','big','tal','deep',NULL,'chained'][page_id % 14 + 1] AS board FROM pages) WHERE vendor IS NOT NULL"
)

POSTING_HTML = (
    "concat('<base>', html, '<a href=\"/jobs/engineer\">E</a><A HREF=''/x/data-lead-1234?a=1#z''>skip</A><a class=\"j\" href=\"/careers/42/apply?x=1\">A</a><a href=\"/jobs/engineer\">again</a>', "
    "'<a href=\"/careers\">list</a><a href=\"https://jobs.lever.co/acme/positions/9\">L</a><a href=\"https://outside.net/jobs/1\">O</a>', "
    "CASE WHEN page_id % 3 = 0 THEN '<a rel=\"next\" href=\"?page=2\">more</a><a href=\"?page=3\">Next</a>' WHEN page_id % 3 = 1 THEN '<a href=\"?page=9\"> <b>NEXT</b> </a>' ELSE '<a href=\"https://outside.net/p\">next</a>' END)"
)
HTTPS_URL = "regexp_replace(regexp_replace(url, '^http:', 'https:'), '#.*$', '')"


def listing_pages(spark, sf):
    return view(spark, sf, "pages").selectExpr("page_id", f"{HTTPS_URL} AS url", f"{POSTING_HTML} AS html")


def posting_links(spark, sf):
    return link_ops.posting_links(listing_pages(spark, sf)).select("page_id", "href")


def next_page(spark, sf):
    return link_ops.next_page(listing_pages(spark, sf))


def page_posting(spark, sf):
    """Structured pages and plain ones."""
    structured = jsonld_pages(spark, sf).select((c("page_id") + 1_000_000).alias("page_id"), "url", "html")
    marked = "concat(replace(html, '<article>', '<span id=\"job-location\">Oslo <i>Norway</i></span><article>'))"
    plain = view(spark, sf, "pages").selectExpr("page_id", "url", f"{marked} AS html")
    rows = page_ops.page_posting(structured.unionByName(plain))
    return rows.select("page_id", "title", "location", F.sha2("description", 256).alias("text_hash"), "posted_at", "origin")


BODY_HTML = (
    "CASE page_id % 5 WHEN 0 THEN concat('<div>a</div><div id=\"job-description\"><div>one <div/> two</div><section>', html, '</section><div><div>three</div></div> tail</div><div>after</div>') "
    "WHEN 1 THEN html WHEN 2 THEN replace(replace(html, '<article>', '<p>'), '</article>', '</p>') "
    "WHEN 3 THEN concat('<section data-x-y=''the description box''>short</section>', html) ELSE concat('<div class=\"description\">never closed <div>', html) END"
)


def page_body(spark, sf):
    rows = view(spark, sf, "pages").selectExpr("page_id", f"{BODY_HTML} AS html").select("page_id", page_ops.page_body(c("html")).alias("b"))
    return rows.select("page_id", c("b.tier").cast("bigint").alias("tier"), F.sha2("b.text", 256).alias("text_hash"), F.length("b.text").cast("bigint").alias("n_chars"))


_ARTICLE = "regexp_extract(html, '(?is)<article[^>]*>(.*?)</article', 1)"


def _chrome(x: str) -> str:
    for name in ("nav", "header", "footer"):
        x = f"regexp_replace({x}, '(?is)<{name}[^a-z0-9-].*?</{name}>', ' ', 'g')"
    return x


BODY_SQL = (
    "SELECT page_id, tier, sha256(t) AS text_hash, length(t) AS n_chars FROM (SELECT page_id, CAST(CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 ELSE 2 END AS BIGINT) AS tier, CASE page_id % 5 "
    f"WHEN 0 THEN {H(chr(99) + 'oncat(' + q('<div>one <div/> two</div><section>') + ', html, ' + q('</section><div><div>three</div></div> tail') + ')')} "
    f"WHEN 2 THEN {H(_chrome(chr(114) + 'eplace(replace(html, ' + q('<article>') + ', ' + q('<p>') + '), ' + q('</article>') + ', ' + q('</p>') + ')'))} WHEN 3 THEN 'short' ELSE {H(_ARTICLE)} END AS t FROM pages)"
)


def jsonld_postings(spark, sf):
    rows = page_ops.jsonld_postings(jsonld_pages(spark, sf))
    return rows.select("page_id", c("pos").cast("bigint").alias("pos"), F.try_variant_get("item", "$.title", "string").alias("title"), F.try_variant_get("item", "$.url", "string").alias("posting_url"))


WORD_LINKS = "array_join(transform(filter(split(clean, ' '), w -> w <> ''), w -> concat('<a href=\"/', w, '\">', w, '</a>')), '<br>')"


def page_evidence(spark, sf):
    """Every document as a page of links, one per word."""
    pages = view(spark, sf, "v_feed").selectExpr("n AS page_id", "'https://words.example.com/list' AS url", f"{WORD_LINKS} AS html")
    rows = link_ops.page_evidence(pages)
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.max("running_length").alias("total_length"), F.max_by("text", "n").alias("last_text"))


EVIDENCE_SQL = (
    "SELECT page_id, count(*) AS links, CAST(max(total) AS BIGINT) AS total_length, arg_max(w, i) AS last_text FROM (SELECT page_id, i, w, sum(30 - 8 + 4 + length(w) + length(w)) OVER (PARTITION BY page_id ORDER BY i) AS total FROM ("
    "SELECT n AS page_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT n, list_filter(string_split(clean, ' '), lambda w: w <> '') AS ws FROM v_feed))) GROUP BY 1"
)


def claim_grounding(spark, sf):
    rows = link_ops.claims_grounded(claims(spark, sf), view(spark, sf, "pages"))
    return rows.groupBy("grounded").agg(F.count("*").alias("pages"), F.sum("unsupported").cast("bigint").alias("unsupported"))


POST2 = """concat('{"title":"T ', n, '","applyUrl":"https://x/', n, '"}')"""
NESTED = (
    f"""CASE n % 6 WHEN 0 THEN concat('[', {POST2}, ',', {POST2}, ']') WHEN 1 THEN concat('{{"meta":{{"names":["a","b"]}},"data":{{"jobs":[', {POST2}, ',', {POST2}, ']}}}}') """
    f"""WHEN 2 THEN concat('{{"one":[', {POST2}, '],"a/b~c":{{"list":[', {POST2}, ',', {POST2}, ']}},"later":[', {POST2}, ',', {POST2}, ']}}') WHEN 3 THEN concat('{{"jobs":[', {POST2}, ',{{"title":"no link"}}]}}') """
    f"""WHEN 4 THEN concat('{{"jobs":[', {POST2}) ELSE concat(repeat('{{"d":', 120), '[', {POST2}, ',', {POST2}, ']', repeat('}}', 120)) END"""
)


def find_listing_array(spark, sf):
    rows = view(spark, sf, "v_feed").selectExpr("n AS payload_id", f"{NESTED} AS payload")
    return payload_ops.find_listing_array(rows)


SAMPLES = (
    """CASE n % 5 WHEN 0 THEN concat('{"id":', n, ',"jobTitle":"x","absolute_url":"u","location":{"zip":"1","city":"Oslo","name":"n"},"content":"b","created_at":"t"}') """
    """WHEN 1 THEN '{"name":"x","title":{"t":1},"href":"u","office":"o","body":5}' WHEN 2 THEN '{"title":"x","location":["a"]}' WHEN 3 THEN '{"Role":"x","LINK":"u","city":{"text":"z"},"slug":true,"reqId":"r"}' """
    """ELSE '{"position":null,"positionName":"p","url":"u","locationName":{"other":1},"location_name":"L","updatedAt":"t","publishedAt":"s"}' END"""
)


def infer_field_map(spark, sf):
    rows = view(spark, sf, "v_feed").selectExpr("n AS payload_id", f"{SAMPLES} AS sample")
    return payload_ops.infer_field_map(rows)


BODIES = """CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"q":"x","pageIndex":3,"page":1}' WHEN 2 THEN 'page=1&q=2' WHEN 3 THEN '{"q":1}' ELSE '[1,2]' END"""


def page_template(spark, sf):
    requests = view(spark, sf, "pages").selectExpr("page_id AS request_id", f"{HTTPS_URL} AS url", f"{BODIES} AS body", "map('Accept', 'a', 'Cookie', 'c', 'Content-Type', 'j') AS headers")
    rows = payload_ops.page_template(requests)
    return rows.select("request_id", "url_template", "body", "usable", F.array_join(F.map_keys("headers"), ",").alias("headers"))


def verify_field_map(spark, sf):
    checked = payload_ops.verify_field_map(saved_pages(spark, sf), saved_patterns(spark, sf))
    return checked.groupBy("source_id", "ok", "reason").agg(F.count("*").alias("payloads"), F.sum("postings").cast("bigint").alias("postings"))


def robots_rules(spark, sf):
    rows = robots.robots_rules(robots_files(spark, sf))
    return rows.select("host", "agent", "allow", "path")


def robots_verdict(spark, sf):
    rules = robots.robots_rules(robots_files(spark, sf))
    return robots.robots_verdict(page_paths(spark, sf), rules, "PoliteBot").select("page_id", "allowed", "matched_rule")


BUDGET = dict(max_pages=10, max_listings=100)


def _walk(spark, sf):
    """Pages of a site form a tree: page n links to 2n+1 and 2n+2, and back to its parent."""
    pages = view(spark, sf, "pages").selectExpr("page_id % 9 AS site", "page_id DIV 9 AS k")
    here = F.concat(c("site").cast("string"), F.lit("/"), c("k").cast("string"))

    def to(expr: str, pos: int):
        return F.struct(F.lit(pos).alias("pos"), F.concat(c("site").cast("string"), F.lit("/"), F.expr(expr).cast("string")).alias("href"))

    links = pages.select(here.alias("url"), F.explode(F.array(to("2 * k + 2", 0), to("2 * k + 1", 1), to("(k + 1) DIV 2 - 1", 2))).alias("l")).select("url", "l.pos", "l.href")
    known = pages.select(here.alias("href"))
    starts = pages.filter("k = 0").select(c("site").alias("source_id"), here.alias("url"))
    found = pages.select(here.alias("url"), F.expr("CASE WHEN site % 3 = 0 THEN 30 ELSE k % 5 END").cast("bigint").alias("listings"))
    return walk.link_walk(starts, links.join(known, "href", "left_semi"), found, **BUDGET)


def link_walk(spark, sf):
    return _walk(spark, sf).filter("read").select("source_id", c("place").cast("bigint").alias("place"), "url", c("depth").cast("bigint").alias("depth"), "listings")


def link_walk_summary(spark, sf):
    return walk.walk_summary(_walk(spark, sf), BUDGET["max_listings"])


# Breadth-first order of that tree from page 0: children are read larger number first.
WALK_CTES = (
    "p AS (SELECT page_id % 9 AS site, page_id // 9 AS k FROM pages)",
    "bfs AS (SELECT site, k, 0 AS depth, CAST('' AS VARCHAR) AS path FROM p WHERE k = 0 UNION ALL SELECT p.site, p.k, b.depth + 1, concat(b.path, CASE WHEN p.k = 2 * b.k + 2 THEN 'a' ELSE 'b' END) FROM bfs b JOIN p ON p.site = b.site AND p.k IN (2 * b.k + 1, 2 * b.k + 2))",
    "placed AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, path) AS place, CASE WHEN site % 3 = 0 THEN 30 ELSE k % 5 END AS listings FROM bfs)",
    "reads AS (SELECT *, place <= 10 AND coalesce(sum(listings) OVER (PARTITION BY site ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 100 AS read FROM placed WHERE place <= 11)",
)


def choose_strategy(spark, sf):
    pages = view(spark, sf, "pages").selectExpr("page_id", "url", f"{ATS_HTML} AS html", f"{CHAIN} AS chain")
    structured = view(spark, sf, "pages").filter("page_id % 4 = 1").select("page_id")
    verified = view(spark, sf, "pages").filter("page_id % 6 = 2").select("page_id")
    crawled = page_ops.page_posting(view(spark, sf, "pages").filter("page_id % 5 <> 0")).select("page_id")
    return walk.choose_strategy(pages.select("page_id"), link_ops.detect_ats(pages), structured, verified, crawled)


QUERIES = {f.__name__: f for f in (
    page_links, rank_career_links, detect_ats, posting_links, next_page, page_posting, page_body, jsonld_postings, page_evidence, claim_grounding,
    find_listing_array, infer_field_map, page_template, verify_field_map, robots_rules, robots_verdict, link_walk, link_walk_summary, choose_strategy,
)}

HEADING = H("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1)")
PAGE_Q = "regexp_extract(url, '\\?([^#]*)', 1)"
HAS_PAGE = f"regexp_matches({PAGE_Q}, '(^|&)page=')"

ORACLE = {
    "page_links": sql("", f"SELECT page_id, CAST(pos AS BIGINT) AS pos, concat('https://', host, {encode_path('h')}) AS href, text FROM anchors", LINKS_CTE),
    "rank_career_links": "SELECT page_id, href, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM (SELECT page_id, CASE WHEN k = 1 THEN concat('https://jobs.lever.co/acme', page_id) WHEN k = 5 THEN 'https://else.example.org/careers' ELSE concat('https://', "
        f"{HOST_SQL}, path) END AS href, CAST(score AS BIGINT) AS score, k AS pos, url FROM pages CROSS JOIN (VALUES (0, '/company/careers', 15), (1, '', 8), (2, '/jobs/', 11), (3, '/blog/jobs', 7), (5, '', 15), (6, '/join-us?x=1', 11)) v(k, path, score)) WHERE pos <> 5 OR {HOST_SQL} LIKE '%.example.org'",
    "detect_ats": ATS_SQL,
    "posting_links": f"SELECT page_id, CASE WHEN k = 3 THEN path ELSE concat('https://', {HOST_SQL}, path) END AS href FROM pages CROSS JOIN (VALUES (0, '/jobs/engineer'), (2, '/careers/42/apply?x=1'), (3, 'https://jobs.lever.co/acme/positions/9')) v(k, path)",
    "next_page": f"SELECT page_id, concat('https://', {HOST_SQL}, regexp_extract(url, '://[^/?#]*([^?#]*)', 1), CASE WHEN page_id % 3 = 0 THEN '?page=2' ELSE '?page=9' END) AS href FROM pages WHERE page_id % 3 < 2 AND NOT (page_id % 3 = 0 AND {HTTPS_URL} LIKE '%?page=2') ",
    "page_posting": sql("v_feed", f"SELECT page_id, {HEADING} AS title, 'Oslo Norway' AS location, sha256({H(_ARTICLE)}) AS text_hash, CAST(NULL AS VARCHAR) AS posted_at, 'markup' AS origin FROM pages WHERE {HEADING} <> '' "
        "UNION ALL SELECT n + 1000000, concat('Role ', n % 97, CASE WHEN n % 9 = 0 THEN ' remote' ELSE '' END), CASE WHEN n % 2 = 0 THEN 'Oslo, Viken, NO' ELSE 'Rome, Italy' END, "
        f"sha256({duck.trim_all(chr(114) + 'egexp_replace(clean, ' + q(' {2,}') + ', ' + q(' ') + ', ' + q('g') + ')')}), posted, 'json-ld' FROM v_feed"),
    "page_body": BODY_SQL,
    "jsonld_postings": sql("v_feed", "SELECT n AS page_id, CAST(CASE n % 4 WHEN 2 THEN 1 WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS pos, concat('Role ', n % 97, CASE WHEN n % 9 = 0 THEN ' remote' ELSE '' END) AS title, url AS posting_url FROM v_feed"),
    "page_evidence": sql("v_feed", EVIDENCE_SQL),
    "claim_grounding": f"SELECT grounded, count(*) AS pages, CAST(sum(unsupported) AS BIGINT) AS unsupported FROM ({GROUND_SQL}) GROUP BY 1",
    "find_listing_array": "SELECT doc_id AS payload_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/data/jobs' WHEN 2 THEN '/a~1b~0c/list' WHEN 5 THEN repeat('/d', 120) END AS jobs_path FROM documents",
    "infer_field_map": "SELECT doc_id AS payload_id, ['/jobTitle','/name',NULL,'/Role','/positionName'][k] AS title, ['/absolute_url','/href',NULL,'/LINK','/url'][k] AS url, ['/id',NULL,NULL,'/reqId',NULL][k] AS id, ['/location/city','/office',NULL,'/city/text','/location_name'][k] AS location, "
        "['/content','/body',NULL,NULL,NULL][k] AS description, ['/created_at',NULL,NULL,NULL,'/updatedAt'][k] AS posted_at FROM (SELECT doc_id, doc_id % 5 + 1 AS k FROM documents)",
    "page_template": f"SELECT page_id AS request_id, CASE WHEN {HAS_PAGE} THEN concat(regexp_extract(u, '^([^?]*)', 1), '?', regexp_replace({PAGE_Q}, '(^|&)page=[^&]*', '\\1page={{page}}')) WHEN page_id % 5 = 2 THEN NULL ELSE u END AS url_template, "
        f"CASE WHEN {HAS_PAGE} THEN {BODIES} WHEN page_id % 5 = 1 THEN '{{\"q\":\"x\",\"pageIndex\":\"{{page}}\",\"page\":1}}' WHEN page_id % 5 = 2 THEN NULL ELSE {BODIES} END AS body, {HAS_PAGE} OR page_id % 5 <> 2 AS usable, 'Accept,Content-Type' AS headers FROM (SELECT *, {HTTPS_URL} AS u FROM pages)".replace("{{page}}", "{page}").replace("'{{", "'{").replace("1}}'", "1}'"),
    "verify_field_map": sql("v_feed", "SELECT source_id, reason IS NULL AS ok, reason, count(*) AS payloads, CAST(sum(CASE WHEN reason IS NULL THEN 2 END) AS BIGINT) AS postings FROM (SELECT n % 100 AS source_id, CASE WHEN n % 70 = 33 THEN 'Replay returned no postings' END AS reason FROM v_feed JOIN supplier ON s_suppkey = n % 100) GROUP BY ALL"),
    "robots_rules": sql("", "SELECT host, agent, allow, path FROM ("
        "SELECT host, '*' AS agent, false AS allow, '/de/' AS path FROM hosts UNION ALL SELECT host, '*', true, '/de/1' FROM hosts WHERE n % 2 = 0 UNION ALL SELECT host, '*', false, '/*8$' FROM hosts "
        "UNION ALL SELECT host, a, allow, path FROM hosts, (VALUES ('politebot'), ('other')) x(a), (VALUES (false, '/fr/'), (true, '/fr/*5'), (false, '/*/2*')) y(allow, path) WHERE n % 3 = 0 "
        "UNION ALL SELECT host, 'last', false, '/' FROM hosts UNION ALL SELECT host, 'lonely', false, '/' FROM hosts WHERE n % 5 = 0)", HOSTS_CTE),
    "robots_verdict": sql("", "SELECT page_id, allowed, CASE WHEN NOT allowed THEN concat('Disallow: ', rule) END AS matched_rule FROM verdict", HOSTS_CTE, RULES_SQL),
    "link_walk": "WITH RECURSIVE " + ", ".join(WALK_CTES) + " SELECT site AS source_id, place, concat(site, '/', k) AS url, CAST(depth AS BIGINT) AS depth, CAST(listings AS BIGINT) AS listings FROM reads WHERE read",
    "link_walk_summary": "WITH RECURSIVE " + ", ".join(WALK_CTES) + " SELECT site AS source_id, count(*) FILTER (WHERE read) AS pages, CAST(least(sum(listings) FILTER (WHERE read), 100) AS BIGINT) AS listings, bool_and(read) AND sum(listings) FILTER (WHERE read) <= 100 AS complete FROM reads GROUP BY 1",
    "choose_strategy": sql("", "SELECT page_id, strategy, CASE strategy WHEN 'ats' THEN vendor WHEN 'captured-api' THEN 'CapturedApi' WHEN 'browser' THEN 'Browser' ELSE 'Careers' END AS provider, vendor AS detected, CASE WHEN strategy = 'ats' THEN board END AS board FROM ("
        f"SELECT p.page_id, vendor, board, CASE WHEN coalesce(supported, false) THEN 'ats' WHEN p.page_id % 4 = 1 THEN 'json-ld' WHEN p.page_id % 6 = 2 THEN 'captured-api' WHEN p.page_id % 5 <> 0 AND {HEADING} <> '' THEN 'browser' ELSE 'ai' END AS strategy FROM pages p LEFT JOIN ats a ON a.page_id = p.page_id)", f"ats AS ({ATS_SQL})"),
}
