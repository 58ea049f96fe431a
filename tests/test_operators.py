from pyspark.sql import Row, functions as F

from listingspark.operators import contracts, gates, links, merge, pages, payloads, reports, robots, scoring, walk
from listingspark.sources import bronze, seeds

KEYWORDS = "title string, company string, description string, inc array<string>, neg array<string>"


def test_keyword_verdict(spark):
    text = "Lead of Platform Engineering with Terraform"
    rows = [
        (["  platform   engineering "], [], True, None), (["", "   "], [], False, ""), (["platform"], ["terraform"], False, "terraform"),
        ([], [], True, None), (["cobol"], [], False, ""), ([], ["zzz", "LEAD"], False, "lead"),
    ]
    df = spark.createDataFrame([(i, inc, neg) for i, (inc, neg, _, _) in enumerate(rows)], "i int, inc array<string>, neg array<string>")
    got = df.select("i", gates.keyword_verdict(F.lit(text.lower()), F.col("inc"), F.col("neg")).alias("g")).orderBy("i").collect()
    assert [(r.g.passed, r.g.keyword) for r in got] == [(p, k) for _, _, p, k in rows]


def test_aggregate_scores(one):
    factors = {f: F.lit(1.0 if f in ("experience", "skills", "leadership") else 0.0) for f in contracts.FACTORS}
    weights = {f: F.lit(w) for f, w in contracts.DEFAULT_WEIGHTS.items()}
    scores = scoring.factor_scores(factors, weights)
    assert one(F.struct(*scores.values())) == Row(*[50, 100, 0])
    only_role = {f: F.lit(100 if f == "role" else 0) for f in contracts.FACTORS}
    assert one(scoring.factor_scores(factors, only_role)["qualification_score"]) is None


def test_contract_rules(one):
    weights = {f: F.lit(w) for f, w in contracts.DEFAULT_WEIGHTS.items()}
    assert one(contracts.weights_violation(weights)) is None
    assert one(contracts.weights_violation({**weights, "role": F.lit(21)})) == "weight_total"
    good = {f: F.lit(0.5) for f in contracts.FACTORS}
    assert one(contracts.factors_violation(good)) is None
    assert one(contracts.factors_violation({**good, "role": F.lit(float("nan"))})) == "factor_range"


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [1.0, 0.0]), ([float("nan"), 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [])],
        "a array<double>, b array<double>",
    )
    assert [r[0] for r in df.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None, None, None, None]


def test_seniority_unknown_passes(spark):
    prefs = spark.createDataFrame([(1, [], True, False, False, False, True, False, [], [], [], ["VP"], None, "CAD")],
        "user_id int, countries array<string>, include_worldwide boolean, include_unknown boolean, hard_location boolean, hard_employment boolean, hard_seniority boolean, "
        "hard_salary boolean, included_locations array<string>, work_types array<string>, employment_types array<string>, seniority_levels array<string>, salary_min int, currency string")
    rows = [(i, 1, "", "", "Remote", "Contract", s, None, "year", "CAD") for i, s in enumerate(["Director", "Unknown", "VP"])]
    listings = spark.createDataFrame(rows, "job_id int, owner_id int, location string, country string, work_type string, employment_type string, seniority string, salary_min int, salary_period string, currency string")
    got = {r.job_id: r.blocked for r in gates.hard_filter(spark, listings, prefs).collect()}
    assert got == {0: gates.BLOCKED_SENIORITY, 1: None, 2: None}


def _listings(spark, rows):
    return spark.createDataFrame(rows, "owner_id int, canonical_hash string, job_id int, title string, description_hash string, last_seen int, lifecycle string, archived boolean, discovered_at int")


def test_merge_listings_and_replay(spark):
    current = _listings(spark, [(1, "a", 1, "A", "h1", 1, "Removed", True, 1), (1, "b", 2, "B", "h2", 1, "Active", False, 1), (1, "c", 3, "C", "h3", 1, "Active", False, 1)])
    incoming = _listings(spark, [(1, "a", 9, "A2", "h1", 5, "Active", False, 5), (1, "b", 9, "B2", "new", 5, "Active", False, 5), (1, "d", 4, "D1", "x", 5, "Active", False, 5), (1, "d", 4, "D2", "x", 5, "Active", False, 5)])
    incoming = incoming.withColumn("ordinal", F.when(F.col("title") == "D2", 2).otherwise(1))
    first = merge.merge_listings(current, incoming)
    got = {r.canonical_hash: r for r in first.collect()}
    assert {k: r.outcome for k, r in got.items()} == {"a": "unchanged", "b": "updated", "c": "missing", "d": "added"}
    assert got["a"].title == "A" and got["a"].archived and got["a"].lifecycle == "Active" and got["a"].discovered_at == 1
    assert got["b"].title == "B2" and got["b"].job_id == 2 and got["d"].title == "D2"
    again = merge.merge_listings(first.drop("outcome"), incoming).collect()
    assert {r.canonical_hash: r.outcome for r in again} == {"a": "unchanged", "b": "unchanged", "c": "missing", "d": "unchanged"}
    assert sorted(r[:-1] for r in again) == sorted(r[:-1] for r in first.collect())


def test_partial_scan_retires_nothing(spark):
    refs = spark.createDataFrame([(1, "a", 1, True), (1, "b", 2, True), (2, "z", 2, True)], "source_id int, external_id string, job_id int, active boolean")
    seen = spark.createDataFrame([(1, "a")], "source_id int, external_id string")

    def after(allowed):
        verdicts = spark.createDataFrame([(1, allowed)], "source_id int, may_retire boolean")
        return merge.retire_missing(refs, seen, verdicts)

    assert after(False).filter("retired").count() == 0
    done = after(True)
    assert [r.external_id for r in done.filter("retired").collect()] == ["b"]
    assert merge.removed_listings(done).count() == 0  # listing 2 is still seen at source 2


def test_alert_replay(spark):
    have = spark.createDataFrame([(1, "k1")], "user_id int, dedupe_key string")
    drafts = spark.createDataFrame([(1, "k1", 5), (1, "k2", 6), (1, "k2", 7)], "user_id int, dedupe_key string, job_id int")
    new = merge.insert_alerts(have, drafts)
    assert new.count() == 1
    assert merge.insert_alerts(have.unionByName(new.select("user_id", "dedupe_key")), drafts).count() == 0


def test_activity_pages_cover_ties(spark):
    rows = spark.range(150).select(F.col("id"), F.lit(1).alias("user_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    first = reports.activity_page(rows, 1, 100).collect()
    last = min(first, key=lambda r: r.id)
    second = reports.activity_page(rows, 1, 100, before=(last.created_at, last.id)).collect()
    assert len(first) == 100 and len({r.id for r in first} | {r.id for r in second}) == 150


ROBOTS = """User-agent: *
Disallow: /
User-agent: alpha
User-agent: beta
Disallow: /internal # staff
Allow: /internal/open
Disallow: /*.pdf$
Disallow:
User-agent: gamma
User-agent: empty
Allow:
"""


def test_robots(spark):
    files = spark.createDataFrame([("h", ROBOTS)], "host string, text string")
    rules = robots.robots_rules(files)
    paths = ["/internal/x", "/internal/open/1", "/a.pdf", "/a.pdfx", "/ok"]
    links_df = spark.createDataFrame([("h", p) for p in paths], "host string, path string")

    def allowed(agent):
        return {r.path: r.allowed for r in robots.robots_verdict(links_df, rules, agent).collect()}

    assert allowed("Beta") == {"/internal/x": False, "/internal/open/1": True, "/a.pdf": False, "/a.pdfx": True, "/ok": True}
    assert not any(allowed("stranger").values())
    assert all(allowed("gamma").values())
    assert all(robots.robots_verdict(links_df.withColumn("host", F.lit("other")), rules, "x").select("allowed").toPandas().allowed)


def test_robots_wildcards_are_linear(spark):
    import time

    df = spark.createDataFrame([("/" + "a*" * 400 + "b", "/" + "a" * 4000)], "rule string, path string")
    start = time.time()
    assert df.select(robots.rule_matches(F.col("rule"), F.col("path"))).first()[0] is False
    assert time.time() - start < 10


def test_robots_content_type(each):
    got = each(lambda c: robots.robots_refusal(c).isNull(), ["text/plain; charset=utf-8", "text/plain-html", "text/html", "", None])
    assert got == [True, False, False, False, False]


def test_seed_list(spark):
    lines = ["﻿company,domain", '"Acme, Inc",acme.com', "Beta\thttps://www.beta.io/jobs#x", ",nonsense", "Acme again,https://acme.com", "x" * 201 + ",long.com", "Long ok,long.com"]
    df = spark.createDataFrame([("l", i + 1, t) for i, t in enumerate(lines)], "list_id string, line int, text string")
    got = {r.line: (r.name, r.domain, r.website_url, r.outcome) for r in seeds.import_seeds(df).collect()}
    assert got == {
        2: ("Acme, Inc", "acme.com", None, "imported"), 3: ("Beta", "beta.io", "https://www.beta.io/jobs", "imported"),
        4: ("", None, None, "No domain found") if got[4][0] == "" else (None, None, None, "No domain found"),
        5: ("Acme again", "acme.com", None, "Duplicate domain"), 6: ("x" * 201, "long.com", None, "Company name or domain is too long"),
        7: ("Long ok", "long.com", None, "imported"),
    }


def test_seed_limit(spark):
    df = spark.range(502).select(F.lit("l").alias("list_id"), (F.col("id") + 1).cast("int").alias("line"), F.concat(F.lit("site"), F.col("id"), F.lit(".com")).alias("text"))
    counts = {r.outcome: r["count"] for r in seeds.import_seeds(df, limit=500).groupBy("outcome").count().collect()}
    assert counts == {"imported": 500, "Import limit is 500 rows": 2}
    assert {r.outcome: r["count"] for r in seeds.import_seeds(df).groupBy("outcome").count().collect()} == {"imported": 502}


def test_first_wins_runs_the_import_limit(spark, tmp_path):
    """The query judges lines past the 500th accepted one as its method names them: repeats first, then the limit."""
    from suite import totals

    spark.range(3, 15_003).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r.list_id, r.outcome): r.lines for r in totals.import_first_wins(spark, str(tmp_path)).collect()}
    for one in ("list0", "list1", "list2"):
        assert got[one, "imported"] == 500 and got[one, "Import limit is 500 rows"] > 1000 and got[one, "Duplicate domain"] > 0
    assert sum(v for (one, _), v in got.items() if one == "list0") == sum(1 for c in range(3, 15_003, 3) if c % 17 == 0 or c % 19)


def test_feeds_are_read_once(spark, tmp_path):
    """All feeds are built from one written view; before, each of them read the documents and cleaned their texts again."""
    from suite import feeds

    spark.range(1, 31).selectExpr("id AS doc_id", "concat('A text of some length, number ', id) AS text", "'en' AS lang", "'Acme' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    rows = feeds.norm_all(spark, str(tmp_path))
    assert not [f for f in rows.inputFiles() if "documents.parquet" in f]


def test_seed_quotes(spark):
    """An empty quoted field is empty, and a quote left open takes the rest of its line."""
    lines = ['"",acme.com', '"Beta, beta.io', '"The ""Gamma"" Co",gamma.com', '"""Delta""",delta.com', '"Eps","eps.com']
    df = spark.createDataFrame([("l", i + 1, t) for i, t in enumerate(lines)], "list_id string, line int, text string")
    got = {r.line: (r.name, r.domain, r.outcome) for r in seeds.import_seeds(df).collect()}
    assert got[1] == ("acme.com", "acme.com", "imported") and got[2][1:] == (None, "No domain found")
    assert [got[i][:2] for i in (3, 4, 5)] == [('The "Gamma" Co', "gamma.com"), ('"Delta"', "delta.com"), ("Eps", "eps.com")]


PAGE = """<html><nav><a href="/x">x</a></nav><h1>Lead &amp; more</h1><span class="job location">Oslo</span>
<div data-kind='the description'><div>One</div><p>Two</p></div><div>After</div>
<a href="/company/careers">Careers</a><a href="/blog/careers-tips">Careers tips</a><a href="https://jobs.lever.co/acme">Open roles</a><a href="https://else.org/careers">Careers</a>
<a href="/jobs/lead-1">Lead</a><a rel="next" href="?page=2">More</a></html>"""


def test_page_extraction(spark):
    df = spark.createDataFrame([(1, "https://acme.com/list", PAGE)], "page_id int, url string, html string")
    ranked = links.rank_career_links(df).orderBy("rank").collect()
    assert [r.href for r in ranked][:1] == ["https://acme.com/company/careers"]
    assert not any("else.org" in r.href for r in ranked) and any("lever.co" in r.href for r in ranked)
    posting = pages.page_posting(df).first()
    assert (posting.title, posting.location, posting.description) == ("Lead & more", "Oslo", "One\nTwo")
    assert [r.href for r in links.posting_links(df).collect()] == ["https://acme.com/jobs/lead-1"]
    assert links.next_page(df).first().href == "https://acme.com/list?page=2"


def test_hostile_pages_stay_linear(spark):
    import time

    size = 8_000_000
    shapes = ["<a", "<div", "<nav", "<script", "<h1>", "<a href='/x'>", "<main>", '<div class="description">']
    df = spark.createDataFrame([(i, "https://acme.com/", s * (size // len(s))) for i, s in enumerate(shapes)], "page_id int, url string, html string")
    df = df.repartition(1).cache()
    df.count()
    for job in (
        lambda one: one.select(pages.page_body(F.col("html"))["tier"], pages.heading_text(F.col("html"))), links.posting_links, links.page_links, pages.jsonld_postings,
    ):
        for i, shape in enumerate(shapes):
            start = time.time()
            job(df.filter(F.col("page_id") == i)).count()
            assert time.time() - start < 15, shape


def test_claims_need_evidence(spark):
    page = spark.createDataFrame([(1, "https://acme.com/", '<p>Lead engineer in Oslo</p><a href="/j/1">go</a>'), (2, "https://acme.com/b", "<p>Other</p>")], "page_id int, url string, html string")
    claims = spark.createDataFrame(
        [(1, "https://acme.com/j/1", "LEAD  engineer", "engineer in oslo", ""), (2, "https://acme.com/b", "other", "other", ""), (2, "https://x.com", "other", "other", "")],
        "page_id int, url string, title string, description string, location string")
    assert {r.page_id: r.grounded for r in links.claims_grounded(claims, page).collect()} == {1: True, 2: False}


def test_field_map(spark):
    df = spark.createDataFrame([(1, '{"title":"x","url":"u","location":{"zip":1,"city":"Oslo"}}'), (2, '{"title":"x"}')], "payload_id int, sample string")
    got = {r.payload_id: (r.title, r.url, r.location) for r in payloads.infer_field_map(df).collect()}
    assert got == {1: ("/title", "/url", "/location/city"), 2: (None, None, None)}


def test_listing_arrays_at_any_depth(spark):
    import json

    jobs = [{"title": "a", "url": "u"}, {"jobTitle": "b", "link": "v", "n": 1}]
    deep = jobs
    for i in range(200):
        deep = {f"k{i}": deep, "x": 1}
    abyss = '{"d":' * 100_000 + json.dumps(jobs) + "}" * 100_000
    cases = {
        "null": None, "text": "not json", "number": "5", "root": json.dumps(jobs), "one": json.dumps(jobs[:1]), "empty": "[]", "deep": json.dumps(deep), "abyss": abyss, "torn": abyss[:-1],
        "order": json.dumps({"z": {"list": jobs}, "a": jobs}), "escaped": json.dumps({"a/b~c": {"": jobs}}), "numbers": json.dumps({"a": [{"title": 1, "url": 2}] * 2, "b": jobs}),
        "mixed": json.dumps({"a": [*jobs, 3]}), "blank": json.dumps([{"title": " ", "url": "u"}] * 2), "inside": json.dumps({"s": json.dumps({"l": jobs}), "o": {"p": jobs}}), "arrays": json.dumps([[jobs]]),
    }
    df = spark.createDataFrame(list(cases.items()), "payload_id string, payload string").repartition(3)
    got = {r.payload_id: r.jobs_path for r in payloads.find_listing_array(df).collect()}
    path = "/" + "/".join(f"k{i}" for i in reversed(range(200)))
    assert got == dict.fromkeys(cases) | {"root": "", "deep": path, "abyss": "/d" * 100_000, "order": "/z/list", "escaped": "/a~1b~0c/", "numbers": "/b", "inside": "/o/p"}
    assert payloads.find_listing_array(df.limit(0)).collect() == []


def test_deep_reader_reads_as_the_usual_one():
    import json
    import random

    rng = random.Random(1)
    make = lambda n: rng.choice([1, -2.5, 'a"b{', "", None, True, [], {}]) if n == 0 else [make(n - 1) for _ in range(rng.randrange(3))] if rng.random() < 0.5 else {f"k{i}": make(n - 1) for i in range(rng.randrange(3))}
    for _ in range(300):
        text = json.dumps(make(4), indent=rng.choice([None, 1]))
        assert payloads._read_deep(text) == json.loads(text)
        torn = list(text)
        torn[rng.randrange(len(torn))] = rng.choice('{}[],:" x')
        torn = "".join(torn)
        try:
            want = json.loads(torn)
        except ValueError:
            want = ValueError
        try:
            got = payloads._read_deep(torn)
        except ValueError:
            got = ValueError
        assert got == want, torn


def test_scan_summary(spark):
    rows = [(1, 1, 10, False, True, True), (1, 2, 5, True, False, True), (2, 1, 4999, False, True, True), (2, 2, 1, False, True, True), (2, 3, 7, True, False, True),
            (3, 1, 3, False, False, True), (4, 1, 3, True, False, False)]
    df = spark.createDataFrame(rows, "run_id int, page_no int, jobs int, complete boolean, has_next boolean, can_mark_removals boolean")
    got = {r.run_id: (r.discovered, r.status, r.may_retire) for r in bronze.scan_summary(df, max_jobs=5000).collect()}
    assert got == {1: (15, "Succeeded", True), 2: (5000, "Partial", False), 3: (3, "Partial", False), 4: (3, "Succeeded", False)}
    unbounded = {r.run_id: (r.discovered, r.status, r.may_retire) for r in bronze.scan_summary(df).collect()}
    assert unbounded == {**got, 2: (5007, "Succeeded", True)}


def test_walk_is_bounded(spark):
    chain = spark.range(30).select(F.concat(F.lit("u"), "id").alias("url"), F.lit(0).alias("pos"), F.concat(F.lit("u"), F.col("id") + 1).alias("href"))
    starts = spark.createDataFrame([(1, "u0")], "source_id int, url string")
    found = spark.createDataFrame([("u0", 1)], "url string, listings int")
    result = walk.walk_summary(walk.link_walk(starts, chain, found, max_pages=10)).first()
    assert (result.pages, result.complete) == (10, False)
    whole = walk.walk_summary(walk.link_walk(starts, chain, found)).first()
    assert (whole.pages, whole.complete) == (31, True)
    short = walk.walk_summary(walk.link_walk(starts, chain.filter("url in ('u0', 'u1')"), found)).first()
    assert (short.pages, short.complete) == (3, True)


def test_pages_are_searched_for_anchors_once(spark):
    html = '<a href="/a">One</a> <a href="/b">Two <b>words</b></a>'
    rows = spark.createDataFrame([(1, "https://x.example.com/list", html), (2, "https://x.example.com/list", "none"), (3, "https://x.example.com/list", None)], "page_id int, url string, html string")
    found = links.page_evidence(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(regexp_extract(html") == 1
    assert [tuple(r) for r in found.orderBy("n").collect()] == [
        (1, 1, "https://x.example.com/a", "One", 25 + 1), (1, 2, "https://x.example.com/b", "Two words", 25 + 1 + 23 + 9 + 0),
    ]


def test_texts_are_trimmed_once(spark):
    from listingspark.sources import registry

    columns = {**registry._defaults(), "title": F.col("t"), "description": F.col("d")}
    rows = spark.createDataFrame([(" \u00a0ab ", "x" * 20 + "\u2003"), ("a ", None)], "t string, d string").select(
        *[c.alias(n) for n, c in columns.items()], F.lit(None).cast("string").alias("problem"))
    checked = registry.finish(rows, "Any")
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("trim(") == 2
    first, second = checked.orderBy(F.desc("title")).collect()
    assert (first.title, first.description, first.violations) == ("ab", "x" * 20, ["company", "job_url"])
    assert (second.title, second.description, second.violations) == ("a", None, ["title", "company", "description", "job_url"])
