import json

from pyspark.sql import Row, functions as F

import listingspark.sources.boards  # noqa: F401
import listingspark.sources.feeds  # noqa: F401
from listingspark.sources import bronze, registry, structured
from listingspark.sources.tables import BatchTable, drop_expired_days

LONG = "A description that is long enough to pass."


def landed(spark, provider, *documents, board="acme", company=""):
    rows = [(1, provider, board, company, i + 1, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "source_id int, provider string, board string, company string, page_no int, payload string")


def test_greenhouse_location_falls_back_to_offices(spark):
    item = {"id": 7, "title": " Lead ", "absolute_url": "https://x.com/7", "content": f"<p>{LONG}</p>", "location": {"name": ""}, "offices": [{"name": "Remote"}, {}, {"name": "Oslo"}]}
    row = registry.normalize(landed(spark, "Greenhouse", {"jobs": [item]}), "Greenhouse").first()
    assert (row.external_id, row.title, row.location, row.work_type, row.company, row.violations) == ("7", "Lead", "Remote; Oslo", "Remote", "acme", [])


def test_remoteok_drops_the_legal_row(spark):
    item = {"id": "9", "slug": "s", "company": "C", "position": "P2", "description": LONG, "url": "", "apply_url": "https://x.com/9", "salary_min": 0, "salary_max": 5}
    rows = registry.normalize(landed(spark, "RemoteOK", [{"legal": "text"}, item, {**item, "apply_url": ""}]), "RemoteOK").collect()
    assert [(r.external_id, r.job_url, r.salary_min, r.salary_max, r.salary_period) for r in rows] == [("9", "https://x.com/9", None, 5, "year")]


def test_adzuna_drops_predicted_pay(spark):
    item = {"id": 1, "title": "T1", "description": LONG, "redirect_url": "https://x.com/1", "company": {"display_name": "C"}, "salary_min": 5, "salary_max": 3, "salary_is_predicted": "1"}
    rows = registry.normalize(landed(spark, "Adzuna", {"results": [item, {**item, "id": 2, "salary_is_predicted": 0}, {**item, "id": 3, "company": None}]}, board="gb"), "Adzuna").orderBy("external_id").collect()
    assert [(r.salary_min, r.salary_max, r.currency, r.violations) for r in rows] == [(None, None, "GBP", []), (3, 5, "GBP", []), (None, None, "GBP", ["no_employer"])]


def test_wwr_needs_a_separator(spark):
    item = "<item><guid>{g}</guid><link>https://x.com/{g}</link><title>{t}</title><description><![CDATA[<p>" + LONG + "</p>]]></description></item>"
    feed = "<rss><channel>" + item.format(g="a", t="Acme: Lead: EU") + item.format(g="b", t="No separator") + "</channel></rss>"
    rows = registry.normalize(landed(spark, "WeWorkRemotely", feed), "WeWorkRemotely").orderBy("external_id").collect()
    assert [(r.company, r.title, r.violations) for r in rows] == [("Acme", "Lead: EU", []), ("", "No separator", ["no_employer"])]


def test_personio_board_must_be_a_subdomain(spark):
    feed = "<workzag-jobs><position><id>1</id><name>Role</name><jobDescriptions><jobDescription><name>Tasks</name><value>" + LONG + "</value></jobDescription></jobDescriptions></position></workzag-jobs>"
    good = registry.normalize(landed(spark, "Personio", feed, board="acme"), "Personio").first()
    bad = registry.normalize(landed(spark, "Personio", feed, board="evil.example.com"), "Personio").first()
    assert good.job_url == "https://acme.jobs.personio.de/job/1" and good.description == f"Tasks\n{LONG}"
    assert bad.violations == ["job_url"]


def test_broken_rows_do_not_stop_a_feed(spark):
    item = {"id": 1, "url": "https://x.com/1", "title": "T1", "company_name": "C", "description": LONG}
    pages = landed(spark, "Remotive", {"jobs": [item, {**item, "title": 5}, {**item, "id": 2, "description": "short"}]}, "{broken")
    fates = sorted((r.fate, r.reason) for r in registry.split_rows(pages, "Remotive").collect())
    assert fates == [("failed", "description"), ("good", ""), ("skipped", "shape")]


def test_custom_provider(spark):
    registry.register_provider(registry.Provider(
        "Custom", registry.json_items("$.rows"), lambda item, ctx: {
            "external_id": registry.text_at(item, "k"), "title": registry.text_at(item, "t"), "company": ctx["board"], "description": registry.text_at(item, "d"), "job_url": F.lit("https://x.com"),
        }, {"k": "SN"},
    ))
    row = registry.normalize(landed(spark, "Custom", {"rows": [{"k": 3, "t": "Tt", "d": LONG}]}), "Custom").first()
    assert (row.external_id, row.provider, row.violations) == ("3", "Custom", [])
    registry._providers.pop("Custom")


def test_jsonld_salary_is_never_invented(spark):
    def page(salary):
        node = {"@type": "JobPosting", "title": "Lead", "description": LONG, "url": "https://x.com/1", "hiringOrganization": {"name": "C"}, "identifier": "  ", "baseSalary": {"value": salary}}
        return f'<script type="application/ld+json">{json.dumps(node)}</script>'

    df = spark.createDataFrame([(1, "https://x.com/", page({"value": "Competitive"})), (2, "https://x.com/", page({"value": 70000.4})), (3, "https://x.com/", page({"minValue": "1,000", "unitText": "MONTH"}))],
                               "page_id int, url string, html string").withColumns({"source_id": F.lit(1), "board": F.lit("b"), "company": F.lit("")})
    rows = structured.normalize_jsonld(df).orderBy("page_no").collect()
    assert [(r.salary_min, r.salary_max, r.salary_period, r.external_id) for r in rows] == [(None, None, "unknown", "https://x.com/1"), (70000, 70000, "unknown", "https://x.com/1"), (1000, None, "month", "https://x.com/1")]


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    items = bronze.read_json_items(spark, str(tmp_path / "a.jsonl"), "id int")
    items = items.cache()
    assert items.filter("_corrupt_record is not null").count() == 1 and items.count() == 3
    (tmp_path / "f.xml").write_text("<rss><item><guid>1</guid></item><item><guid>2</guid></item></rss>")
    assert bronze.read_xml_items(spark, str(tmp_path / "f.xml"), "item", "guid string").count() == 2
    assert bronze.read_documents(spark, str(tmp_path / "f.xml")).first().payload.startswith("<rss>")


def test_a_batch_counts_once_and_only_when_complete(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "t"), "id")
    assert table.current() is None
    (tmp_path / "t" / "batch=0" / "_temporary").mkdir(parents=True)  # the first writer was lost
    assert table.current() is None
    add = lambda base, rows: rows.withColumn("v", F.lit(1)) if base is None else rows.join(base, "id", "left").select("id", (F.coalesce("v", F.lit(0)) + 1).alias("v"))
    table.upsert(spark.range(3), add, 0)
    for _ in range(3):  # a batch that is repeated after a failure
        table.upsert(spark.range(2, 5), add, 1)
    (tmp_path / "t" / "batch=2" / "_temporary").mkdir(parents=True)
    assert sorted(map(tuple, table.current().collect())) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 1)]
    assert sorted(map(tuple, table.current(before=1).collect())) == [(0, 1), (1, 1), (2, 1)]


def test_a_batch_writes_only_the_keys_it_touches(spark, tmp_path):
    from listingspark.streaming import jobs

    table = BatchTable(spark, str(tmp_path / "t"), "id")
    rows = spark.range(100).withColumn("v", F.lit(0))
    table.upsert(rows, jobs.keep_latest(["id"]), 0)
    table.upsert(spark.range(5, 6).withColumn("v", F.lit(1)), jobs.keep_latest(["id"]), 1)
    table.upsert(rows.limit(0), jobs.keep_latest(["id"]), 2)
    assert [tuple(r) for r in table.rows().groupBy("batch").count().orderBy("batch").collect()] == [(0, 100), (1, 1)]
    small = table.compacted(str(tmp_path / "small"))
    for t in (table, small):
        assert sorted(map(tuple, t.current().collect())) == [(i, int(i == 5)) for i in range(100)]
    assert small.rows().count() == 100 and small.rows().first().batch == 1


def test_retention_drops_days_unread(spark):
    rows = spark.sql("SELECT id, timestamp'2024-01-01' + make_dt_interval(0, id * 6) AS at FROM range(20)").withColumn("day", F.to_date("at"))
    rows.write.partitionBy("day").saveAsTable("kept_days")
    try:
        assert drop_expired_days(spark, "kept_days", "day", "at >= timestamp'2024-01-03 09:00:00'", "2024-01-03") == 2
        assert sorted(r.id for r in spark.table("kept_days").collect()) == list(range(10, 20))
        assert [r.partition for r in spark.sql("SHOW PARTITIONS kept_days").collect()] == ["day=2024-01-03", "day=2024-01-04", "day=2024-01-05"]
        assert drop_expired_days(spark, "kept_days", "day", "true", "2025-01-01") == 3 and spark.table("kept_days").count() == 0
    finally:
        spark.sql("DROP TABLE kept_days")
