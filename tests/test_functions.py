import datetime as dt

from pyspark.sql import functions as F

from listingspark.functions import countries, dates, labels, numbers, text, urls

UTC = dt.timezone.utc


def test_html_to_text(each):
    cases = {
        "<p>One</p><p>Two<br/>Three</p>": "One\nTwo\nThree",
        "a<script>x('</p>')</script>b": "a b",
        "<scriptable>kept</scriptable>": "kept",
        "a<SCRIPT type=x>1</Script>b<script>never closed": "a b never closed",
        "R&amp;D &lt;b&gt; &#233;&#xE9; &copy; &nbsp;x": "R&D <b> éé &copy; x",
        "&amp;lt;": "&lt;",
        "plain  text\t here": "plain text here",
        "&#99999999; &#xD800; &bogus": "&#99999999; &#xD800; &bogus",
    }
    assert each(text.html_to_text, list(cases)) == list(cases.values())


def test_hostile_markup_stays_linear(each):
    import time

    size = 1_000_000
    hostile = ["<script" * (size // 7), "<" * size, "<div" * (size // 4), "<nav" * (size // 4), "&" * size, " " * size]
    start = time.time()
    each(text.html_to_text, hostile)
    assert time.time() - start < 20


def test_spaces_are_unicode(one):
    assert one(text.collapse(F.lit(" a  b\n c﻿"))) == "a b c"
    assert one(text.company_key(F.lit("  Acme   INC "))) == "acme inc"


def test_salaries(each):
    raw = ["85500.4", " 85500 ", "$50-60/hr", "85k", "0", "20000000", None, ""]
    assert each(numbers.salary_int, raw) == [85500, 85500, None, None, None, None, None, None]
    assert each(numbers.salary_lenient, ["50,000", "Competitive", "", "USD 12.5"]) == [50000, None, None, 13]


def test_salary_pair_is_ordered(spark):
    low, high = numbers.salary_range(F.lit("90000"), F.lit("70000"))
    assert tuple(spark.range(1).select(low, high).first()) == (70000, 90000)


def test_rounding_is_half_up(each):
    assert each(numbers.round_half_up, [-0.5, 0.5, 2.5, -1.5], "v double") == [0, 1, 3, -1]


def test_cost_and_tokens(one):
    assert one(numbers.cost_micros(F.lit(669), F.lit(260), F.lit(0))) == 1672
    assert one(numbers.cost_micros(F.lit(668), F.lit(225), F.lit(160))) == 1517
    assert one(numbers.approx_tokens(F.lit("abcd"), F.lit("e"))) == 2


def test_next_slot(spark):
    rows = [
        ("Hourly", "2026-09-15 10:20:00", "2026-09-15 11:00:00"),
        ("Twice daily", "2026-09-15 13:00:00", "2026-09-16 00:00:00"),
        ("Hourly", "2026-09-15 11:00:00", "2026-09-15 12:00:00"),
        ("Manual", "2026-09-15 11:00:00", None),
    ]
    df = spark.createDataFrame(rows, "schedule string, at string, want string")
    got = df.select(dates.next_slot(F.col("schedule"), F.col("at").cast("timestamp")).cast("string").alias("g"), "want").collect()
    assert all(r.g == r.want for r in got)


def test_keys(one):
    at = F.lit("2026-09-15 13:45:00").cast("timestamp")
    assert one(dates.digest_key(at)) == "digest:2026-09-15:13"
    assert one(dates.alert_key(F.lit("j"), F.lit(90), F.lit("1970-01-01 00:00:01").cast("timestamp"))) == "match:j:90:1000"


def test_dates(each):
    got = each(lambda c: dates.iso_date(c).cast("string"), ["2024-01-02", "2024-01-02T03:04:05Z", "Mon, 01 Jan 2024 10:00:00 GMT", "soon", ""])
    assert got == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-01 10:00:00", None, None]


def test_bands(each):
    got = each(labels.match_band, [90, 89, 79, 64, 49, 0], "v int")
    assert got == ["Excellent Match", "Strong Match", "Possible Match", "Stretch Opportunity", "Weak Match", "Do Not Apply"]


def test_canonical_url(each):
    cases = {
        "HTTPS://Acme.com:443/a?b=2&utm_source=x&a=1#top": "https://acme.com/a?a=1&b=2",
        "https://acme.com": "https://acme.com/",
        "https://acme.com/?ref=1&SOURCE=2": "https://acme.com/",
        "https://acme.com/x?q=a%20b&q=c&flag": "https://acme.com/x?flag=&q=a+b&q=c",
        "https://acme.com/a/../b/./c": "https://acme.com/b/c",
        "https://acme.com/für": "https://acme.com/f%C3%BCr",
        "referrer=1": None,
        "https://acme.com/?reference=1": "https://acme.com/?reference=1",
    }
    assert each(urls.canonical_url, list(cases)) == list(cases.values())


def test_resolve_url(spark):
    base = "https://acme.com/jobs/list?x=1"
    cases = {
        "/a b": "https://acme.com/a%20b", "b": "https://acme.com/jobs/b", "../c": "https://acme.com/c", "?p=2": "https://acme.com/jobs/list?p=2",
        "//cdn.acme.com/x": "https://cdn.acme.com/x", "mailto:a@b.c": None, "http://o.org/#f": "http://o.org/", "": "https://acme.com/jobs/list?x=1",
    }
    df = spark.createDataFrame([(h, w) for h, w in cases.items()], "h string, w string")
    got = df.select(urls.resolve_url(F.col("h"), urls.url_struct(F.lit(base))).alias("g"), "w", "h").collect()
    assert [(r.h, r.g) for r in got] == [(r.h, r.w) for r in got]


def test_registrable_domain(each):
    cases = {"jobs.acme.co.uk": "acme.co.uk", "localhost": None, "10.0.0.1": None, "WWW.Acme.com.": "acme.com", "co.uk": None, "a..b": None, "ünï.com": None}
    assert each(urls.registrable_domain, list(cases)) == list(cases.values())


def test_url_admission(each):
    cases = {
        "https://acme.com/x": True, "http://acme.com": False, "https://u:p@acme.com": False, "https://acme.com:8443": False, "https://acme.com:443/": True,
        "https://acme.com./": False, "https://localhost/": False, "https://[::1]/": False, "https://127.0.0.1/": False, "nonsense": False,
    }
    assert each(urls.url_admitted, list(cases)) == list(cases.values())


def test_pointers(spark):
    doc = '{"a/b": ["x", {"n~m": 5}], "0": "zero", "o": {"1": "one"}}'
    cases = {"/a~1b/0": "x", "/a~1b/1/n~0m": "5", "/a~1b/9": "", "/0": "zero", "/o/1": "one", "o": "", "/o": ""}
    df = spark.createDataFrame([(p, w) for p, w in cases.items()], "p string, w string").withColumn("d", F.parse_json(F.lit(doc)))
    got = df.select(urls.pointer_text(F.col("d"), F.col("p")).alias("g"), "w").collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_country_coverage(spark):
    cases = [
        ("CA", "Remote, Canada", ["CA"], False), ("", "Remote", [], False), ("", "Anywhere", [], True), ("", "Work worldwide or in France", ["FR"], False),
        ("", "Papua New Guinea", ["GN", "PG"], False), ("US/CA", "", ["CA", "US"], False), ("", "Bissau, Guinea-Bissau", ["GN", "GW"], False), ("", "Austin, CA", [], False),
        ("", "CA", ["CA"], False), ("", "Nigeria", ["NG"], False), ("", "Türkiye", ["TR"], False),
    ]
    df = spark.createDataFrame([(i, c, l) for i, (c, l, _, _) in enumerate(cases)], "i int, country string, location string")
    rows = df.select("i", countries.country_coverage(F.col("country"), F.col("location")).alias("cov")).orderBy("i").collect()
    assert [(list(r.cov.codes), r.cov.worldwide) for r in rows] == [(codes, world) for _, _, codes, world in cases]


def test_europe_and_selection(spark):
    df = spark.createDataFrame([("", "Europe")], "country string, location string")
    cov = countries.country_coverage(F.col("country"), F.col("location"))
    assert {"FR", "GB", "UA"} <= set(df.select(cov["codes"]).first()[0])
    outside = countries.country_match(countries.country_coverage(F.lit("US"), F.lit("")), F.array(F.lit("CA")), F.lit(True), F.lit(True))
    assert df.select(outside).first()[0] is False


def test_every_country_name_is_found(spark):
    names = countries.COUNTRIES
    assert len(names) == 249
    df = spark.createDataFrame(list(names.items()), "code string, name string")
    cov = countries.country_coverage(F.lit(""), F.concat(F.lit("Office in "), F.col("name"), F.lit(" (hybrid)")))
    missing = df.filter(~F.array_contains(cov["codes"], F.col("code"))).collect()
    assert missing == []


def test_listing_text_is_whole_unless_bounded(spark):
    from listingspark.functions import labels

    row = spark.range(1).select(*[F.lit(v).alias(n) for n, v in zip("abcdefgh", ["T", "C", "", "Unknown", "Contract", "VP", "", "d" * 40_000])])
    whole, cut = (row.select(labels.listing_text(*[F.col(n) for n in "abcdefgh"], limit=limit)).first()[0] for limit in (None, 32_000))
    assert len(cut) == 32_000 and whole.startswith(cut) and whole.endswith("d" * 40_000)
    assert whole.startswith("Title: T\nCompany: C\nLocation: Unknown\nWork: Unknown (not stated)\nEmployment: Contract")
