import pytest
from listingspark.functions import gazetteer
from listingspark.operators import places as P

CASES = {
    ("", "Toronto, ON"): [("CA", "ON", "Toronto", False, "city in context")],
    ("", "London, Ontario"): [("CA", "ON", "London", False, "city in context")],
    ("", "London"): [("GB", "ENG", "London", False, "city")],
    ("US", "London"): [("US", "KY", "London", False, "country field")],
    ("", "Tbilisi, Georgia"): [("GE", None, "Tbilisi", False, "city in context")],
    ("", "Atlanta, Georgia"): [("US", "GA", "Atlanta", False, "city in context")],
    ("", "San Francisco, CA"): [("US", "CA", "San Francisco", False, "city in context")],
    ("", "CA"): [("CA", None, None, False, "country")],
    ("", "ON, CA"): [("CA", "ON", None, False, "region in context")],
    ("", "Paris; Madrid, Spain"): [("FR", None, "Paris", False, "city"), ("ES", None, "Madrid", False, "city in context")],
    ("", "Portland, Maine or Portland, OR"): [("US", "ME", "Portland", False, "city in context"), ("US", "OR", "Portland", False, "city in context")],
    ("", "Papua New Guinea"): [("PG", None, None, False, "country")],
    ("", "Bissau, Guinea-Bissau"): [("GW", None, "Bissau", False, "city in context")],
    ("", "St. Thomas, U.S. Virgin Islands"): [("VI", None, None, False, "country")],
    ("", "Remote - Canada"): [("CA", None, None, True, "country")],
    ("", "Remote"): [(None, None, None, True, "remote")],
    ("DE", "Remote"): [("DE", None, None, True, "country field")],
    ("us/ca", ""): [("CA", None, None, False, "country field"), ("US", None, None, False, "country field")],
    ("", "North America Remote"): [(None, None, None, True, "area")],
    ("", "Join them in person"): [(None, None, None, False, "none")],
    ("", ""): [], (None, None): [], (None, " ;; "): [],
}


def test_cases(spark):
    rows = [(i, *key) for i, key in enumerate(CASES)]
    df = spark.createDataFrame(rows + [(100, "", "London")], "job_id int, country string, location string")
    got: dict = {i: [] for i, *_ in rows}
    found = P.structured_places(df, gazetteer.gazetteer(spark)).orderBy("job_id", "n").collect()
    for r in found:
        got.setdefault(r.job_id, []).append((r.country, r.region, r.city, r.remote, r.evidence))
        assert r.confidence == P.CONFIDENCE[r.evidence]
    assert {key: got[i] for i, key in enumerate(CASES)} == {k: v or [] for k, v in CASES.items()}
    assert got[100] == got[2]
    area = next(r for r in found if r.evidence == "area")
    assert area.matched == "north america" and area.applicants == ["CA", "MX", "US"]


def test_own_rows_join_the_gazetteer(spark):
    more = spark.createDataFrame([("Llanfair-pwll", "city", "Llanfairpwll", "WLS", "GB", 3, False)], gazetteer.SCHEMA)
    df = spark.createDataFrame([(1, "", "Llanfair Pwll, Wales")], "job_id int, country string, location string")
    row = P.structured_places(df, gazetteer.gazetteer(spark, more)).first()
    assert (row.country, row.region, row.city, row.matched) == ("GB", "WLS", "Llanfairpwll", "llanfair pwll")
    assert P.structured_places(df.limit(0), gazetteer.gazetteer(spark)).collect() == []


def test_the_surer_evidence_comes_first():
    assert list(P.CONFIDENCE.values()) == sorted(P.CONFIDENCE.values(), reverse=True)


@pytest.mark.parametrize("name, country", [("United Kingdom", "GB"), ("Türkiye", "TR"), ("Côte d’Ivoire", "CI"), ("u.s.a.", "US")])
def test_names_of_countries(spark, name, country):
    df = spark.createDataFrame([(1, "", name)], "job_id int, country string, location string")
    assert P.structured_places(df, gazetteer.gazetteer(spark)).first().country == country
