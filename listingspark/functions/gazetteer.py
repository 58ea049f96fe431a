"""Places by name: countries, their regions, continents and a first set of cities. A service adds its own rows to these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .countries import ALIASES, EUROPE
from .iso_countries import COUNTRIES

# Regions by country, code and name.
REGIONS = """
US AL Alabama; US AK Alaska; US AZ Arizona; US AR Arkansas; US CA California; US CO Colorado; US CT Connecticut; US DE Delaware; US DC District of Columbia;
US FL Florida; US GA Georgia; US HI Hawaii; US ID Idaho; US IL Illinois; US IN Indiana; US IA Iowa; US KS Kansas; US KY Kentucky; US LA Louisiana; US ME Maine;
US MD Maryland; US MA Massachusetts; US MI Michigan; US MN Minnesota; US MS Mississippi; US MO Missouri; US MT Montana; US NE Nebraska; US NV Nevada;
US NH New Hampshire; US NJ New Jersey; US NM New Mexico; US NY New York; US NC North Carolina; US ND North Dakota; US OH Ohio; US OK Oklahoma; US OR Oregon;
US PA Pennsylvania; US RI Rhode Island; US SC South Carolina; US SD South Dakota; US TN Tennessee; US TX Texas; US UT Utah; US VT Vermont; US VA Virginia;
US WA Washington; US WV West Virginia; US WI Wisconsin; US WY Wyoming;
CA AB Alberta; CA BC British Columbia; CA MB Manitoba; CA NB New Brunswick; CA NL Newfoundland and Labrador; CA NS Nova Scotia; CA NT Northwest Territories;
CA NU Nunavut; CA ON Ontario; CA PE Prince Edward Island; CA QC Quebec; CA SK Saskatchewan; CA YT Yukon;
GB ENG England; GB SCT Scotland; GB WLS Wales; GB NIR Northern Ireland; DE BY Bavaria; DE HE Hesse; DE BW Baden-Württemberg; DE NW North Rhine-Westphalia;
AU NSW New South Wales; AU VIC Victoria; AU QLD Queensland
"""
# Cities by country, region code, thousands of people and name.
CITIES = """
US NY 8300 New York; US NY 8300 New York City; US CA 3900 Los Angeles; US IL 2700 Chicago; US TX 2300 Houston; US AZ 1600 Phoenix; US PA 1600 Philadelphia; US TX 1400 San Antonio;
US CA 1400 San Diego; US TX 1300 Dallas; US TX 960 Austin; US CA 1000 San Jose; US CA 870 San Francisco; US WA 740 Seattle; US CO 710 Denver; US DC 700 Washington DC; US MA 650 Boston;
US OR 650 Portland; US ME 68 Portland; US GA 500 Atlanta; US FL 440 Miami; US MN 430 Minneapolis; US NC 470 Raleigh; US NJ 90 Trenton; US TX 25 Paris; US OH 160 Dayton; US KY 45 London; US AL 200 Birmingham;
CA ON 2900 Toronto; CA ON 1000 Ottawa; CA ON 400 London; CA ON 260 Kitchener; CA ON 120 Waterloo; CA BC 660 Vancouver; CA BC 90 Victoria; CA QC 1800 Montreal; CA QC 540 Quebec City; CA AB 1300 Calgary; CA AB 1000 Edmonton;
CA MB 750 Winnipeg; CA NS 440 Halifax; GB ENG 8900 London; GB ENG 1100 Birmingham; GB ENG 550 Manchester; GB ENG 500 Leeds; GB ENG 470 Bristol; GB ENG 145 Cambridge; GB SCT 520 Edinburgh; GB SCT 630 Glasgow; GB WLS 360 Cardiff; GB NIR 340 Belfast;
US MA 118 Cambridge; IE - 1200 Dublin; US OH 49 Dublin; FR - 2100 Paris; FR - 520 Lyon; FR - 340 Nice; ES - 3300 Madrid; ES - 1600 Barcelona; PT - 550 Lisbon; IT - 2800 Rome; IT - 1400 Milan; DE - 3700 Berlin; DE - 1800 Hamburg;
DE BY 1500 Munich; DE HE 760 Frankfurt; DE NW 1100 Cologne; DE BW 630 Stuttgart; NL - 870 Amsterdam; BE - 1200 Brussels; CH - 420 Zurich; CH - 200 Geneva; AT - 1900 Vienna; PL - 1800 Warsaw; PL - 780 Krakow; CZ - 1300 Prague; SE - 980 Stockholm;
NO - 700 Oslo; DK - 640 Copenhagen; FI - 650 Helsinki; GE - 1200 Tbilisi; GW - 490 Bissau; KR - 9700 Seoul; JP - 13900 Tokyo; SG - 5700 Singapore; IN - 12400 Mumbai; IN - 8400 Bangalore; IN - 8400 Bengaluru; IN - 6800 Hyderabad; AU NSW 5300 Sydney;
AU VIC 5000 Melbourne; NZ - 1600 Auckland; BR - 12300 São Paulo; MX - 9200 Mexico City; AR - 3000 Buenos Aires; ZA - 4300 Cape Town; IL - 460 Tel Aviv; AE - 3300 Dubai
"""
# Names of wider areas, with the countries they stand for where that is settled.
AREAS = {"europe": EUROPE, "european union": EUROPE, "north america": ["CA", "MX", "US"]}

SCHEMA = "name string, kind string, city string, region string, country string, weight bigint, weak boolean"


def place_name(text: Column) -> Column:
    """Small letters, signs as spaces, dots dropped: how names and texts are compared."""
    letters = F.regexp_replace(F.replace(F.lower(text), F.lit("."), F.lit("")), r"[^\p{L}\p{N}]+", " ")
    return F.trim(letters)


def rows() -> list[tuple]:
    """The gazetteer as rows of :data:`SCHEMA`; a weak name counts only with others that agree, or alone."""
    found = []
    for code, name in COUNTRIES.items():
        found += [(n, "country", None, None, code, 10**6, False) for n in [name, *ALIASES.get(code, [])] if len(n) > 2 or n in ("us", "uk")]
        found.append((code, "country", None, None, code, 0, True))
    for entry in " ".join(REGIONS.split()).split("; "):
        country, code, name = entry.split(" ", 2)
        found += [(name, "region", None, code, country, 10**5, False), (code, "region", None, code, country, 0, True)]
    for entry in " ".join(CITIES.split()).split("; "):
        country, code, people, name = entry.split(" ", 3)
        found.append((name, "city", name, None if code == "-" else code, country, int(people), False))
    found += [(name, "area", None, None, None, 0, False) for name in AREAS]
    return found


def gazetteer(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """Places by compared name, one row for each place a name may mean. ``more`` has the columns of :data:`SCHEMA`."""
    df = spark.createDataFrame(rows(), SCHEMA)
    both = df if more is None else df.unionByName(more)
    return both.withColumn("name", place_name(F.col("name"))).filter("name != ''").distinct()
