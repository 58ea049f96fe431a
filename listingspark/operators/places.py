"""Structured places: what a listing's location texts say, with how sure that is and by which words.

A location falls into parts (``Paris; Madrid, Spain``). The n-grams of a part's words meet a gazetteer in one join, and what each
name may mean is decided in the part's own row: longer names win over those inside them; meanings that contain each
other (a city in a region in a country) support one another; the listing's country field supports its countries; of equally
supported meanings the more specific and then the larger place is taken. Codes such as ``CA`` count only with support, or alone, for a country first.

Different texts are looked up once, however many listings have them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.gazetteer import AREAS, place_name
from ..session import cut_lineage
from .joins import spread_join

#: How sure each kind of evidence makes, the surest first.
CONFIDENCE = {
    "country field": 0.95, "city in context": 0.85, "region in context": 0.8, "country": 0.75, "region": 0.6, "city": 0.5, "area": 0.4, "remote": 0.1, "none": 0.0,
}
_PARTS = r"(?i)\s*[;|/]\s*|\s+or\s+"
_FIELDS = r"[,;/|]"
_AWAY = r"(^| )(remote|anywhere|worldwide|global|work from home|wfh)( |$)"
_SPECIFIC = {"city": 3, "region": 2, "country": 1, "area": 0}


def _text_key(country: Column, location: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.coalesce(country, F.lit("")), F.coalesce(location, F.lit(""))), 256)


def _parts(texts: DataFrame, column: str, separators: str) -> DataFrame:
    """``key, n, words`` of every part with a word, numbered from 0."""
    named = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), separators), place_name), lambda p: p != "")
    return texts.select("key", F.posexplode(named).alias("n", "part")).select("key", "n", F.split("part", " ").alias("words"))


def _hits(parts: DataFrame, places: DataFrame, longest: int) -> DataFrame:
    """The parts with all gazetteer rows that their n-grams name (``hits``), less those inside or behind a longer one."""
    lengths = lambda i: F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - i))
    gram = lambda i, k: F.struct(i.alias("start"), k.alias("long"), F.array_join(F.slice("words", i + 1, k), " ").alias("name"))
    grams = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.transform(lengths(i), lambda k: gram(i, k))))
    met = parts.select("key", "n", F.explode(grams).alias("g")).select("key", "n", "g.*").join(places, "name")
    hit = F.struct("start", "long", "kind", "country", F.coalesce("region", F.lit("")).alias("region"), F.coalesce("city", F.lit("")).alias("city"), "weight", "weak", "name")
    listed = met.groupBy("key", "n").agg(F.collect_set(hit).alias("hits"))
    beaten = lambda h, o: (o.start < h.start + h.long) & (h.start < o.start + o.long) & ((o.long > h.long) | ((o.long == h.long) & (o.start < h.start)))
    kept = F.filter("hits", lambda h: ~F.exists("hits", lambda o: beaten(h, o)))
    return parts.join(listed, ["key", "n"], "left").withColumn("hits", F.coalesce(kept, F.filter("hits", lambda h: F.lit(False))))


def _within(a: Column, b: Column) -> Column:
    """Whether place ``a`` lies in ``b``."""
    same = a.country == b.country
    return ((b.kind == "country") & a.kind.isin("region", "city") & same) | ((b.kind == "region") & (a.kind == "city") & same & (a.region == b.region))


def _chosen(hits: DataFrame) -> DataFrame:
    """The parts with the meaning taken (``place``, null for none); ``stated`` holds the countries of the listing's country field."""
    others = lambda h: F.filter("hits", lambda o: (o.start != h.start) & (_within(h, o) | _within(o, h)))
    support = lambda h: F.size(F.array_distinct(F.transform(others(h), lambda o: o.start))) + F.when(F.array_contains("stated", h.country), 2).otherwise(0)
    weigh = lambda kind, weak: F.when(weak, F.when(kind == "country", 3).otherwise(1)).otherwise(F.element_at(F.create_map(*[F.lit(x) for kv in _SPECIFIC.items() for x in kv]), kind))
    rated = F.transform("hits", lambda h: F.struct(
        (-support(h)).alias("support"), h.weak.alias("weak"), (-weigh(h.kind, h.weak & (support(h) == 0))).alias("specific"), (-h.weight).alias("weight"), h.start.alias("start"),
        F.coalesce(h.country, F.lit("")).alias("country"), h.region.alias("region"), h.city.alias("city"), h.kind.alias("kind"), h["name"].alias("name"), h.long.alias("long"),
    ))
    sure = lambda r: ~r.weak | (r.support < 0) | (r.long == F.size("words"))
    return hits.withColumn("place", F.array_min(F.filter(rated, sure)))


def structured_texts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """For texts ``key, country, location``: one row a part, ``key, n, country, region, city, remote, confidence, evidence, matched, applicants``."""
    places = cut_lineage(places, "gazetteer")
    longest = places.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    none = F.array().cast("array<string>")
    field = _chosen(_hits(_parts(texts, "country", _FIELDS), places.filter("kind = 'country'"), longest).withColumn("stated", none))
    stated = field.filter("place is not null").groupBy("key").agg(F.sort_array(F.collect_set("place.country")).alias("stated"))
    located = _hits(_parts(texts, "location", _PARTS), places, longest).join(stated, "key", "left").withColumn("stated", F.coalesce("stated", none))
    found = _chosen(located)
    # a listing with nothing in its location is where its country field says
    blank = stated.join(located.select("key").distinct(), "key", "left_anti").select("key", F.posexplode("stated").alias("n", "country"))
    alone = F.struct(F.lit("country field").alias("evidence"), F.col("country").alias("country"), F.lit("").alias("region"), F.lit("").alias("city"), F.lit("").alias("matched"))
    p = F.col("place")
    only = F.when(F.size("stated") == 1, F.col("stated")[0]).otherwise(F.lit(""))
    evidence = (
        F.when(p.isNull() & (only != ""), "country field").when(p.isNull() & F.col("remote"), "remote").when(p.isNull(), "none").when(F.array_contains("stated", p.country), "country field")
        .when((p.kind == "city") & (p.support < 0), "city in context").when((p.kind == "region") & (p.support < 0), "region in context").otherwise(p.kind)
    )
    taken = F.struct(
        evidence.alias("evidence"), F.coalesce(p.country, only).alias("country"), F.coalesce(p.region, F.lit("")).alias("region"), F.coalesce(p.city, F.lit("")).alias("city"),
        F.coalesce(p["name"], F.lit("")).alias("matched"),
    )
    away = F.array_join("words", " ").rlike(_AWAY)
    both = found.withColumn("remote", away).select("key", "n", "remote", taken.alias("t")).unionByName(blank.select("key", "n", F.lit(False).alias("remote"), alone.alias("t")))
    sureness = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    areas = F.create_map(*[x for name, codes in AREAS.items() for x in (F.lit(name), F.array(*[F.lit(c) for c in codes]))])
    applicants = F.when(F.col("t.evidence") == "area", F.try_element_at(areas, F.col("t.matched"))).when(F.col("t.country") != "", F.array("t.country")).otherwise(none)
    empty_to_null = lambda name: F.nullif(F.col(f"t.{name}"), F.lit("")).alias(name)
    return both.select(
        "key", "n", *map(empty_to_null, ("country", "region", "city")), "remote", sureness[F.col("t.evidence")].alias("confidence"), F.col("t.evidence").alias("evidence"),
        empty_to_null("matched"), F.coalesce(applicants, none).alias("applicants"),
    )


def structured_places(listings: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each place of a listing (``job_id, country, location``); none where both texts are empty or null."""
    keyed = listings.withColumn("key", _text_key(F.col("country"), F.col("location")))
    texts = cut_lineage(keyed.groupBy("key").agg(F.any_value("country").alias("country"), F.any_value("location").alias("location")), "place-texts")
    found = structured_texts(texts, places)
    listed = found.groupBy("key").agg(F.collect_list(F.struct("n", "country", "region", "city", "remote", "confidence", "evidence", "matched", "applicants")).alias("places"))
    return spread_join(keyed.select("job_id", "key"), listed, "key", "job_id").select("job_id", F.inline("places"))
