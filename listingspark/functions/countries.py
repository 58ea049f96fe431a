"""Country evidence in listing locations."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .iso_countries import COUNTRIES
from .text import let, trim_all

# Further names of a country.
ALIASES = {
    "US": ["us", "usa", "u.s.", "u.s.a.", "united states of america"],
    "GB": ["uk", "u.k.", "great britain", "england", "scotland", "wales", "northern ireland"],
    "KR": ["south korea"],
    "CZ": ["czech republic"],
    "TR": ["turkey", "türkiye"],
}

# The countries that "Europe" stands for.
EUROPE = (
    "AL AD AT BY BE BA BG HR CY CZ DK EE FI FR DE GR HU IS IE IT LV LI LT LU MT MD MC ME NL MK NO PL PT RO RU SM "
    "RS SK SI ES SE CH UA GB VA"
).split()

_EUROPE_WORD = r"(?i)(?<![A-Za-z0-9_])europe(?:an union)?(?![A-Za-z0-9_])"
_WORLD_WORD = r"(?i)(?<![A-Za-z0-9_])(?:worldwide|anywhere|global|world wide|work from anywhere)(?![A-Za-z0-9_])"

def country_terms() -> dict[str, list[str]]:
    """Lower-case name or alias -> the codes it proves.

    A term that begins with another country's term and a non-letter proves both
    ("guinea-bissau" also reads "guinea"), so one match per position is enough.
    """
    owner = {}
    for code, name in COUNTRIES.items():
        for term in [name.lower(), *ALIASES.get(code, [])]:
            owner[term] = code
    terms = {}
    for term, code in owner.items():
        inner = {
            other for prefix, other in owner.items()
            if len(prefix) < len(term) and term.startswith(prefix) and not re.match("[a-z]", term[len(prefix)])
        }
        terms[term] = sorted({code} | inner)
    return terms


def country_coverage(country: Column, location: Column) -> Column:
    """``struct(codes, worldwide)``: what the two texts prove about where a listing may be done.

    One pass over the short location text finds every country term; no join with a
    term table is needed. "Remote" alone proves nothing.
    """
    terms = country_terms()
    codes = sorted(COUNTRIES)
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    pattern = "(?=(?:^|[^a-z])(" + "|".join(re.escape(t) for t in ordered) + ")(?:$|[^a-z]))"
    proves = F.create_map(*[x for t in ordered for x in (F.lit(t), F.array(*[F.lit(c) for c in terms[t]]))])
    known = F.array(*[F.lit(c) for c in codes])
    none = F.array().cast("array<string>")

    def found(text: Column) -> Column:
        return F.flatten(
            F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda t: F.try_element_at(proves, t))
        )

    def build(text: Column) -> Column:
        tokens = F.transform(F.split(country, "[,;/|]", -1), lambda t: F.upper(trim_all(t)))
        place = F.upper(trim_all(location))
        named = F.concat(
            found(text),
            F.array_intersect(tokens, known),
            F.when(F.length(place) == 2, F.array_intersect(F.array(place), known)).otherwise(none),
            F.when(text.rlike(_EUROPE_WORD), F.array(*[F.lit(c) for c in EUROPE])).otherwise(none),
        )
        return let(
            F.array_sort(F.array_distinct(named)),
            lambda c: F.struct(c.alias("codes"), ((F.size(c) == 0) & text.rlike(_WORLD_WORD)).alias("worldwide")),
        )

    return let(F.concat_ws(" ", country, location), build)


def country_match(coverage: Column, selected: Column, worldwide_ok: Column, unknown_ok: Column) -> Column:
    """No selection passes everything; proven codes must meet it; else the two switches decide."""
    return (
        F.when(F.size(selected) == 0, F.lit(True))
        .when(F.size(coverage["codes"]) > 0, F.arrays_overlap(coverage["codes"], selected))
        .when(coverage["worldwide"], worldwide_ok)
        .otherwise(unknown_ok)
    )
