"""Categories and sentences: bands, employment and work classes, identities, message texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import blank_to_null, first_nonblank
from .urls import canonical_url

# Score bands, best first.
MATCH_BANDS = (
    ("Excellent Match", 90),
    ("Strong Match", 80),
    ("Possible Match", 65),
    ("Stretch Opportunity", 50),
    ("Weak Match", 1),
    ("Do Not Apply", 0),
)

# Feeds that span employers and never prove one employer's inventory.
GLOBAL_FEEDS = ("RemoteOK", "Jobicy", "Remotive", "TheMuse", "Himalayas", "WeWorkRemotely", "USAJOBS", "Adzuna")

# Vendors whose boards can be read, and the further ones that are only recognized.
SUPPORTED_VENDORS = ("Greenhouse", "Lever", "Ashby", "Workable", "Personio", "SmartRecruiters", "Rippling")

# How each feed words its employment kinds, in the order the rules apply.
EMPLOYMENT_RULES: dict[str, tuple[tuple[str, str], ...]] = {
    "Lever": (("contract", "Contract"), ("part", "Temporary"), ("full", "Full-time")),
    "Workable": (("contract|freelance", "Contract"), ("full[ -]?time", "Full-time"), ("part[ -]?time|intern|temporary", "Temporary")),
    "Personio": (("freelance|contract", "Contract"), ("intern|trainee|working-student|temporary", "Temporary"), ("permanent", "Permanent"), ("full", "Full-time")),
    "SmartRecruiters": (("contract|freelance", "Contract"), ("permanent", "Permanent"), ("full[ -]?time", "Full-time"), ("part[ -]?time|intern|temporary", "Temporary")),
    "Rippling": (("contract|freelance|temp", "Contract"), (r"salaried|full[ -_]?time|ft\b", "Full-time"), (r"part[ -_]?time|intern|pt\b", "Temporary")),
    "Jobicy": (("contract|freelance", "Contract"), ("full", "Full-time")),
    "Remotive": (("contract|freelance", "Contract"), ("full[_ -]?time", "Full-time"), ("part[_ -]?time|internship|temporary", "Temporary")),
    "Himalayas": (("contract|freelance", "Contract"), ("full[ -]?time", "Full-time"), ("part[ -]?time|intern|temporary", "Temporary")),
    "WeWorkRemotely": (("contract|freelance", "Contract"), ("full[ -]?time", "Full-time"), ("part[ -]?time|intern|temporary", "Temporary")),
    "USAJOBS": (("part[ -]?time|intern|temporary", "Temporary"), ("full[ -]?time", "Full-time")),
    "Adzuna": (("contract|freelance", "Contract"), ("permanent", "Permanent"), ("full[ _-]?time", "Full-time"), ("part[ _-]?time", "Temporary")),
    "JSON-LD": (("contract", "Contract"), ("part|temp", "Temporary"), ("full", "Full-time")),
}

# Accepted spellings of each provider name.
PROVIDER_ALIASES = {
    "greenhouse": "Greenhouse",
    "lever": "Lever",
    "ashby": "Ashby",
    "remoteok": "RemoteOK",
    "remote-ok": "RemoteOK",
    "workable": "Workable",
    "personio": "Personio",
    "smartrecruiters": "SmartRecruiters",
    "smart-recruiters": "SmartRecruiters",
    "rippling": "Rippling",
    "remotive": "Remotive",
    "themuse": "TheMuse",
    "the-muse": "TheMuse",
    "himalayas": "Himalayas",
    "weworkremotely": "WeWorkRemotely",
    "we-work-remotely": "WeWorkRemotely",
    "wwr": "WeWorkRemotely",
    "usajobs": "USAJOBS",
    "usa-jobs": "USAJOBS",
    "adzuna": "Adzuna",
    "json-ld": "JSON-LD",
    "jsonld": "JSON-LD",
    "jobicy": "Jobicy",
    "careers": "Careers",
    "capturedapi": "CapturedApi",
    "captured-api": "CapturedApi",
    "browser": "Browser",
}


def match_band(score: Column) -> Column:
    band = F.lit(MATCH_BANDS[-1][0])
    for label, floor in reversed(MATCH_BANDS):
        band = F.when(score >= floor, F.lit(label)).otherwise(band)
    return band


def first_class(text: Column, rules: tuple[tuple[str, str], ...], default: str = "Unknown") -> Column:
    """The class of the first rule whose pattern occurs, ignoring case."""
    label = F.lit(default)
    for pattern, name in reversed(rules):
        label = F.when(text.rlike(f"(?i){pattern}"), F.lit(name)).otherwise(label)
    return label


def employment_class(provider: str, text: Column) -> Column:
    return first_class(F.coalesce(text, F.lit("")), EMPLOYMENT_RULES[provider])


def work_class(remote: Column, located: Column) -> Column:
    """Remote if said so, on site if a place is named, else unknown."""
    return F.when(remote, "Remote").when(located, "On-site").otherwise("Unknown")


def period_word(text: Column) -> Column:
    """Pay period from free wording."""
    return first_class(
        F.coalesce(text, F.lit("")),
        (("year|annual", "year"), ("hour", "hour"), ("month", "month"), ("week", "week"), ("day", "day")),
        "unknown",
    )


def period_unit(text: Column) -> Column:
    """Pay period from an exact unit word, as structured data writes it."""
    unit = F.lower(F.coalesce(text, F.lit("")))
    return F.when(unit.isin("year", "month", "week", "day", "hour"), unit).otherwise("unknown")


def period_code(text: Column) -> Column:
    """Pay period from the two-letter codes of the federal feed."""
    code = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    label = F.lit("unknown")
    for key, name in (("PA", "year"), ("PH", "hour"), ("PM", "month"), ("PW", "week"), ("PD", "day")):
        label = F.when(code == key, F.lit(name)).otherwise(label)
    return label


def provider_name(alias: Column) -> Column:
    """Canonical provider name; null for a spelling nobody knows."""
    names = F.create_map(*[F.lit(x) for pair in PROVIDER_ALIASES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.trim(alias)))


def source_identity(provider: Column, board: Column, source_url: Column) -> Column:
    """What makes a source the same source."""
    key = F.when(provider.isin(*GLOBAL_FEEDS), F.lower(provider)).otherwise(board)
    return F.when(
        (provider == "JSON-LD") & (F.coalesce(source_url, F.lit("")) != ""), canonical_url(source_url)
    ).otherwise(F.concat(provider, F.lit(":"), key))


def external_id(identifier: Column, url: Column) -> Column:
    """The stated identifier; a blank one is no identity, so the URL stands in."""
    return F.coalesce(blank_to_null(F.trim(identifier)), url)


def alert_title(score: Column, title: Column) -> Column:
    return F.concat(match_band(score), F.lit(": "), title)


def alert_body(company: Column, location: Column, score: Column, reason: Column) -> Column:
    place = F.when(location != "", F.concat(F.lit(" · "), location)).otherwise("")
    first = F.concat(company, place, F.lit(" scored "), score.cast("string"), F.lit("/100."))
    return F.concat_ws(" ", first, blank_to_null(reason))


def plural(count: Column, one: str, many: str) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(many))


def digest_sentence(new_jobs: Column, hours: Column, high: Column, strong: Column, possible: Column, applications: Column) -> Column:
    """The fixed summary of a digest."""
    some = (high > 0) | (strong > 0) | (possible > 0)
    return F.concat_ws(
        " ",
        F.concat(plural(new_jobs, "opportunity", "opportunities"), F.lit(" discovered in the last "), hours.cast("string"), F.lit(" hours.")),
        F.when(some, F.concat(
            high.cast("string"), F.lit(" high-priority, "), strong.cast("string"), F.lit(" strong and "),
            possible.cast("string"), F.lit(" possible matches were evaluated."),
        )).otherwise("No evaluated opportunity reached your digest threshold yet."),
        F.when(applications > 0, F.concat(plural(applications, "application needs", "applications need"), F.lit(" your attention."))),
    )


def digest_line(title: Column, company: Column, score: Column) -> Column:
    return F.concat(F.lit("• "), title, F.lit(" — "), company, F.lit(" ("), score.cast("string"), F.lit(", "), match_band(score), F.lit(")"))


def _listed(items: Column, empty: str) -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(empty)


def target_text(profile: dict[str, Column], prefs: dict[str, Column]) -> Column:
    """What a person is looking for, as the text that is embedded."""
    roles = F.transform(
        prefs["target_roles"],
        lambda r: F.concat(r["title"], F.lit(" ("), first_nonblank(r["group"], r["weight"].cast("string")), F.lit("/10)")),
    )
    required = F.transform(
        F.filter(prefs["skills"], lambda s: s["preference"] == "Required"), lambda s: s["name"]
    )

    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"{label}: "), value)

    def stated(value: Column) -> Column:
        return F.coalesce(blank_to_null(value), F.lit("Not specified"))

    return F.concat_ws(
        "\n",
        line("Target roles", F.when(F.size(roles) > 0, F.array_join(roles, "; ")).otherwise("Not specified")),
        line("Current role", stated(profile["current_role"])),
        line("Years of experience", profile["years_experience"].cast("string")),
        line("Skills", _listed(profile["skills"], "Not specified")),
        line("Industries", _listed(profile["industries"], "Not specified")),
        line("Leadership", stated(profile["leadership_experience"])),
        line("Management", stated(profile["management_experience"])),
        line("Preferred work arrangement", _listed(prefs["work_types"], "Not specified")),
        line("Preferred seniority", _listed(prefs["seniority"], "Not specified")),
        line("Preferred locations", _listed(prefs["included_locations"], "Open")),
        line("Selected countries", _listed(prefs["countries"], "All")),
        line("Preferred industries", _listed(prefs["industries"], "Open")),
        line("Required skills", _listed(required, "None")),
        F.lit(
            "Missing listing values: when a listing does not state work arrangement or seniority, infer it from the "
            "description. Do not treat a missing value as a mismatch by itself."
        ),
        line("Summary", stated(profile["summary"])),
    )


def listing_text(title: Column, company: Column, location: Column, work_type: Column, employment_type: Column,
                 seniority: Column, industry: Column, description: Column, limit: int | None = None) -> Column:
    """What a listing offers, as the text that is embedded; ``limit`` is what the embedding model can take."""

    def noted(value: Column) -> Column:
        return F.concat(value, F.when(value == "Unknown", " (not stated)").otherwise(""))

    def stated(value: Column) -> Column:
        return F.coalesce(blank_to_null(value), F.lit("Unknown"))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Company: "), company),
        F.concat(F.lit("Location: "), stated(location)),
        F.concat(F.lit("Work: "), noted(work_type)),
        F.concat(F.lit("Employment: "), employment_type),
        F.concat(F.lit("Seniority: "), noted(seniority)),
        F.concat(F.lit("Industry: "), stated(industry)),
        F.concat(F.lit("Description: "), description),
    )
    return text if limit is None else F.substr(text, F.lit(1), F.lit(limit))
