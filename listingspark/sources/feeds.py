"""Feeds that span employers: newest listings, never a complete inventory."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.dates import iso_date
from ..functions.labels import employment_class, period_code, period_word, work_class
from ..functions.numbers import currency_of, salary_range
from ..functions.text import first_nonblank, html_to_text, join_nonblank, trim_all
from .boards import _date_at, _nonblank
from .registry import Provider, json_items, number_at, register_provider, text_at, texts_at


def _remoteok(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    tags = texts_at(item, "tags")
    low, high = number_at(item, "salary_min"), number_at(item, "salary_max")
    paid = (F.coalesce(low, F.lit(0.0)) != 0) | (F.coalesce(high, F.lit(0.0)) != 0)
    return {
        "external_id": text_at(item, "id"),
        "title": text_at(item, "position"),
        "company": text_at(item, "company"),
        "description": html_to_text(text_at(item, "description")),
        "location": text_at(item, "location"),
        "industry": F.coalesce(F.get(tags, 0), F.lit("")),
        "employment_type": F.when(F.exists(tags, lambda t: t.rlike("(?i)part[- ]time")), "Temporary").otherwise("Full-time"),
        "work_type": F.lit("Remote"),
        "salary_min": F.when(low > 0, low),
        "salary_max": F.when(high > 0, high),
        "salary_period": F.when(paid, "year").otherwise("unknown"),
        "currency": F.lit("USD"),
        "job_url": first_nonblank(text_at(item, "url"), text_at(item, "apply_url")),
        "posted_at": _date_at(item, "date"),
    }


register_provider(Provider(
    "RemoteOK", json_items("$"), _remoteok,
    {"id": "SN", "slug": "S", "company": "S", "position": "S", "description": "S", "location": "S?", "date": "S?~",
     "url": "S?", "apply_url": "S?", "salary_min": "N?~", "salary_max": "N?~", "tags": "A?"},
    accepts=lambda i: first_nonblank(text_at(i, "url"), text_at(i, "apply_url")) != "",
    can_mark_removals=False,
))


def _one_or_many(item: Column, path: str) -> Column:
    """A field that is either one text or an array of texts."""
    one = F.try_variant_get(item, f"$.{path}", "string")
    many = F.try_variant_get(item, f"$.{path}", "array<string>")
    none = F.array().cast("array<string>")
    return F.when(many.isNotNull(), many).when(F.coalesce(one, F.lit("")) != "", F.array(one)).otherwise(none)


def _jobicy(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    period = F.lower(text_at(item, "salaryPeriod"))
    return {
        "external_id": text_at(item, "id"),
        "title": html_to_text(text_at(item, "jobTitle")),
        "company": html_to_text(text_at(item, "companyName")),
        "description": html_to_text(text_at(item, "jobDescription")),
        "location": text_at(item, "jobGeo"),
        "industry": F.array_join(_one_or_many(item, "jobIndustry"), ", "),
        "employment_type": employment_class("Jobicy", F.array_join(_one_or_many(item, "jobType"), " ")),
        "work_type": F.lit("Remote"),
        "salary_min": number_at(item, "salaryMin"),
        "salary_max": number_at(item, "salaryMax"),
        "salary_period": F.when(period.rlike("year|annual"), "year").when(period.rlike("hour"), "hour")
        .when(period.rlike("month"), "month").otherwise("unknown"),
        "currency": currency_of(text_at(item, "salaryCurrency")),
        "job_url": text_at(item, "url"),
        "posted_at": _date_at(item, "pubDate"),
    }


register_provider(Provider(
    "Jobicy", json_items("$.jobs"), _jobicy,
    {"id": "SN", "url": "S", "jobTitle": "S", "companyName": "S", "jobDescription": "S", "jobGeo": "S?~",
     "jobIndustry": "SA?~", "jobType": "SA?~", "pubDate": "S?~", "salaryCurrency": "S?~", "salaryPeriod": "S?~"},
    can_mark_removals=False,
))


def _remotive(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    return {
        "external_id": text_at(item, "id"),
        "title": html_to_text(text_at(item, "title")),
        "company": html_to_text(text_at(item, "company_name")),
        "description": html_to_text(text_at(item, "description")),
        "location": text_at(item, "candidate_required_location"),
        "industry": text_at(item, "category"),
        "employment_type": employment_class("Remotive", text_at(item, "job_type")),
        "work_type": F.lit("Remote"),
        "job_url": text_at(item, "url"),
        "posted_at": _date_at(item, "publication_date"),
    }


register_provider(Provider(
    "Remotive", json_items("$.jobs"), _remotive,
    {"id": "SN", "url": "S", "title": "S", "company_name": "S", "description": "S", "category": "S?~", "job_type": "S?~",
     "publication_date": "S?~", "candidate_required_location": "S?~"},
    can_mark_removals=False,
))


def _themuse(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    location = F.array_join(F.filter(texts_at(item, "locations", "name"), lambda n: n != ""), "; ")
    return {
        "external_id": text_at(item, "id"),
        "title": html_to_text(text_at(item, "name")),
        "company": html_to_text(text_at(item, "company.name")),
        "description": html_to_text(text_at(item, "contents")),
        "location": location,
        "industry": F.array_join(F.filter(texts_at(item, "categories", "name"), lambda n: n != ""), ", "),
        "work_type": work_class(location.rlike("(?i)remote|flexible"), location != ""),
        "job_url": text_at(item, "refs.landing_page"),
        "posted_at": _date_at(item, "publication_date"),
    }


register_provider(Provider(
    "TheMuse", json_items("$.results"), _themuse,
    {"id": "SN", "name": "S", "contents": "S", "publication_date": "S?~", "locations": "A?~", "categories": "A?~",
     "refs": "O", "refs.landing_page": "S", "company": "O", "company.name": "S?"},
    problem=lambda i: F.when(html_to_text(text_at(i, "company.name")) == "", "no_employer"),
    can_mark_removals=False,
))


def _himalayas(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    low, high = salary_range(text_at(item, "minSalary"), text_at(item, "maxSalary"))
    at = number_at(item, "pubDate")
    return {
        "external_id": text_at(item, "guid"),
        "title": html_to_text(text_at(item, "title")),
        "company": html_to_text(text_at(item, "companyName")),
        "description": html_to_text(text_at(item, "description")),
        "location": F.array_join(texts_at(item, "locationRestrictions"), ", "),
        "industry": F.array_join(texts_at(item, "categories"), ", "),
        "employment_type": employment_class("Himalayas", text_at(item, "employmentType")),
        "work_type": F.lit("Remote"),
        "salary_min": low.cast("double"),
        "salary_max": high.cast("double"),
        "salary_period": F.when(low.isNull() & high.isNull(), "unknown").otherwise(period_word(text_at(item, "salaryPeriod"))),
        "currency": currency_of(text_at(item, "currency")),
        "job_url": first_nonblank(text_at(item, "applicationLink"), text_at(item, "guid")),
        "posted_at": F.when(at != 0, F.timestamp_seconds(at)),
    }


register_provider(Provider(
    "Himalayas", json_items("$.jobs"), _himalayas,
    {"guid": "S", "applicationLink": "S?~", "title": "S", "companyName": "S", "description": "S", "employmentType": "S?~",
     "minSalary": "N?~", "maxSalary": "N?~", "currency": "S?~", "salaryPeriod": "S?~", "locationRestrictions": "A?~",
     "categories": "A?~", "pubDate": "N?~"},
    can_mark_removals=False,
))

_RSS = (
    "channel struct<item array<struct<guid string, link string, title string, description string, region string, "
    "country string, category string, type string, pubDate string>>>"
)


def _wwr(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    def text(name: str) -> Column:
        return F.coalesce(item[name], F.lit(""))

    at = F.instr(text("title"), ":")
    return {
        "external_id": text("guid"),
        "title": trim_all(F.substr(text("title"), at + 1)),
        "company": F.when(at > 0, trim_all(F.substr(text("title"), F.lit(1), at - 1))).otherwise(""),
        "description": html_to_text(text("description")),
        "location": first_nonblank(text("region"), text("country")),
        "country": text("country"),
        "industry": text("category"),
        "employment_type": employment_class("WeWorkRemotely", text("type")),
        "work_type": F.lit("Remote"),
        "job_url": text("link"),
        "posted_at": iso_date(item["pubDate"]),
    }


register_provider(Provider(
    "WeWorkRemotely",
    lambda payload: F.from_xml(payload, _RSS)["channel"]["item"],
    _wwr,
    accepts=lambda i: (F.coalesce(i["guid"], F.lit("")) != "") & (F.coalesce(i["title"], F.lit("")) != "")
    & (F.coalesce(i["link"], F.lit("")) != ""),
    problem=lambda i: F.when(F.instr(i["title"], ":") < 2, "no_employer"),
    can_mark_removals=False,
))


def _usajobs(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    d = "MatchedObjectDescriptor"
    pay = F.get(F.try_variant_get(item, f"$.{d}.PositionRemuneration", "array<variant>"), 0)
    low, high = salary_range(text_at(pay, "MinimumRange"), text_at(pay, "MaximumRange"))
    location = text_at(item, f"{d}.PositionLocationDisplay")
    parts = [
        text_at(item, f"{d}.UserArea.Details.JobSummary"),
        F.array_join(texts_at(item, f"{d}.UserArea.Details.MajorDuties"), "\n"),
        text_at(item, f"{d}.QualificationSummary"),
    ]
    return {
        "external_id": text_at(item, "MatchedObjectId"),
        "title": html_to_text(text_at(item, f"{d}.PositionTitle")),
        "company": first_nonblank(text_at(item, f"{d}.OrganizationName"), text_at(item, f"{d}.DepartmentName"), F.lit("USAJOBS")),
        "description": html_to_text(join_nonblank("\n\n", *parts)),
        "location": location,
        "country": F.lit("United States"),
        "industry": F.array_join(F.filter(texts_at(item, f"{d}.JobCategory", "Name"), lambda n: n != ""), ", "),
        "employment_type": employment_class("USAJOBS", F.array_join(texts_at(item, f"{d}.PositionSchedule", "Name"), " ")),
        "work_type": F.when(location.rlike("(?i)remote|telework"), "Remote").otherwise("On-site"),
        "salary_min": low.cast("double"),
        "salary_max": high.cast("double"),
        "salary_period": F.when(low.isNull() & high.isNull(), "unknown").otherwise(period_code(text_at(pay, "RateIntervalCode"))),
        "currency": F.lit("USD"),
        "job_url": text_at(item, f"{d}.PositionURI"),
        "posted_at": _date_at(item, f"{d}.PublicationStartDate"),
    }


register_provider(Provider(
    "USAJOBS", json_items("$.SearchResult.SearchResultItems"), _usajobs,
    {"MatchedObjectId": "S", "MatchedObjectDescriptor": "O", "MatchedObjectDescriptor.PositionTitle": "S",
     "MatchedObjectDescriptor.PositionURI": "S", "MatchedObjectDescriptor.JobCategory": "A?~",
     "MatchedObjectDescriptor.PositionSchedule": "A?~", "MatchedObjectDescriptor.PositionRemuneration": "A?~"},
    accepts=lambda i: _nonblank(i, "MatchedObjectId", "MatchedObjectDescriptor.PositionTitle"),
    can_mark_removals=False,
))

# The currency a country endpoint prices in.
ADZUNA_CURRENCY = {
    "us": "USD", "ca": "CAD", "gb": "GBP", "de": "EUR", "fr": "EUR", "nl": "EUR", "es": "EUR", "it": "EUR", "at": "EUR", "be": "EUR",
}


def _adzuna(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    """The board of an Adzuna source is the country endpoint it reads."""
    predicted = text_at(item, "salary_is_predicted") == "1"
    low, high = salary_range(text_at(item, "salary_min"), text_at(item, "salary_max"))
    low, high = F.when(~predicted, low), F.when(~predicted, high)
    location = text_at(item, "location.display_name")
    kind = F.concat(text_at(item, "contract_time"), F.lit(" "), text_at(item, "contract_type"))
    currencies = F.create_map(*[F.lit(x) for pair in ADZUNA_CURRENCY.items() for x in pair])
    return {
        "external_id": text_at(item, "id"),
        "title": html_to_text(text_at(item, "title")),
        "company": html_to_text(text_at(item, "company.display_name")),
        "description": html_to_text(text_at(item, "description")),
        "location": location,
        "industry": text_at(item, "category.label"),
        "employment_type": employment_class("Adzuna", kind),
        "work_type": work_class(
            F.concat(text_at(item, "title"), F.lit(" "), location).rlike("(?i)remote|work from home"), location != ""
        ),
        "salary_min": low.cast("double"),
        "salary_max": high.cast("double"),
        "salary_period": F.when(low.isNull() & high.isNull(), "unknown").otherwise("year"),
        "currency": F.coalesce(F.try_element_at(currencies, F.lower(trim_all(ctx["board"]))), F.lit("Unknown")),
        "job_url": text_at(item, "redirect_url"),
        "posted_at": _date_at(item, "created"),
    }


register_provider(Provider(
    "Adzuna", json_items("$.results"), _adzuna,
    {"id": "SN", "title": "S", "description": "S", "redirect_url": "S", "created": "S?~", "company": "O?~", "location": "O?~",
     "category": "O?~", "contract_time": "S?~", "contract_type": "S?~", "salary_min": "N?~", "salary_max": "N?~",
     "salary_is_predicted": "SN?~"},
    accepts=lambda i: _nonblank(i, "title"),
    problem=lambda i: F.when(text_at(i, "company.display_name") == "", "no_employer"),
    can_mark_removals=False,
))
