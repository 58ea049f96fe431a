"""Employer boards: one vendor account is one employer's inventory."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.dates import iso_date
from ..functions.labels import employment_class, work_class
from ..functions.text import first_nonblank, html_to_text, join_nonblank, let, trim_all
from .registry import Provider, flag_at, json_items, number_at, register_provider, text_at, texts_at


def _date_at(item: Column, *paths: str) -> Column:
    """The first of several fields that is present decides, even when it is unreadable."""
    return iso_date(F.coalesce(*[F.try_variant_get(item, f"$.{p}", "string") for p in paths]))


def _greenhouse(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    offices = F.array_join(F.filter(texts_at(item, "offices", "name"), lambda n: n != ""), "; ")
    location = first_nonblank(text_at(item, "location.name"), offices)
    return {
        "external_id": text_at(item, "id"),
        "title": text_at(item, "title"),
        "company": first_nonblank(text_at(item, "company_name"), ctx["company"], ctx["board"]),
        "description": html_to_text(text_at(item, "content")),
        "location": location,
        "work_type": F.when(location.rlike("(?i)remote"), "Remote").otherwise("Unknown"),
        "job_url": text_at(item, "absolute_url"),
        "posted_at": _date_at(item, "first_published", "updated_at"),
    }


register_provider(Provider(
    "Greenhouse", json_items("$.jobs"), _greenhouse,
    {"id": "SN", "title": "S", "absolute_url": "S", "company_name": "S?", "content": "S?", "first_published": "S?~",
     "updated_at": "S?~", "location": "O?~", "offices": "A?"},
))


def _lever(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    place = text_at(item, "workplaceType")
    interval = F.lower(text_at(item, "salaryRange.interval"))
    return {
        "external_id": text_at(item, "id"),
        "title": text_at(item, "text"),
        "company": first_nonblank(ctx["company"], ctx["board"]),
        "description": first_nonblank(text_at(item, "descriptionPlain"), html_to_text(text_at(item, "description"))),
        "location": text_at(item, "categories.location"),
        "country": text_at(item, "country"),
        "employment_type": employment_class("Lever", text_at(item, "categories.commitment")),
        "work_type": F.when(place == "remote", "Remote").when(place == "hybrid", "Hybrid")
        .when(place.isin("on-site", "onsite"), "On-site").otherwise("Unknown"),
        "salary_min": number_at(item, "salaryRange.min"),
        "salary_max": number_at(item, "salaryRange.max"),
        "salary_period": F.when(interval.isin("year", "hour", "month", "week", "day"), interval).otherwise("unknown"),
        "currency": F.coalesce(F.try_variant_get(item, "$.salaryRange.currency", "string"), F.lit("Unknown")),
        "job_url": text_at(item, "hostedUrl"),
    }


register_provider(Provider(
    "Lever", json_items("$"), _lever,
    {"id": "S", "text": "S", "hostedUrl": "S", "categories": "O?", "country": "S?~", "descriptionPlain": "S?",
     "description": "S?", "salaryRange": "O?~"},
    accepts=lambda i: F.coalesce(F.try_variant_get(i, "$.workplaceType", "string"), F.lit("unspecified"))
    .isin("unspecified", "on-site", "onsite", "remote", "hybrid"),
))

# How the Ashby feed writes employment kinds.
_ASHBY_KINDS = {"FullTime": "Full-time", "PartTime": "Temporary", "Intern": "Temporary", "Contract": "Contract", "Temporary": "Temporary"}


def _ashby(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    kinds = F.create_map(*[F.lit(x) for pair in _ASHBY_KINDS.items() for x in pair])
    parts = F.try_variant_get(item, "$.compensation.summaryComponents", "array<variant>")
    pay = F.get(F.filter(parts, lambda p: text_at(p, "compensationType") == "Salary"), 0)
    place = text_at(item, "workplaceType")
    return {
        "external_id": text_at(item, "jobUrl"),
        "title": text_at(item, "title"),
        "company": first_nonblank(ctx["company"], ctx["board"]),
        "description": first_nonblank(text_at(item, "descriptionPlain"), html_to_text(text_at(item, "descriptionHtml"))),
        "location": text_at(item, "location"),
        "industry": text_at(item, "department"),
        "employment_type": F.try_element_at(kinds, first_nonblank(text_at(item, "employmentType"), F.lit("FullTime"))),
        "work_type": F.when(place.isin("Remote", "Hybrid"), place).otherwise("On-site"),
        "salary_min": number_at(pay, "minValue"),
        "salary_max": number_at(pay, "maxValue"),
        "salary_period": F.when(text_at(pay, "interval") == "1 YEAR", "year").otherwise("unknown"),
        "currency": F.coalesce(F.try_variant_get(pay, "$.currencyCode", "string"), F.lit("Unknown")),
        "job_url": text_at(item, "jobUrl"),
        "posted_at": _date_at(item, "publishedAt"),
    }


register_provider(Provider(
    "Ashby", json_items("$.jobs"), _ashby,
    {"title": "S", "jobUrl": "S", "location": "S?", "department": "S?", "descriptionHtml": "S?", "descriptionPlain": "S?",
     "publishedAt": "S?~", "compensation": "O?~"},
    accepts=lambda i: F.coalesce(F.try_variant_get(i, "$.workplaceType", "string"), F.lit("OnSite")).isin("OnSite", "Remote", "Hybrid")
    & F.coalesce(F.try_variant_get(i, "$.employmentType", "string"), F.lit("FullTime")).isin(*_ASHBY_KINDS),
))


def _workable_items(payload: Column) -> Column:
    """Postings with the account name they were listed under."""

    def pair(doc: Column) -> Column:
        name = text_at(doc, "name")
        return F.transform(
            F.try_variant_get(doc, "$.jobs", "array<variant>"),
            lambda job: F.struct(name.alias("account"), job.alias("job")),
        )

    return let(F.try_parse_json(payload), pair)


def _workable(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    job = item["job"]
    country = text_at(job, "country")
    location = join_nonblank(", ", text_at(job, "city"), text_at(job, "state"), country)
    return {
        "external_id": text_at(job, "shortcode"),
        "title": html_to_text(text_at(job, "title")),
        "company": first_nonblank(html_to_text(item["account"]), ctx["company"], ctx["board"]),
        "description": html_to_text(text_at(job, "description")),
        "location": location,
        "country": country,
        "industry": first_nonblank(text_at(job, "industry"), text_at(job, "function")),
        "employment_type": employment_class("Workable", text_at(job, "employment_type")),
        "work_type": work_class(flag_at(job, "telecommuting"), location != ""),
        "job_url": text_at(job, "url"),
        "posted_at": _date_at(job, "published_on", "created_at"),
    }


def _nonblank(item: Column, *paths: str) -> Column:
    ok = F.lit(True)
    for path in paths:
        ok = ok & (F.try_variant_get(item, f"$.{path}", "string") != "")
    return ok


def _workable_shape(item: Column) -> Column:
    from .registry import shape_ok

    job = item["job"]
    return shape_ok(job, {
        "shortcode": "S", "title": "S", "url": "S", "description": "S?", "employment_type": "S?~", "telecommuting": "B?~",
        "industry": "S?~", "function": "S?~", "city": "S?~", "state": "S?~", "country": "S?~",
    }) & _nonblank(job, "shortcode", "title", "url")


register_provider(Provider("Workable", _workable_items, _workable, accepts=_workable_shape))

_PERSONIO = (
    "position array<struct<id string, name string, office string, occupationCategory string, employmentType string, "
    "schedule string, createdAt string, jobDescriptions struct<jobDescription array<struct<name string, value string>>>>>"
)


def personio_host(board: Column) -> Column:
    """The careers host of a board: a bare label or a full careers host name, else null."""
    value = F.lower(trim_all(board))
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return F.when(value.rlike(f"^{label}$"), F.concat(value, F.lit(".jobs.personio.de"))).when(
        value.rlike(rf"^{label}\.jobs\.personio\.(?:de|com)$"), value
    )


def _personio(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    def section(part: Column) -> Column:
        heading = trim_all(F.coalesce(part["name"], F.lit("")))
        return let(
            html_to_text(F.coalesce(part["value"], F.lit(""))),
            lambda body: F.when(body == "", "").when(heading == "", body).otherwise(F.concat(heading, F.lit("\n"), body)),
        )

    def text(name: str) -> Column:
        return F.coalesce(item[name], F.lit(""))

    sections = F.transform(item["jobDescriptions"]["jobDescription"], section)
    url = F.concat(F.lit("https://"), personio_host(ctx["board"]), F.lit("/job/"), F.replace(F.url_encode(text("id")), F.lit("+"), F.lit("%20")))
    return {
        "external_id": text("id"),
        "title": text("name"),
        "company": first_nonblank(ctx["company"], ctx["board"]),
        "description": F.coalesce(F.array_join(F.filter(sections, lambda s: s != ""), "\n\n"), F.lit("")),
        "location": text("office"),
        "industry": text("occupationCategory"),
        "employment_type": employment_class("Personio", F.concat_ws(" ", text("employmentType"), text("schedule"))),
        "work_type": F.when(text("office").rlike("(?i)remote"), "Remote").otherwise("Unknown"),
        "job_url": F.coalesce(url, F.lit("")),
        "posted_at": iso_date(item["createdAt"]),
    }


register_provider(Provider(
    "Personio",
    lambda payload: F.from_xml(payload, _PERSONIO)["position"],
    _personio,
    accepts=lambda i: F.coalesce(i["id"] != "", F.lit(False)) & F.coalesce(i["name"] != "", F.lit(False)),
))


def _smartrecruiters(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    sections = [text_at(item, f"jobAd.sections.{n}.text") for n in ("jobDescription", "qualifications", "additionalInformation", "companyDescription")]
    country = text_at(item, "location.country")
    location = first_nonblank(
        text_at(item, "location.fullLocation"),
        join_nonblank(", ", text_at(item, "location.city"), text_at(item, "location.region"), country),
    )
    encode = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    public = F.concat(F.lit("https://jobs.smartrecruiters.com/"), encode(ctx["board"]), F.lit("/"), encode(text_at(item, "id")))
    return {
        "external_id": text_at(item, "id"),
        "title": html_to_text(text_at(item, "name")),
        "company": first_nonblank(text_at(item, "company.name"), ctx["company"], ctx["board"]),
        "description": html_to_text(join_nonblank("\n\n", *sections)),
        "location": location,
        "country": country,
        "industry": text_at(item, "industry.label"),
        "employment_type": employment_class("SmartRecruiters", text_at(item, "typeOfEmployment.label")),
        "work_type": work_class(flag_at(item, "location.remote"), location != ""),
        "job_url": F.coalesce(F.try_variant_get(item, "$.postingUrl", "string"), public),
        "posted_at": _date_at(item, "releasedDate"),
    }


register_provider(Provider(
    "SmartRecruiters", json_items("$.content"), _smartrecruiters,
    {"id": "SN", "name": "S", "releasedDate": "S?~", "company": "O?~", "location": "O?~", "industry": "O?~",
     "typeOfEmployment": "O?~", "postingUrl": "S?", "jobAd": "O?~"},
    accepts=lambda i: _nonblank(i, "name"),
))


def _rippling(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    location = F.array_join(F.filter(texts_at(item, "workLocations"), lambda p: p != ""), "; ")
    kind = F.concat(text_at(item, "employmentType.id"), F.lit(" "), text_at(item, "employmentType.label"))
    return {
        "external_id": text_at(item, "uuid"),
        "title": html_to_text(text_at(item, "name")),
        "company": first_nonblank(html_to_text(text_at(item, "companyName")), ctx["company"], ctx["board"]),
        "description": html_to_text(join_nonblank("\n\n", text_at(item, "description.role"), text_at(item, "description.company"))),
        "location": location,
        "industry": text_at(item, "department.label"),
        "employment_type": employment_class("Rippling", kind),
        "work_type": work_class(location.rlike("(?i)remote"), location != ""),
        "job_url": text_at(item, "url"),
        "posted_at": _date_at(item, "createdOn"),
    }


register_provider(Provider(
    "Rippling", json_items("$"), _rippling,
    {"uuid": "S", "name": "S", "url": "S", "description": "O?~", "companyName": "S?~", "employmentType": "O?~",
     "department": "O?~", "workLocations": "A?~", "createdOn": "S?~"},
    accepts=lambda i: _nonblank(i, "uuid", "name", "url"),
))
