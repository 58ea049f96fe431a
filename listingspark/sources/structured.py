"""Postings found in pages and saved API responses, normalized to the listing contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dates import iso_date
from ..functions.labels import employment_class, external_id, period_unit
from ..functions.numbers import currency_of, salary_lenient
from ..functions.rows import with_once
from ..functions.text import first_nonblank, html_to_text, join_nonblank, let, trim_all
from ..functions.urls import ATS_HOSTS, canonical_url, pointer_get, pointer_text, registrable_domain, resolve_url, url_admitted, url_struct
from ..operators.joins import spread_join
from ..operators.pages import country_of, first_location, jsonld_postings
from .registry import Provider, _map_items, finish, register_provider, text_at, texts_at



def no_description(url: Column) -> Column:
    return F.concat(F.lit("No description was captured for this posting. See the original listing at "), url)


def _salary_text(item: Column, name: str) -> Column:
    return salary_lenient(F.try_variant_get(item, f"$.baseSalary.value.{name}", "string"))


def _identifier(item: Column) -> Column:
    """A text, a number, or an object holding either under ``value``."""
    inner = F.try_variant_get(item, "$.identifier.value", "string")
    kind = F.schema_of_variant(F.try_variant_get(item, "$.identifier", "variant"))
    return F.when(kind.startswith("OBJECT"), inner).otherwise(F.try_variant_get(item, "$.identifier", "string"))


def _jsonld(item: Column, ctx: dict[str, Column]) -> dict[str, Column]:
    place = join_nonblank(", ", first_location(item, ".addressLocality"), first_location(item, ".addressRegion"))
    listed = F.filter(
        F.concat(texts_at(item, "applicantLocationRequirements", "name"), F.array(text_at(item, "applicantLocationRequirements.name"))),
        lambda n: n != "",
    )
    applicants = F.when(F.size(listed) > 0, F.concat(F.lit("Applicants: "), F.array_join(listed, ", "))).otherwise("")
    kinds = F.try_variant_get(item, "$.employmentType", "array<string>")
    kind = F.when(kinds.isNotNull(), F.array_join(kinds, " ")).otherwise(text_at(item, "employmentType"))
    single = _salary_text(item, "value")
    return {
        "external_id": external_id(_identifier(item), text_at(item, "url")),
        "title": text_at(item, "title"),
        "company": first_nonblank(text_at(item, "hiringOrganization.name"), ctx["company"], ctx["board"]),
        "description": html_to_text(text_at(item, "description")),
        "location": join_nonblank(" · ", place, applicants),
        "country": country_of(item),
        "employment_type": employment_class("JSON-LD", kind),
        "work_type": F.when(text_at(item, "jobLocationType").rlike("(?i)TELECOMMUTE"), "Remote").otherwise("Unknown"),
        "salary_min": F.coalesce(_salary_text(item, "minValue"), single).cast("double"),
        "salary_max": F.coalesce(_salary_text(item, "maxValue"), single).cast("double"),
        "salary_period": period_unit(F.try_variant_get(item, "$.baseSalary.value.unitText", "string")),
        "currency": currency_of(F.upper(text_at(item, "baseSalary.currency"))),
        "job_url": text_at(item, "url"),
        "posted_at": iso_date(F.try_variant_get(item, "$.datePosted", "string")),
    }


def _remote_by_text(rows: DataFrame) -> DataFrame:
    """A posting whose title or text speaks of remote work is remote."""
    spoken = F.concat_ws(" ", "title", "description").rlike("(?i)remote")
    return rows.withColumn("work_type", F.when(spoken, "Remote").otherwise(F.col("work_type")))


JSON_LD = register_provider(
    Provider("JSON-LD", lambda payload: F.array().cast("array<variant>"), _jsonld, after=_remote_by_text)
)


def normalize_jsonld(pages: DataFrame) -> DataFrame:
    """Structured postings of landed pages (``page_id, url, html, source_id, board, company``) as contract rows."""
    found = jsonld_postings(pages, "source_id", "board", "company")
    items = found.select("source_id", "board", "company", F.col("page_id").alias("page_no"), F.col("pos").alias("ordinal"), "item")
    return _map_items(items, JSON_LD)


def normalize_careers(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Structured postings of a company's own careers pages.

    A relative URL is resolved against its page, postings outside the company's domain and
    the known ATS hosts are dropped; ``most`` bounds what one source yields. ``start_url`` is
    the source's careers URL. Such a scan never proves a complete inventory.
    """
    found = jsonld_postings(pages, "source_id", "board", "company", "start_url")
    resolved = with_once(
        found, abs=resolve_url(F.try_variant_get("item", "$.url", "string"), url_struct(F.col("url"))),
        home=registrable_domain(url_struct(F.col("start_url"))["host"]),
    ).filter(url_admitted(F.col("abs")))
    hosted = with_once(resolved, host=url_struct(F.col("abs"))["host"])
    allowed = hosted.filter(
        F.coalesce(registrable_domain(F.col("host")) == F.col("home"), F.lit(False)) | F.col("host").rlike(ATS_HOSTS)
    )
    keyed = with_once(allowed, eid=external_id(_identifier(F.col("item")), F.col("abs")))
    # the place of an identity is where it first occurs, its content the last one seen
    place = F.struct("page_id", "pos")
    content = F.struct("board", "company", "page_id", "pos", "item", "abs")
    last = keyed.groupBy("source_id", "eid").agg(F.min(place).alias("first"), F.max_by(content, place).alias("last"))
    if most is not None:
        last = last.withColumn("rank", F.row_number().over(Window.partitionBy("source_id").orderBy("first"))).filter(F.col("rank") <= most)
    items = last.select(
        F.col("source_id").alias("ctx_source_id"), F.col("last.board").alias("ctx_board"),
        F.col("last.company").alias("ctx_company"), F.col("last.page_id").alias("page_no"),
        F.col("last.pos").alias("ordinal"), F.col("last.item").alias("item"), F.col("last.abs").alias("abs"), "eid",
    )
    context = {"company": F.coalesce(F.col("ctx_company"), F.lit("")), "board": F.coalesce(F.col("ctx_board"), F.lit(""))}
    columns = {**_jsonld(F.col("item"), context), "external_id": F.col("eid"), "job_url": F.col("abs")}
    mapped = items.select(
        F.col("ctx_source_id").alias("source_id"), "page_no", "ordinal",
        *[c.alias(n) for n, c in columns.items()],
        F.lit("").alias("industry"), F.lit("Unknown").alias("seniority"), F.lit(None).cast("string").alias("problem"),
    )
    return finish(_remote_by_text(mapped), "Careers", ("source_id", "page_no", "ordinal"))


def paged_payloads(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Items of saved API responses, the way a replay reads them.

    ``pages`` has ``source_id, page_no, payload`` and the source's ``jobs_path``. Pages are read
    in order up to the first empty one, at most ``max_pages``; every item carries its position in that order.
    """
    array = F.try_variant_get(
        pointer_get(F.try_parse_json(F.col("payload")), F.col("jobs_path")), "$", "array<variant>"
    )
    first = pages.filter(F.col("page_no") >= 1)
    sized = with_once(first if max_pages is None else first.filter(F.col("page_no") <= max_pages), items=array)
    empty = F.when(F.coalesce(F.size("items"), F.lit(0)) == 0, F.col("page_no"))
    # one small row per page decides where reading stops; the payloads move once, spread within a source
    stops = sized.groupBy("source_id").agg(F.min(empty).alias("stop"), F.max("page_no").alias("last_page"))
    read = spread_join(sized, stops, "source_id", "page_no", counted=pages).filter(F.col("stop").isNull() | (F.col("page_no") < F.col("stop")))
    cut = F.lit(False) if max_pages is None else F.col("stop").isNull() & (F.col("last_page") >= max_pages)
    return read.withColumn("ran_out", cut)


def captured_url(item: Column, pointer: Column, template: Column) -> Column:
    """The posting's absolute HTTPS URL, resolved against the saved request; else null."""
    raw = pointer_text(item, pointer)
    return let(
        F.when(raw != "", resolve_url(raw, url_struct(template))), lambda u: F.when(u.startswith("https://"), u)
    )


def captured_items(pages: DataFrame, patterns: DataFrame, max_pages: int | None = None, max_items: int | None = None) -> DataFrame:
    """Usable items of saved API responses with the pattern that reads them.

    ``patterns`` has one row per source: ``url_template, jobs_path`` and a JSON pointer per field
    (``title, url, id, location, description, posted_at``; null when unmapped).
    """
    pointers = [f"p_{n}" for n in ("title", "url", "id", "location", "description", "posted_at")]
    read = paged_payloads(spread_join(pages, patterns.select("source_id", "url_template", "jobs_path", *pointers), "source_id", "page_no"), max_pages)
    items = read.select(
        "source_id", "board", "company", "page_no", "url_template", *pointers, "ran_out", F.posexplode("items").alias("ordinal", "item")
    ).filter(F.schema_of_variant("item").startswith("OBJECT"))
    read_items = with_once(
        items, abs=captured_url(F.col("item"), F.col("p_url"), F.col("url_template")),
        title=pointer_text(F.col("item"), F.col("p_title")), place=F.struct("page_no", "ordinal"),
    )
    usable = read_items.filter(F.col("abs").isNotNull() & (F.col("title") != ""))
    if max_items is None:
        return usable
    order = Window.partitionBy("source_id").orderBy("place")
    return usable.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max_items)


def replay_status(items: DataFrame, max_items: int | None = None) -> DataFrame:
    """Per source: items read and whether they prove the whole inventory. A bound that was hit proves nothing."""
    below = F.lit(True) if max_items is None else F.col("items") < max_items
    return items.groupBy("source_id").agg(F.count("*").alias("items"), F.max("ran_out").alias("ran_out")).select(
        "source_id", "items", (~F.col("ran_out") & below).alias("complete")
    )


def normalize_field_map(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Saved API responses as contract rows through their source's pointers."""
    item, url = F.col("item"), F.col("abs")
    rows = with_once(
        captured_items(pages, patterns), captured=pointer_text(item, F.col("p_description")), location=pointer_text(item, F.col("p_location"))
    )
    captured, title, location = F.col("captured"), F.col("title"), F.col("location")
    columns = {
        "external_id": first_nonblank(pointer_text(item, F.col("p_id")), canonical_url(url)),
        "title": title,
        "company": first_nonblank(F.col("company"), F.col("board")),
        "description": F.when(F.length(captured) >= 20, captured).otherwise(no_description(url)),
        "location": location,
        "work_type": F.when(F.concat(title, F.lit(" "), location).rlike("(?i)remote"), "Remote").otherwise("Unknown"),
        "job_url": url,
        "posted_at": iso_date(pointer_text(item, F.col("p_posted_at"))),
    }
    return _finish_plain(rows, columns, "CapturedApi", ("source_id", "page_no", "ordinal"))


def normalize_crawled(rows: DataFrame) -> DataFrame:
    """Extracted page rows (``url, title, location, description, posted_at, id, company, board``) as contract rows."""
    text = trim_all(F.col("description"))
    columns = {
        "external_id": first_nonblank(trim_all(F.col("id")), canonical_url(F.col("url"))),
        "title": F.col("title"),
        "company": first_nonblank(F.col("company"), F.col("board")),
        "description": F.when(F.length(text) >= 20, text).otherwise(no_description(F.col("url"))),
        "location": F.col("location"),
        "work_type": F.when(F.concat_ws(" ", "title", "location").rlike("(?i)remote"), "Remote").otherwise("Unknown"),
        "job_url": F.col("url"),
        "posted_at": iso_date(F.col("posted_at")),
    }
    return _finish_plain(rows, columns, "Browser", ("source_id",))


def _finish_plain(rows: DataFrame, columns: dict[str, Column], provider: str, extra: tuple[str, ...]) -> DataFrame:
    from .registry import _defaults

    mapped = rows.select(
        *extra, *[c.alias(n) for n, c in {**_defaults(), **columns}.items()], F.lit(None).cast("string").alias("problem")
    )
    return finish(mapped, provider, extra)
