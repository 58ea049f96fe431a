"""Provider registry: each feed is one declarative mapping from a raw item to the listing contract.

Landed payloads are rows ``(source_id, provider, board, company, page_no, payload)``.
A provider says where the items are, what an item must look like and how its fields
read; everything else (exploding, shape check, contract, quarantine) is shared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import content_hash, trim_all
from ..operators.contracts import LISTING_TEXT, listing_violations

CONTEXT = ("source_id", "board", "company", "page_no")


def _defaults() -> dict[str, Column]:
    return {
        "external_id": F.lit(""), "title": F.lit(""), "company": F.lit(""), "description": F.lit(""),
        "location": F.lit(""), "country": F.lit(""), "industry": F.lit(""),
        "employment_type": F.lit("Unknown"), "seniority": F.lit("Unknown"), "work_type": F.lit("Unknown"),
        "salary_min": F.lit(None).cast("double"), "salary_max": F.lit(None).cast("double"),
        "salary_period": F.lit("unknown"), "currency": F.lit("Unknown"), "job_url": F.lit(""),
        "posted_at": F.lit(None).cast("timestamp"),
    }


@dataclass(frozen=True)
class Provider:
    """One feed.

    ``items`` turns the payload column into an array of items (variants or structs),
    ``shape`` maps a path to the kinds it may have (see :func:`shape_ok`),
    ``fields`` maps an item and the source context to listing columns, and
    ``problem`` names an item that parses but cannot be a listing. ``after`` may refine the mapped
    rows, where a column needs another one that is costly to read twice.
    """

    name: str
    items: Callable[[Column], Column]
    fields: Callable[[Column, dict[str, Column]], dict[str, Column]]
    shape: dict[str, str] = field(default_factory=dict)
    problem: Callable[[Column], Column] | None = None
    can_mark_removals: bool = True
    max_pages: int | None = None
    accepts: Callable[[Column], Column] | None = None
    after: Callable[[DataFrame], DataFrame] | None = None


_providers: dict[str, Provider] = {}


def register_provider(provider: Provider) -> Provider:
    """Add or replace a feed mapping; this is the library's extension point."""
    _providers[provider.name] = provider
    return provider


def provider(name: str) -> Provider:
    return _providers[name]


def provider_names() -> list[str]:
    return sorted(_providers)


def json_items(path: str = "$") -> Callable[[Column], Column]:
    """The array at ``path`` of a JSON payload; an unreadable payload has no items."""
    return lambda payload: F.try_variant_get(F.try_parse_json(payload), path, "array<variant>")


def text_at(item: Column, path: str) -> Column:
    """A string or number as text; missing, null or anything else is an empty string."""
    return F.coalesce(F.try_variant_get(item, f"$.{path}", "string"), F.lit(""))


def number_at(item: Column, path: str) -> Column:
    return F.try_variant_get(item, f"$.{path}", "double")


def flag_at(item: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{path}", "boolean"), F.lit(False))


def texts_at(item: Column, path: str, inner: str | None = None) -> Column:
    """An array of texts; with ``inner`` an array of objects is read by that key."""
    if inner is None:
        return F.coalesce(F.try_variant_get(item, f"$.{path}", "array<string>"), F.array().cast("array<string>"))
    entries = F.try_variant_get(item, f"$.{path}", "array<variant>")
    return F.coalesce(F.transform(entries, lambda e: text_at(e, inner)), F.array().cast("array<string>"))


# The two letters each JSON kind's schema text begins with; a missing path has none.
_KINDS = {"S": "ST", "N": "BI DE DO FL", "B": "BO", "O": "OB", "A": "AR", "~": "VO", "?": "??"}


def shape_ok(item: Column, shape: dict[str, str]) -> Column:
    """Whether every path has one of the kinds its letters allow.

    Letters: S text, N number, B boolean, O object, A array, ``~`` null, ``?`` missing.
    """
    ok = F.lit(True)
    for path, letters in shape.items():
        full = path if path.startswith("$") else f"$.{path}"
        schema = F.schema_of_variant(F.try_variant_get(item, full, "variant"))
        allowed = F.lit(" ".join(_KINDS[letter] for letter in letters))
        ok = ok & allowed.contains(F.coalesce(F.substr(schema, F.lit(1), F.lit(2)), F.lit("??")))
    return ok


def explode_items(payloads: DataFrame, feed: Provider) -> DataFrame:
    """One row per raw item with its position, and whether it has the feed's shape."""
    pages = payloads if feed.max_pages is None else payloads.filter(F.col("page_no") <= feed.max_pages)
    items = pages.select(*CONTEXT, F.posexplode(feed.items(F.col("payload"))).alias("ordinal", "item"))
    shaped = shape_ok(F.col("item"), feed.shape)
    if feed.accepts is not None:
        shaped = shaped & F.coalesce(feed.accepts(F.col("item")), F.lit(False))
    return items.withColumn("shape_ok", F.coalesce(shaped, F.lit(False)))


def finish(rows: DataFrame, provider_name: str, extra: Iterable[str] = ()) -> DataFrame:
    """Hash, trim and check normalized rows against the listing contract."""
    hashed = rows.withColumn("description_hash", content_hash(F.col("description")))
    trimmed = hashed.withColumns({n: trim_all(F.col(n)) for n in LISTING_TEXT})
    violations = F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(listing_violations(trimmed=True))
    checked = trimmed.withColumn("violations", violations)
    return checked.select(
        *extra,
        "external_id",
        F.lit(provider_name).alias("provider"),
        *LISTING_TEXT,
        "employment_type", "seniority", "work_type",
        F.col("salary_min").try_cast("int").alias("salary_min"),
        F.col("salary_max").try_cast("int").alias("salary_max"),
        "salary_period", "currency", "job_url",
        F.col("job_url").alias("source_url"),
        "posted_at", "description_hash", "violations",
    )


def normalize(payloads: DataFrame, feed: Provider | str) -> DataFrame:
    """Landed payloads of one feed as contract rows. Rows that broke the item shape are left out here;
    :func:`split_rows` keeps them with a reason."""
    feed = provider(feed) if isinstance(feed, str) else feed
    return _map_items(explode_items(payloads, feed).filter("shape_ok"), feed)


def _map_items(items: DataFrame, feed: Provider) -> DataFrame:
    item = F.col("item")
    context = {name: F.coalesce(F.col(f"ctx_{name}").cast("string"), F.lit("")) for name in CONTEXT}
    named = items.select(*[F.col(n).alias(f"ctx_{n}") for n in CONTEXT], "ordinal", "item")
    columns = {**_defaults(), **feed.fields(item, context)}
    problem = feed.problem(item) if feed.problem else F.lit(None).cast("string")
    mapped = named.select(
        F.col("ctx_source_id").alias("source_id"), F.col("ctx_page_no").alias("page_no"), "ordinal",
        *[c.alias(n) for n, c in columns.items()], problem.alias("problem"),
    )
    if feed.after is not None:
        mapped = feed.after(mapped)
    return finish(mapped, feed.name, ("source_id", "page_no", "ordinal"))


def normalize_all(payloads: DataFrame) -> DataFrame:
    """Every registered feed over one payload table, as one set of contract rows."""
    parts = [normalize(payloads.filter(F.col("provider") == name), name) for name in provider_names()]
    return reduce(DataFrame.unionByName, parts)


def split_rows(payloads: DataFrame, feed: Provider | str) -> DataFrame:
    """Every item with its fate: ``good``, ``skipped`` (wrong shape) or ``failed`` (contract)."""
    feed = provider(feed) if isinstance(feed, str) else feed
    items = explode_items(payloads, feed)
    mapped = _map_items(items.filter("shape_ok"), feed).select(
        "source_id", "page_no", "ordinal", "external_id",
        F.when(F.size("violations") == 0, "good").otherwise("failed").alias("fate"),
        F.array_join("violations", ",").alias("reason"),
    )
    skipped = items.filter(~F.col("shape_ok")).select(
        "source_id", "page_no", "ordinal", F.lit(None).cast("string").alias("external_id"),
        F.lit("skipped").alias("fate"), F.lit("shape").alias("reason"),
    )
    return mapped.unionByName(skipped)
