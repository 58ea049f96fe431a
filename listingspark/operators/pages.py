"""What a crawled page says: structured postings, headings, body text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import with_once
from ..functions.text import html_to_text, join_nonblank, let, trim_all
from ..sources.registry import shape_ok, text_at


# A script element; its body is captured if its type is JSON-LD.
_LD_SCRIPT = r"(?is)<script(?![a-z0-9])(?:(?=[^<>]*?type=[\"']application/ld\+json[\"'])[^<>]*+>(.*?)|[^<>]*+>.*?)</script"

POSTING_SHAPE = {
    '$["@type"]': "S", "title": "S", "description": "S", "url": "S", "identifier": "SNO~?", "datePosted": "S~?",
    "validThrough": "S~?", "employmentType": "SA?", "jobLocationType": "S~?", "hiringOrganization": "O?",
    "hiringOrganization.name": "S?", "jobLocation": "OA~?", "applicantLocationRequirements": "OA~?", "baseSalary": "O~?",
    "baseSalary.currency": "S?", "baseSalary.value": "O?",
}


def is_posting(node: Column) -> Column:
    kind = F.try_variant_get(node, '$["@type"]', "string")
    return F.coalesce(kind == "JobPosting", F.lit(False)) & shape_ok(node, POSTING_SHAPE)


def jsonld_nodes(html: Column) -> Column:
    """All JSON-LD nodes of a page in order: a block may be one node, an array, or a graph.

    Blocks that are not valid JSON have no nodes.
    """
    head = F.regexp_extract(html, r"(?is)^.*</script", 0)
    blocks = F.filter(F.regexp_extract_all(head, F.lit(_LD_SCRIPT), F.lit(1)), lambda body: body != "")

    def nodes(block: Column) -> Column:
        return let(
            F.try_parse_json(block),
            lambda v: F.coalesce(
                F.try_variant_get(v, "$", "array<variant>"),
                F.try_variant_get(v, '$["@graph"]', "array<variant>"),
                F.when(v.isNotNull(), F.array(v)),
                F.array().cast("array<variant>"),
            ),
        )

    return F.flatten(F.transform(blocks, nodes))


def jsonld_postings(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per structured posting: ``page_id``, ``url``, position and the posting as a variant."""
    nodes = pages.select("page_id", "url", *keep, F.posexplode(jsonld_nodes(F.col("html"))).alias("pos", "item"))
    return nodes.filter(is_posting(F.col("item")))


def first_location(item: Column, *paths: str) -> Column:
    """A value under ``jobLocation``, which may be one object or an array whose first entry counts."""
    many = F.coalesce(*[F.try_variant_get(item, f"$.jobLocation[0].address{p}", "string") for p in paths])
    one = F.coalesce(*[F.try_variant_get(item, f"$.jobLocation.address{p}", "string") for p in paths])
    return F.coalesce(many, one, F.lit(""))


def country_of(item: Column) -> Column:
    """``addressCountry`` is a text or an object with a name."""
    named = first_location(item, ".addressCountry.name")
    kind = F.coalesce(
        F.schema_of_variant(F.try_variant_get(item, "$.jobLocation[0].address.addressCountry", "variant")),
        F.schema_of_variant(F.try_variant_get(item, "$.jobLocation.address.addressCountry", "variant")),
    )
    return F.when(kind == "STRING", first_location(item, ".addressCountry")).otherwise(named)


_H1 = rf"(?is)<h1(?![A-Za-z0-9-])[^<>]*+>(.*?)</h1(?![A-Za-z0-9-])"
_PLACE = (
    rf"(?is)<[A-Za-z0-9-]+(?![A-Za-z0-9-])[^<>]*?(?:class|id|data-[a-z-]+)=[\"'][^\"'>]*location[^\"'>]*[\"']"
    rf"[^<>]*+>(.*?)</"
)
_CONTAINER = (
    rf"(?is)<(div|section|article)(?![A-Za-z0-9-])(?=[^<>]*?(?:class|id|data-[a-z-]+)=[\"'][^\"'>]*description[^\"'>]*[\"'])"
    rf"[^<>]*+>"
)
_MAIN = rf"(?is)<(main|article)(?![A-Za-z0-9-])[^<>]*+>"


def _upto_last(html: Column, close: str) -> Column:
    """The page up to the last ``close``: past it a lazy search for it can only fail."""
    return F.regexp_extract(html, f"(?is)^.*{close}", 0)


def heading_text(html: Column) -> Column:
    """Text of the first top-level heading, or an empty string."""
    return html_to_text(F.regexp_extract(_upto_last(html, "</h1[^<>]*>"), _H1, 1))


def location_text(html: Column) -> Column:
    """Text of the first element whose class, id or data attribute names a location."""
    return html_to_text(F.regexp_extract(_upto_last(html, "</"), _PLACE, 1))


def balanced_container(html: Column) -> Column:
    """Inner HTML of the first description container, nesting respected; null if there is none.

    The tags of the container's own name are folded inside the row: a running depth
    over them finds the closing tag, so no tag ever leaves its page's row.
    """
    opening = F.regexp_extract(html, _CONTAINER, 0)
    name = F.lower(F.regexp_extract(html, _CONTAINER, 1))
    rest = F.substr(html, F.instr(html, opening) + F.length(opening))
    any_tag = rf"(?i)</?(?:div|section|article)(?![A-Za-z0-9-])[^<>]*+>"

    def inner(p: Column) -> Column:
        tags = F.regexp_extract_all(p["rest"], F.lit(any_tag), F.lit(0))

        def step(acc: Column, tag: Column) -> Column:
            mine = F.lower(F.regexp_extract(tag, r"^</?([A-Za-z0-9-]+)", 1)) == p["name"]
            change = F.when(~mine | tag.endswith("/>") & ~tag.startswith("</"), 0).when(tag.startswith("</"), -1).otherwise(1)
            done = acc["depth"] == 0
            return F.struct(
                F.when(done, 0).otherwise(acc["depth"] + change).alias("depth"),
                F.when(done, acc["tags"]).otherwise(acc["tags"] + 1).alias("tags"),
            )

        end = F.aggregate(tags, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("tags")), step)

        def cut(found: Column) -> Column:
            pieces = F.slice(F.split(p["rest"], any_tag, -1), F.lit(1), F.greatest(found["tags"], F.lit(1)))
            between = F.slice(tags, F.lit(1), F.greatest(found["tags"] - 1, F.lit(0)))
            joined = F.flatten(F.zip_with(pieces, between, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
            return F.when((found["depth"] == 0) & (found["tags"] > 0), F.array_join(joined, ""))

        return let(end, cut)

    return F.when(
        (opening != "") & ~opening.endswith("/>"),
        let(F.struct(name.alias("name"), rest.alias("rest")), inner),
    )


def main_content(html: Column) -> Column:
    """Contents of the first main or article element up to its first closing tag; null if there is none."""

    def one(v: Column) -> Column:
        opening = F.regexp_extract(v, _MAIN, 0)
        name = F.lower(F.regexp_extract(v, _MAIN, 1))
        rest = F.substr(v, F.instr(v, opening) + F.length(opening))
        main = F.regexp_extract(rest, r"(?is)^(.*?)</main(?![A-Za-z0-9-])[^<>]*>", 1)
        article = F.regexp_extract(rest, r"(?is)^(.*?)</article(?![A-Za-z0-9-])[^<>]*>", 1)
        closed = F.when(name == "main", rest.rlike(r"(?i)</main(?![A-Za-z0-9-])")).otherwise(rest.rlike(r"(?i)</article(?![A-Za-z0-9-])"))
        return F.when((opening != "") & closed, F.when(name == "main", main).otherwise(article))

    return let(html, one)


_CHROME_OPEN = rf"<(?:nav|header|footer)(?![A-Za-z0-9-])[^<>]*+>"
_CHROME = (
    rf"(?is)<(nav|header|footer)(?![A-Za-z0-9-])[^<>]*+>.*?</\1(?![A-Za-z0-9-])[^<>]*>"
    rf"|({_CHROME_OPEN}.*)"
)


def strip_chrome(html: Column) -> Column:
    """Each navigation, header and footer element becomes a space.

    The first one that never closes ends the search: the rest of the page is matched once and
    kept, so no later element is searched for again.
    """
    return F.regexp_replace(html, F.lit(_CHROME), F.lit(" $2"))


def page_body(html: Column) -> Column:
    """``struct(tier, text)``: the description container, else the main content, else the page without its chrome."""

    def choose(v: Column) -> Column:
        def second(container: Column) -> Column:
            return let(main_content(v), lambda main: F.when(
                F.coalesce(container, F.lit("")) != "", F.struct(F.lit(1).alias("tier"), html_to_text(container).alias("text"))
            ).when(
                F.coalesce(main, F.lit("")) != "", F.struct(F.lit(2).alias("tier"), html_to_text(main).alias("text"))
            ).otherwise(F.struct(F.lit(3).alias("tier"), html_to_text(strip_chrome(v)).alias("text"))))

        return let(balanced_container(v), second)

    return let(html, choose)


def page_posting(pages: DataFrame) -> DataFrame:
    """The posting a page carries: its structured one, else heading, location element and body."""
    first = F.get(F.filter(jsonld_nodes(F.col("html")), lambda n: is_posting(n) & (trim_all(text_at(n, "title")) != "")), 0)
    item, structured = F.col("item"), F.col("item").isNotNull()
    rows = with_once(pages.select("page_id", "url", "html"), item=first)
    titled = with_once(
        rows, title=F.when(structured, trim_all(text_at(item, "title"))).otherwise(heading_text(F.col("html")))
    ).filter(F.col("title") != "")
    place = join_nonblank(", ", first_location(item, ".addressLocality"), first_location(item, ".addressRegion"), country_of(item))
    return titled.select(
        "page_id", "url", "title",
        F.when(structured, place).otherwise(location_text(F.col("html"))).alias("location"),
        F.when(structured, html_to_text(text_at(item, "description")))
        .otherwise(page_body(F.col("html"))["text"]).alias("description"),
        F.when(structured, F.try_variant_get(item, "$.datePosted", "string")).alias("posted_at"),
        F.when(structured, "json-ld").otherwise("markup").alias("origin"),
    )
