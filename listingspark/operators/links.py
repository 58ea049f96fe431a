"""Anchors of crawled pages: link tables, careers links, vendor boards, posting and paging links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.labels import SUPPORTED_VENDORS
from ..functions.rows import firsts_by, with_once
from ..functions.text import collapse, html_to_text, let
from ..functions.urls import ATS_HOSTS, as_https, host_allowed, registrable_domain, resolve_url, url_struct, url_text

# Words that make a link read like a careers link.
CAREER_TERMS = (
    "careers", "career", "jobs", "open positions", "open roles", "opportunities", "join us", "join our team",
    "work with us", "we're hiring", "we are hiring", "employment",
)
# What a link to a careers section says.
CAREER_SIGNAL = r"(?i)career|job|hiring|open|role|position|vacanc|recruit|apply|talent|join|employment"
# Path segments below which postings stand.
POSTING_SEGMENTS = "job jobs position positions opening openings role roles career careers vacancy vacancies".split()

# A start tag holds no raw "<". Its rest is matched possessively or in an atomic group, so that one that never ends
# costs one look at the text up to the next "<", and a page of unclosed tags stays linear however long its tags are.
_HREF = r"href=[\"']([^\"'#]+)[\"']"
_ANCHOR = rf"(?is)<a(?![A-Za-z0-9_])(?>[^<>]*{_HREF})[^<>]*+>(.*?)</a>"


def anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """Every anchor with its position: absolute https URL without fragment, and its text.

    ``pages`` has ``page_id``, ``url`` and ``html``. Only the text up to the last
    closing anchor can hold a complete one, so the lazy match stays linear.
    """
    head = F.regexp_extract(F.col("html"), r"(?is)^.*</a>", 0)
    # once: the explode below would otherwise search every page a second time, in a filter on the number of tags
    found = with_once(
        pages.select("page_id", *keep, "html", "url"), tags=F.regexp_extract_all(head, F.lit(_ANCHOR), F.lit(0)), base=url_struct(F.col("url"))
    ).select(
        "page_id", *keep, "base", F.posexplode("tags").alias("pos", "tag")
    )
    text = collapse(F.regexp_replace(F.regexp_extract("tag", _ANCHOR, 2), r"<[^<>]+>", " "))
    href = as_https(resolve_url(F.regexp_extract("tag", _ANCHOR, 1), F.col("base")))
    return with_once(found, href=href, text=text).drop("tag").filter(F.col("href").isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    return anchors(pages).select("page_id", "pos", "href", "text")


def looks_like_posting(path: Column) -> Column:
    """A segment whose first word names a list of postings, with something below it, or one that ends in a number of three digits or more."""

    def below(p: Column) -> Column:
        named = lambda i: F.regexp_extract(F.get(p, i), "^[a-z0-9_]*", 0).isin(*POSTING_SEGMENTS)
        return F.exists(F.sequence(F.lit(1), F.size(p) - 1), lambda i: named(i) & (F.array_max(F.transform(F.slice(p, i + 2, F.size(p)), F.length)) > 0))

    return path.rlike(r"/[^/]*-[0-9]{3,}") | let(F.split(F.lower(path), "/"), lambda p: F.when(F.size(p) > 2, F.coalesce(below(p), F.lit(False))).otherwise(False))


def career_score(text: Column, path: Column, same_domain: Column) -> Column:
    """How much a link reads like a careers destination."""

    def rate(p: Column) -> Column:
        score = F.lit(0)
        for term in CAREER_TERMS:
            slug = term.replace(" ", "-")
            score = score + F.when(p["text"] == term, 6).when(p["text"].contains(term), 3).otherwise(0)
            score = score + F.when(F.array_contains(p["segments"], slug), 5).when(p["path"].contains(slug), 1).otherwise(0)
        return score - F.when(p["path"].contains("/blog/") | p["path"].contains("/news/"), 4).otherwise(0)

    seen = let(F.lower(path), lambda low: F.named_struct(
        F.lit("text"), F.lower(text), F.lit("path"), low, F.lit("segments"), F.split(low, "/")
    ))
    return let(seen, rate) + F.when(~same_domain, 2).otherwise(0)


def _anchor_entries(base: Column) -> Column:
    """The anchors of ``html`` as an array of ``href, pos, text``; pages without any have an empty one."""
    tags = F.regexp_extract_all(F.regexp_extract("html", r"(?is)^.*</a>", 0), F.lit(_ANCHOR), F.lit(0))
    entry = lambda tag, i: F.struct(
        as_https(resolve_url(F.regexp_extract(tag, _ANCHOR, 1), base)).alias("href"), i.alias("pos"),
        collapse(F.regexp_replace(F.regexp_extract(tag, _ANCHOR, 2), r"<[^<>]+>", " ")).alias("text"),
    )
    return F.filter(F.transform(tags, entry), lambda a: a["href"].isNotNull())


def rank_career_links(pages: DataFrame) -> DataFrame:
    """Per page the links that lead to its careers section, best first; one row per URL. All of it happens in the page's row."""
    based = with_once(pages.select("page_id", "url", "html"), base=url_struct(F.col("url")))
    found = with_once(based, links=_anchor_entries(F.col("base")), home=registrable_domain(F.col("base.host"))).select("page_id", "links", "home")

    def rate(link: Column) -> Column:
        def judge(target: Column) -> Column:
            same = F.coalesce(registrable_domain(target["host"]) == F.col("home"), F.lit(False))
            return let(same, lambda s: F.when(s | target["host"].rlike(ATS_HOSTS), career_score(link["text"], target["path"], s)))

        return F.struct(link["href"].alias("href"), (-let(url_struct(link["href"]), judge)).alias("loss"), link["pos"].alias("pos"))

    scored = with_once(found, scored=F.filter(F.transform("links", rate), lambda x: x["loss"] < 0)).select("page_id", "scored")
    # both are ordered by href: the best score of each, and where it first occurs
    best = firsts_by(F.col("scored"), "href")
    place = firsts_by(F.transform("scored", lambda x: F.struct(x["href"].alias("href"), x["pos"].alias("pos"))), "href")
    merged = F.array_sort(F.zip_with(best, place, lambda x, y: F.struct(x["loss"].alias("loss"), y["pos"].alias("pos"), x["href"].alias("href"))))
    return scored.select("page_id", F.posexplode(merged).alias("place", "x")).select(
        "page_id", F.col("x.href").alias("href"), (-F.col("x.loss")).alias("score"), (F.col("place") + 1).alias("rank")
    )


def _segments(parts: Column) -> Column:
    return F.filter(F.split(parts["path"], "/"), lambda s: s != "")


def _query_value(parts: Column, name: str) -> Column:
    pairs = F.filter(F.split(parts["query"], "&"), lambda p: p.startswith(f"{name}="))
    return F.try_url_decode(F.substr(F.get(pairs, 0), F.lit(len(name) + 2)))


def detect_vendor(url: Column) -> Column:
    """``struct(vendor, board)`` when the URL is on a known vendor's host, else null. Rules in priority order."""

    def rules(p: Column) -> Column:
        host = p["host"]
        seg = _segments(p)
        first = F.coalesce(F.get(seg, 0), F.lit(""))
        third = F.coalesce(F.get(seg, 2), F.lit(""))
        label = F.regexp_extract(host, r"^([a-z0-9-]+)\.", 1)
        greenhouse = F.coalesce(_query_value(p, "for"), F.when(first == "v1", third).when(first == "embed", "").otherwise(first))
        found = [
            ("Greenhouse", host.rlike(r"^(boards|job-boards|boards-api)\.greenhouse\.io$"), greenhouse),
            ("Lever", host.rlike(r"^(jobs|api)\.lever\.co$"), F.when(first == "v0", third).otherwise(first)),
            ("Ashby", host.rlike(r"^(jobs|api)\.ashbyhq\.com$"), F.when(first == "posting-api", "").otherwise(first)),
            ("Workable", host == "apply.workable.com", F.when(first == "j", "").otherwise(first)),
            ("Workable", host.rlike(r"^[a-z0-9-]+\.workable\.com$") & ~host.rlike(r"^(apply|www)\."), label),
            ("Personio", host.rlike(r"^[a-z0-9-]+\.jobs\.personio\.(?:de|com)$"), label),
            ("Rippling", host == "ats.rippling.com", first),
            ("Workday", host.rlike(r"^[a-z0-9-]+\.wd[0-9]+\.myworkdayjobs\.com$"), label),
            ("SmartRecruiters", host == "jobs.smartrecruiters.com", first),
            ("iCIMS", host.rlike(r"^[a-z0-9-]+\.icims\.com$"), label),
            ("Taleo", host.rlike(r"^[a-z0-9-]+\.taleo\.net$"), label),
        ]
        result = F.lit(None).cast("struct<vendor:string,board:string>")
        for vendor, matches, board in reversed(found):
            result = F.when(matches & (board != ""), F.struct(F.lit(vendor).alias("vendor"), board.alias("board"))).otherwise(result)
        return result

    return let(url_struct(url), rules)


_EMBED = r"(?is)<(?:script|iframe|link|embed)(?![A-Za-z0-9_])[^<>]*?(?:src|href)=[\"']([^\"']+)[\"']"


def detect_ats(pages: DataFrame) -> DataFrame:
    """The vendor board each page points to: the first URL that names one.

    In the order they are believed: the page's own URL, its redirect ``chain`` (an array column), embedded
    resources, then anchors that present themselves as a careers link. All of it happens in the page's row.
    """
    chain = F.coalesce("chain", F.array().cast("array<string>")) if "chain" in pages.columns else F.array().cast("array<string>")
    based = with_once(pages.select("page_id", "url", "html", chain.alias("chain")), base=url_struct(F.col("url")))
    # bounded like the anchors; the first src or href of the tag counts
    embeds = F.transform(F.regexp_extract_all("html", F.lit(_EMBED), F.lit(1)), lambda raw: resolve_url(raw, F.col("base")))
    signed = F.filter(_anchor_entries(F.col("base")), lambda a: a["text"].rlike(CAREER_SIGNAL) | url_struct(a["href"])["path"].rlike(CAREER_SIGNAL))
    urls = F.concat(F.array("url"), "chain", embeds, F.transform(signed, lambda a: a["href"]))
    hit = F.get(F.filter(F.transform(urls, detect_vendor), lambda v: v.isNotNull()), 0)
    return with_once(based, hit=hit).filter("hit IS NOT NULL").select(
        "page_id", F.col("hit.vendor").alias("vendor"), F.col("hit.board").alias("board"), F.col("hit.vendor").isin(*SUPPORTED_VENDORS).alias("supported"),
    )


_START_TAG = rf"(?i)<a(?![A-Za-z0-9-])[^<>]*+>"


def _tags(pages: DataFrame) -> DataFrame:
    """Pages with the base of their links and, as arrays, their anchors' start tags."""
    rows = pages.select("page_id", "url", F.regexp_extract_all(F.col("html"), F.lit(_START_TAG), F.lit(0)).alias("tags"), "html")
    return with_once(rows, base=url_struct(F.col("url")))


def _may_follow(link: Column) -> Column:
    return link["href"].isNotNull() & host_allowed(link["href"], F.col("base.host")) & (link["href"] != url_text(F.col("base")))


def posting_links(pages: DataFrame) -> DataFrame:
    """Same-site links whose path looks like one posting; the first occurrence of a URL is kept. No row leaves its page."""
    raws = F.filter(F.transform("tags", lambda t, i: F.struct(F.regexp_extract(t, rf"(?i){_HREF}", 1).alias("raw"), i.alias("pos"))), lambda r: r["raw"] != "")
    rows = with_once(_tags(pages).drop("html"), raws=firsts_by(raws, "raw")).drop("tags")  # a link is resolved once, however often it stands on the page
    links = F.transform("raws", lambda r: F.struct(resolve_url(r["raw"], F.col("base")).alias("href"), r["pos"].alias("pos")))
    kept = F.filter(links, lambda x: _may_follow(x) & looks_like_posting(url_struct(x["href"])["path"]))
    return with_once(rows, links=firsts_by(kept, "href")).select("page_id", F.inline("links"))


def next_page(pages: DataFrame) -> DataFrame:
    """The first link a page marks as its next page: ``rel=next`` or the label "next". No row leaves its page."""
    after = F.slice(F.split(F.col("html"), _START_TAG, -1), F.lit(2), F.lit(2**30))
    label = lambda text: F.regexp_extract(text, r"(?is)^(.*?)(?:</a(?![A-Za-z0-9_])|$)", 1)
    marked = lambda tag, text: tag.rlike(r"(?i)rel=[\"']next[\"']") | (F.lower(html_to_text(label(text))) == "next")
    raw = F.zip_with("tags", after, lambda tag, text: F.when(marked(tag, text), F.regexp_extract(tag, rf"(?i){_HREF}", 1)))
    rows = with_once(_tags(pages), raws=F.array_distinct(F.filter(raw, lambda r: r.isNotNull() & (r != "")))).drop("tags", "html")
    links = F.filter(F.transform("raws", lambda r: F.struct(resolve_url(r, F.col("base")).alias("href"))), _may_follow)
    return with_once(rows, first=F.get(links, 0)).filter("first IS NOT NULL").select("page_id", "first.href")


def page_evidence(pages: DataFrame, max_links: int | None = None, max_length: int | None = None) -> DataFrame:
    """The links kept as evidence for a page, in order: all, or the first ones within a number or a total length."""
    links = anchors(pages)
    order = Window.partitionBy("page_id").orderBy("pos")
    ranked = links.withColumn("n", F.row_number().over(order))
    if max_links is not None:
        ranked = ranked.filter(F.col("n") <= max_links)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.length("href") + F.length("text")).over(running)
    measured = ranked.withColumn("total", total)
    if max_length is not None:
        measured = measured.filter(F.col("total") <= max_length)
    return (
        measured
        .select("page_id", "n", "href", "text", F.col("total").alias("running_length"))
    )


def page_text(html: Column, limit: int | None = None) -> Column:
    """The text kept as evidence for a page."""
    text = html_to_text(html)
    return text if limit is None else F.substr(text, F.lit(1), F.lit(limit))


def claims_grounded(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether every claim extracted from a page is supported by it; one bad claim voids the set.

    ``claims`` has ``page_id``, ``url``, ``title``, ``description`` and ``location``. A URL must
    be the page's own or one of its evidence links; the texts must occur in the page text.
    """
    seen = page_evidence(pages).select("page_id", F.col("href").alias("url")).unionByName(
        pages.select("page_id", "url")
    ).distinct().withColumn("observed", F.lit(True))
    evidence = pages.select("page_id", let(page_text(F.col("html")), lambda t: F.lower(collapse(t))).alias("evidence"))
    joined = claims.join(seen, ["page_id", "url"], "left").join(evidence, "page_id", "left")

    def occurs(name: str) -> Column:
        return F.coalesce(F.col("evidence").contains(F.lower(collapse(F.col(name)))), F.lit(False))

    supported = (
        F.coalesce(F.col("observed"), F.lit(False)) & occurs("title") & occurs("description")
        & ((F.col("location") == "") | occurs("location"))
    )
    return joined.groupBy("page_id").agg(
        F.count("*").alias("claims"), F.bool_and(supported).alias("grounded"),
        F.count_if(~supported).alias("unsupported"),
    )


# What pages that test their visitor contain.
CHALLENGE = (
    r"(?i)g-recaptcha|hcaptcha|cf-challenge|turnstile|verify you are (a )?human|are you a robot"
    r"|enable javascript and cookies to continue"
)


def challenge_page(html: Column) -> Column:
    """The page asks its visitor to prove to be human."""
    return html.rlike(CHALLENGE)
