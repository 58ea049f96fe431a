"""Bounded walks over stored links, and the cheapest way to read a site."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage


def link_walk(starts: DataFrame, links: DataFrame, found: DataFrame, max_pages: int | None = None, max_listings: int | None = None) -> DataFrame:
    """Breadth-first walk per source over a link table: the pages read, in order, and whether it ended early.

    ``starts``: ``source_id, url``. ``links``: ``url, pos, href`` (only links that may be followed).
    ``found``: ``url, listings`` per page. A walk ends when no link leads to a page it has not read or, where bounds are
    given, after ``max_pages`` pages or once ``max_listings`` listings were found; what is still queued then makes it incomplete.

    Each round reads the next level of every walk at once: as many rounds as the deepest walk has levels. With a page
    bound, a level adds at most the pages a walk has left.
    """
    counted = found.select("url", "listings")
    level = starts.select("source_id", "url", F.lit(1).alias("place"), F.lit(0).alias("depth"))
    visited = level
    for depth in count(1) if max_pages is None else range(1, max_pages + 1):
        reached = level.join(links, "url").select("source_id", "place", "pos", F.col("href").alias("url"))
        fresh = reached.groupBy("source_id", "url").agg(F.min(F.struct("place", "pos")).alias("at")).join(
            visited.select("source_id", "url"), ["source_id", "url"], "left_anti"
        )
        used = visited.groupBy("source_id").agg(F.count("*").alias("used"))
        order = Window.partitionBy("source_id").orderBy("at", "url")
        # one page past the bound is kept: it shows that something was left in the queue
        ranked = fresh.withColumn("n", F.row_number().over(order))
        if max_pages is not None:
            ranked = ranked.filter(F.col("n") <= max_pages + 1)
        level = ranked.join(used, "source_id").select(
            "source_id", "url", (F.col("used") + F.col("n")).cast("int").alias("place"), F.lit(depth).alias("depth")
        )
        if max_pages is not None:
            level = level.filter(F.col("place") <= max_pages + 1)
        level = cut_lineage(level, "walk-level")
        if level.isEmpty():
            break
        visited = cut_lineage(visited.unionByName(level), "walk-visited")
    counts = visited.join(counted, "url", "left").withColumn("listings", F.coalesce("listings", F.lit(0)))
    running = Window.partitionBy("source_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("listings").over(running), F.lit(0)))
    read = F.lit(True) if max_pages is None else F.col("place") <= max_pages
    if max_listings is not None:
        read = read & (F.col("before") < max_listings)
    return before.withColumn("read", read).select("source_id", "place", "url", "depth", "listings", "before", "read")


def walk_summary(walk: DataFrame, max_listings: int | None = None) -> DataFrame:
    """Per source: pages read, listings kept, and whether the walk saw everything it could reach."""
    listings = F.sum(F.when(F.col("read"), F.col("listings")))
    return walk.groupBy("source_id").agg(
        F.count_if("read").alias("pages"), (listings if max_listings is None else F.least(listings, F.lit(max_listings))).alias("listings"),
        (F.bool_and("read") if max_listings is None else F.bool_and("read") & (listings <= max_listings)).alias("complete"),
    )


def choose_strategy(sites: DataFrame, vendors: DataFrame, structured: DataFrame, patterns: DataFrame, crawled: DataFrame) -> DataFrame:
    """The cheapest way to read each site: a supported vendor board, structured postings, a saved request
    that still works, page extraction, and only then the fallback.

    ``vendors``: ``page_id, vendor, board, supported``; ``structured`` and ``crawled``: ``page_id``;
    ``patterns``: ``page_id`` of sites whose saved request was verified.
    """
    def flagged(df: DataFrame, name: str) -> DataFrame:
        return df.select("page_id").distinct().withColumn(name, F.lit(True))

    joined = (
        sites.join(vendors.select("page_id", "vendor", "board", "supported"), "page_id", "left")
        .join(flagged(structured, "has_jsonld"), "page_id", "left")
        .join(flagged(patterns, "has_pattern"), "page_id", "left")
        .join(flagged(crawled, "has_markup"), "page_id", "left")
    )
    strategy = (
        F.when(F.coalesce("supported", F.lit(False)), "ats").when(F.col("has_jsonld"), "json-ld")
        .when(F.col("has_pattern"), "captured-api").when(F.col("has_markup"), "browser").otherwise("ai")
    )
    provider = (
        F.when(F.col("strategy") == "ats", F.col("vendor")).when(F.col("strategy") == "captured-api", "CapturedApi")
        .when(F.col("strategy") == "browser", "Browser").otherwise("Careers")
    )
    return joined.withColumn("strategy", strategy).select(
        *sites.columns, "strategy", provider.alias("provider"), F.col("vendor").alias("detected"),
        F.when(F.col("strategy") == "ats", F.col("board")).alias("board"),
    )
