"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step replaces links by links to smaller nodes, with joins and aggregates that combine on the map side; it ends
when the links are stars around each component's smallest node, after a number of steps that grows with the logarithm
of the nodes. Every step's links are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .texts import written


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links`` (``a, b``); root is the component's smallest node."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(nearest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(moved.unionByName(nearest.withColumnRenamed("m", "v")).distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def rooted(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` (``a, b``) with ``root_a, root_b``; a node without a root is its own."""
    for x in ("a", "b"):
        links = links.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
    return links


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further ``links`` (``a, b``), whose ends are contracted to their roots: only these go through the steps."""
    tops = written(components(rooted(links, roots).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))), "tops")
    above = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = roots.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(tops.join(roots, "node", "left_anti")), "roots")
