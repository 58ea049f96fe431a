"""URL filters: rules first, then a ratio of two character language models.

URLs that a rule decides are the examples: one smoothed variable-order Markov model is counted from the allowed ones
and one from the blocked ones, over all characters of the whole URL behind its scheme, query and fragment included. A character's
probability after the ``ORDER`` characters before it is blended with that after fewer characters, the more the rarer the longer
context is (Witten-Bell). The verdict of any other URL is the log-likelihood difference per character against a threshold calibrated
on the examples: where two normal curves with the examples' means and deviations err alike.

The models are tables of contexts and characters, as large as the examples make them. Every different run of ``ORDER + 1`` characters
of all URLs gets its weight from them, one join an order, from the longest run and its context to shorter ones; a URL's weights are
joined by run, with the runs that very many URLs have spread over tasks, and added up. No Python, and nothing but a few
sums reaches the driver.

Defined cases: null and URLs without ``://`` have an empty host and path; they are judged by all their characters, null as an empty text; a rule table
that leaves one model without examples makes every difference 0, which allows; equal rows get equal results; a very long URL is read whole; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from listingspark.functions.rows import with_once
from listingspark.functions.text import let
from listingspark.operators.joins import repeated_join

from .texts import own_columns, written

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Characters of context.
ORDER = 4
#: Places before the first and after the last character.
BEGIN, END = "\x02", "\x03"
#: One in so many: a character that no example has.
CHARACTERS = 65_536


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    rest = F.when(url.contains("://"), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; nulls without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(own + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _runs(url: Column, host: Column) -> Column:
    """All runs of ``ORDER + 1`` characters of the URL behind its scheme, the host in small letters; one for an empty text."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(text.contains("://"), F.concat(host, F.regexp_replace(text, r"(?s)^.*?://[^/?#]*", ""))).otherwise(text)
    characters = F.concat(F.array(*[F.lit(BEGIN)] * ORDER), F.regexp_extract_all(rest, F.lit("(?s)."), F.lit(0)), F.array(F.lit(END)))
    return let(characters, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - ORDER), lambda i: F.array_join(F.slice(c, i, ORDER + 1), "")))


_LABELS = ("allow", "block")


def run_weights(every: DataFrame, examples: DataFrame) -> DataFrame:
    """``run, weight`` of every run in ``every``: the log-likelihood difference of its last character. ``examples``: ``label, run``."""
    n = {label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).alias(f"n_{label}") for label in _LABELS}
    counts = written(examples.groupBy("label", "run").agg(F.count("*").alias("n")), "url-runs")
    rows = every.select("run", *[F.lit(1.0 / CHARACTERS).alias(f"p_{label}") for label in _LABELS])
    for length in range(ORDER + 1):  # characters of context
        tail = F.substr("run", F.lit(ORDER + 1 - length))
        seen = counts.withColumn("tail", tail).groupBy("tail").agg(*n.values())
        kinds = [F.count_if(F.col(f"n_{label}") > 0).alias(f"kinds_{label}") for label in _LABELS]
        context = seen.groupBy(F.substr("tail", F.lit(1), F.lit(length)).alias("context")).agg(*[F.sum(f"n_{label}").alias(f"all_{label}") for label in _LABELS], *kinds)
        rows = rows.withColumn("tail", tail).withColumn("context", F.substr(tail, F.lit(1), F.lit(length)))
        if length:
            rows = repeated_join(rows.join(seen, "tail", "left"), context, "context", "run", "left")
        else:  # one context, the empty one
            total = {name: context.select(name).scalar() for name in context.columns[1:]}
            rows = rows.join(seen, "tail", "left").withColumns({name: F.coalesce(v, F.lit(0)) for name, v in total.items()})
        blended = {
            f"p_{label}": F.when(F.coalesce(f"all_{label}", F.lit(0)) > 0, (F.coalesce(f"n_{label}", F.lit(0)) + F.col(f"kinds_{label}") * F.col(f"p_{label}")) / (F.col(f"all_{label}") + F.col(f"kinds_{label}")))
            .otherwise(F.col(f"p_{label}")) for label in _LABELS
        }
        rows = rows.select("run", *[p.alias(name) for name, p in blended.items()])
    return rows.select("run", (F.log("p_allow") - F.log("p_block")).alias("weight"))


def judged(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; score is the difference per character."""
    host, path = url_parts(F.col("url"))
    rows = with_once(own_columns(pages, "page_id", "url"), host=host, path=path)
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = written(with_once(rows, rule=name, label=says).withColumn("row", F.monotonically_increasing_id()), "url-rows")
    runs = rows.select("row", "label", F.explode(_runs(F.col("url"), F.col("host"))).alias("run"))
    weights = written(run_weights(runs.select("run").distinct(), runs.filter("label IS NOT NULL").select("label", "run")), "url-weights")
    mean = repeated_join(runs.select("row", "run"), weights, "run", "row").groupBy("row").agg(F.avg("weight").alias("score"))
    both = rows.agg(F.count_distinct("label").alias("n")).scalar() == 2
    scored = written(rows.join(mean, "row").withColumn("score", F.when(both, F.col("score")).otherwise(F.lit(0.0))).drop("row", "url"), "url-scores")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("label", F.when(F.col("score") >= threshold(scored).scalar(), "allow").otherwise("block")).alias("verdict"), "score")


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the difference at which allowed and blocked examples err alike; 0 where a class is missing."""
    of = lambda kind: F.when(F.col("label") == kind, F.col("score"))
    sums = scored.agg(F.avg(of("allow")).alias("ma"), F.avg(of("block")).alias("mb"), F.stddev_pop(of("allow")).alias("sa"), F.stddev_pop(of("block")).alias("sb"))
    spread = F.col("sa") + F.col("sb")
    cut = F.when(spread > 0, (F.col("ma") * F.col("sb") + F.col("mb") * F.col("sa")) / spread).otherwise((F.col("ma") + F.col("mb")) / 2)
    return sums.select(F.coalesce(cut, F.lit(0.0)).alias("cut"))
