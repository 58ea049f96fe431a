"""Crawl permissions: rule tables from robots texts, verdicts for links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rows import with_once
from ..functions.text import let, trim_all
from .joins import spread_join


#: A group among lines that begin with U (agent), A or D (rule): agents in a row, and the rules below them.
_GROUP = r"(?:U[^\n]*+\n)++(?:[AD][^\n]*+\n)*+"


def robots_rules(files: DataFrame) -> DataFrame:
    """Rules per host and agent from robots texts (``host, text``), one text a host. No row leaves its text.

    Consecutive agent lines share the rules that follow; an agent line after a rule starts a new
    group. An agent that is named without rules still appears once, with a null ``path``, because
    its empty group replaces the wildcard group. A null text has no rules.
    """

    def marked(raw: Column, line: Column) -> Column:
        """Kind, line number and value of a line that counts, else null."""
        clean = trim_all(F.regexp_replace(raw, r"#.*$", ""))
        directive = F.lower(trim_all(F.substring_index(clean, ":", 1)))
        kind = F.when(directive == "user-agent", "U").when(directive == "allow", "A").when(directive == "disallow", "D")
        value = trim_all(F.substr(clean, F.instr(clean, ":") + 1))
        return F.when(F.instr(clean, ":") > 0, F.concat(kind, line.cast("string"), F.lit(" "), value, F.lit("\n")))

    lines = F.filter(F.transform(F.split("text", r"\r?\n", -1), marked), lambda e: e.isNotNull())
    rows = with_once(files.select("host", "text"), marks=F.array_join(lines, "")).drop("text")
    groups = rows.select("host", F.explode(F.regexp_extract_all("marks", F.lit(_GROUP), F.lit(0))).alias("group"))
    split = with_once(groups, marks=F.split(F.rtrim(F.col("group"), F.lit("\n")), "\n")).drop("group")
    value = lambda e: F.regexp_extract(e, r"(?s)^[UAD][0-9]+ (.*)$", 1)
    rule = lambda e: F.struct(F.regexp_extract(e, "^[AD]([0-9]+)", 1).cast("int").alias("line"), e.startswith("A").alias("allow"), value(e).alias("path"))
    binding = F.filter(F.transform(F.filter("marks", lambda e: ~e.startswith("U")), rule), lambda r: r["allow"] | (r["path"] != ""))
    agents = F.array_distinct(F.transform(F.filter("marks", lambda e: e.startswith("U")), lambda e: F.lower(value(e))))
    each = with_once(split, agents=agents, rules=binding).select("host", F.explode("agents").alias("agent"), "rules")
    return each.select("host", "agent", F.explode_outer("rules").alias("rule")).select(
        "host", "agent", F.col("rule.line").alias("line"), F.col("rule.allow").alias("allow"), F.col("rule.path").alias("path")
    )


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """One row per host with the rules that bind an agent: its own group, else the wildcard group."""
    wanted = rules.filter(F.col("agent").isin(agent.lower(), "*"))
    collected = wanted.groupBy("host", "agent").agg(
        F.collect_list(F.when(F.col("path").isNotNull(), F.struct("line", "allow", "path"))).alias("rules")
    )
    return collected.groupBy("host").agg(F.max_by("rules", (F.col("agent") != "*").cast("int")).alias("rules"))


def rule_matches(rule: Column, path: Column) -> Column:
    """Prefix match with ``*`` wildcards and a ``$`` end anchor.

    The literal parts are located from left to right, each search starting where the last one
    ended, so a rule full of wildcards costs one pass over the path.
    """
    anchored = rule.endswith("$")
    pattern = F.when(anchored, F.substr(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)

    def judge(parts: Column) -> Column:
        first, last = F.get(parts, 0), F.element_at(parts, -1)
        middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))

        def step(index: Column, part: Column) -> Column:
            found = F.position(part, path, index + 1)
            return F.when(index < 0, index).when(part == "", index).when(found == 0, -1).otherwise(found - 1 + F.length(part))

        index = F.aggregate(middle, F.length(first), step)
        tail = let(index, lambda at: (
            F.when(at < 0, False).when(last == "", True)
            .when(anchored, (F.length(path) - F.length(last) >= at) & path.endswith(last))
            .otherwise(F.position(last, path, at + 1) > 0)
        ))
        return F.when(~path.startswith(first), False).when(
            F.size(parts) == 1, F.when(anchored, path == first).otherwise(True)
        ).otherwise(tail)

    return let(F.split(pattern, r"\*", -1), judge)


def robots_verdict(links: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Whether an agent may fetch each link (``host, path``) and the rule that forbids it.

    The longest matching rule decides and an allowance wins a tie; without a rule it is allowed. A
    host has one row of rules, so links of a busy host are spread over tasks rather than multiplied.
    """
    bound = agent_rules(rules, agent)
    joined = spread_join(links, bound, "host", "path", "left")
    matching = F.filter(F.coalesce("rules", F.array().cast("array<struct<line:int,allow:boolean,path:string>>")),
                        lambda r: rule_matches(r["path"], F.col("path")))
    # longest first, then an allowance, then the rule that stands first
    best = F.array_max(F.transform(matching, lambda r: F.struct(
        F.length(r["path"]).alias("n"), r["allow"].alias("allow"), (-r["line"]).alias("order"), r["path"].alias("path")
    )))
    judged = with_once(joined, best=best)
    allowed = F.coalesce(F.col("best.allow"), F.lit(True))
    return judged.select(
        *links.columns, allowed.alias("allowed"), F.when(~allowed, F.concat(F.lit("Disallow: "), F.col("best.path"))).alias("matched_rule")
    )


def robots_refusal(content_type: Column) -> Column:
    """Why a response cannot be read as a robots text, else null. A missing type is a refusal."""
    declared = trim_all(F.coalesce(content_type, F.lit("")))
    return F.when(
        declared == "", "the response carried no Content-Type header, so it cannot be confirmed as a robots.txt"
    ).when(~declared.rlike(r"(?i)^text/plain\s*(;|$)"), F.concat(F.lit("unexpected content type "), declared))
