"""Company lists pasted or uploaded as text: lines become domains, the first of each wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.rows import with_once
from ..functions.text import let, trim_all
from ..functions.urls import registrable_domain, url_admitted, url_struct, url_text
from ..operators.joins import spread_join
from ..session import cut_lineage

FIELD_LIMIT = 200
_HEADER = r"(?i)^(company|name|website|domain|url)$"


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of landed text files with their number: ``list_id, line, text``."""
    whole = spark.read.option("wholetext", "true").text(path)
    return whole.select(
        F.col("_metadata.file_name").alias("list_id"), F.posexplode(F.split("value", r"\r?\n", -1)).alias("line", "text")
    ).withColumn("line", F.col("line") + 1)


def split_fields(line: Column) -> Column:
    """Fields of one comma-separated line; quoted fields may hold commas, a doubled quote is a quote, an open one ends with the line.

    Fields are matched as tokens, so the work is one pass over the line.
    """
    written = F.regexp_replace(F.regexp_replace(line, "^\ufeff", ""), "\t", ",")
    quotes = F.length(written) - F.length(F.replace(written, F.lit('"'), F.lit("")))
    text = F.when(quotes % 2 == 1, F.concat(written, F.lit('"'))).otherwise(written)
    tokens = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(r'((?:[^",]|"(?:[^"]|"")*(?:"|$))*),'), F.lit(1))
    unquoted = F.transform(
        tokens, lambda t: F.when(
            t.contains('"'), F.replace(F.regexp_replace(t, r'"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"'))
        ).otherwise(t),
    )
    return F.transform(unquoted, trim_all)


def website_of(token: Column) -> Column:
    """The HTTPS home of a URL or bare domain; null when it is not a public name."""

    def read(value: Column) -> Column:
        full = F.when(value.rlike(r"(?i)^[a-z]+://"), F.regexp_replace(value, r"^(?i:http)://", "https://")).otherwise(
            F.concat(F.lit("https://"), value)
        )
        return let(
            url_struct(full),
            lambda p: F.when((value != "") & url_admitted(full) & registrable_domain(p["host"]).isNotNull(), url_text(p)),
        )

    return let(F.regexp_replace(trim_all(token), r"^[\"']|[\"']$", ""), read)


def parse_seeds(lines: DataFrame) -> DataFrame:
    """One row per non-blank line of each list: what it names, before any rule across lines.

    A first line made only of column names is a header and says which fields to read.
    """
    written = lines.filter(trim_all(F.col("text")) != "")
    filled = with_once(written, fields=split_fields(F.col("text")))
    heads = written.groupBy("list_id").agg(F.min_by(F.struct("line", "text"), "line").alias("head"))
    first = with_once(heads, first=F.struct(F.col("head.line").alias("line"), split_fields(F.col("head.text")).alias("fields")))
    headed = first.select(
        "list_id", F.col("first.line").alias("first_line"),
        F.when(F.forall("first.fields", lambda f: f.rlike(_HEADER)), F.col("first.fields")).alias("header"),
    )
    rows = spread_join(filled, headed, "list_id", "line", counted=written).filter(F.col("header").isNull() | (F.col("line") > F.col("first_line")))

    def position(pattern: str) -> Column:
        return F.array_position(F.transform("header", lambda h: h.rlike(pattern)), True)

    name_at, domain_at = position("(?i)^(company|name)$"), position("(?i)^(website|domain|url)$")
    sites = F.transform("fields", lambda f: F.struct(f.alias("field"), website_of(f).alias("site")))
    named = with_once(rows, sites=sites, name_at=name_at, domain_at=domain_at)
    by_header = F.coalesce(F.col("domain_at"), F.lit(0)) > 0
    free_site = F.get(F.filter("sites", lambda s: s["site"].isNotNull()), 0)["site"]
    free_name = F.get(F.filter("sites", lambda s: s["site"].isNull() & (s["field"] != "")), 0)["field"]
    site = F.when(by_header, F.get("sites", F.col("domain_at").cast("int") - 1)["site"]).otherwise(free_site)
    name = F.when(
        by_header, F.when(F.col("name_at") > 0, F.get("fields", F.col("name_at").cast("int") - 1))
    ).otherwise(free_name)
    domain = F.regexp_replace(url_struct(F.col("site"))["host"], r"^www\.", "")
    picked = with_once(named, site=site, name=F.coalesce(name, F.lit(""))).select("list_id", "line", "site", "name")
    return with_once(picked, domain=domain)


def _with_taken(marked: DataFrame, accepted: DataFrame) -> DataFrame:
    """The lines with the line that has their domain. Those without one have nothing to look up, and a domain that very many lines repeat is spread out."""
    named = marked.filter(F.col("domain").isNotNull()).withColumn("key", F.xxhash64("list_id", "domain"))
    held = accepted.select("list_id", "domain", "taken_at").withColumn("key", F.xxhash64("list_id", "domain")).select("key", "taken_at", F.col("domain").alias("held"), F.col("list_id").alias("of"))
    found = spread_join(named, held.groupBy("key").agg(F.collect_list(F.struct("of", "held", "taken_at")).alias("held")), "key", "line", "left", shuffled=True)
    mine = F.filter("held", lambda h: (h["of"] == F.col("list_id")) & (h["held"] == F.col("domain")))
    taken = found.withColumn("taken_at", F.get(mine, 0)["taken_at"]).drop("key", "held")
    return taken.unionByName(marked.filter(F.col("domain").isNull()).withColumn("taken_at", F.lit(None).cast("int")))


def import_seeds(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Every line with its outcome: ``imported`` or the reason it was rejected.

    In line order a line without domain, a repeated domain, a line past ``limit`` accepted ones (if given) and an
    over-long name are rejected, in that order of reasons. Without a limit no list is ranked as a whole. An over-long line uses up neither its domain nor a place.
    """
    # lists are small files but dear to parse, so their lines are dealt to all cores; parsed, they are read for the domains, for repeats and for every line
    dealt = lines.repartition(4 * lines.sparkSession.sparkContext.defaultParallelism)
    rows = cut_lineage(parse_seeds(dealt), "seed-lines")
    usable = F.col("domain").isNotNull() & (F.length("name") <= FIELD_LIMIT) & (F.length("domain") <= FIELD_LIMIT)
    marked = rows.withColumn("usable", usable)
    # the first usable line of each domain takes the place; a domain column of null never does
    takes = marked.filter("usable").groupBy("list_id", "domain").agg(F.min("line").alias("line"))
    if limit is None:
        accepted = takes.withColumnRenamed("line", "taken_at")
        judged = _with_taken(marked, accepted).withColumn("full_at", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("list_id").orderBy("line", "domain")
        placed = takes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
        accepted = placed.select("list_id", "domain", F.col("line").alias("taken_at"))
        last = placed.groupBy("list_id").agg(F.max(F.when(F.col("place") == limit, F.col("line"))).alias("full_at"))
        judged = spread_join(_with_taken(marked, accepted), last, "list_id", "line", "left", counted=marked)
    outcome = (
        F.when(F.col("domain").isNull(), "No domain found")
        .when(F.col("line") == F.col("taken_at"), "imported")
        .when(F.col("line") > F.col("taken_at"), "Duplicate domain")
        .when(F.col("line") > F.col("full_at"), f"Import limit is {limit} rows")
        .otherwise("Company name or domain is too long")
    )
    home = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    return judged.select(
        "list_id", "line",
        F.when(F.col("name") != "", F.col("name")).otherwise(F.col("domain")).alias("name"), "domain",
        F.when(F.col("site") != home, F.col("site")).alias("website_url"), outcome.alias("outcome"),
    )
