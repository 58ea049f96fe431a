"""Landed feed documents: reading, corrupt documents, unchanged documents, and the pages of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F



def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file: ``path`` and its whole text."""
    return spark.read.option("wholetext", "true").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )


def read_json_items(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited items; a line that is not JSON is kept in ``_corrupt_record``."""
    return (
        spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )


def read_xml_items(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """The repeated elements of landed XML feeds."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "PERMISSIVE").schema(schema).load(path)


def document_status(payloads: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Classify landed documents: ``invalid``, ``unchanged`` since the last landing, or ``ok``.

    ``payloads`` has ``source_id, page_no, format`` (json or xml) and ``payload``; ``previous`` has
    the hash each page had before.
    """
    valid = F.when(F.col("format") == "xml", _xml_ok()).otherwise(F.try_parse_json("payload").isNotNull())
    rows = payloads.select(
        "source_id", "page_no", "format", F.sha2("payload", 256).alias("payload_hash"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )
    if previous is None:
        known = rows.withColumn("before", F.lit(None).cast("string"))
    else:
        known = rows.join(
            previous.select("source_id", "page_no", F.col("payload_hash").alias("before")), ["source_id", "page_no"], "left"
        )
    status = F.when(~F.col("valid"), "invalid").when(F.col("before") == F.col("payload_hash"), "unchanged").otherwise("ok")
    return known.select("source_id", "page_no", "format", "payload_hash", status.alias("status"))


def _xml_ok():
    parsed = F.from_xml(
        F.col("payload"), "_c string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_c"}
    )
    return parsed["_c"].isNull()


def scan_summary(pages: DataFrame, max_jobs: int | None = None) -> DataFrame:
    """Combine the pages of each scan the way it was read.

    ``pages`` has ``run_id, page_no, jobs, complete, has_next, can_mark_removals``. Reading stops at
    the first page that is complete, has no continuation, or brings the listings to ``max_jobs``
    (no bound by default); later pages do not count. Removals are allowed only if every page read allows them.
    """
    order = Window.partitionBy("run_id").orderBy("page_no")
    running = F.sum("jobs").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    stops = F.col("complete") | ~F.col("has_next")
    if max_jobs is not None:
        stops = stops | (F.col("seen") >= max_jobs)
    marked = pages.withColumn("seen", running).withColumn("stops", stops)
    first_stop = F.min(F.when(F.col("stops"), F.col("page_no"))).over(Window.partitionBy("run_id"))
    read = marked.withColumn("stop", first_stop).filter(F.col("stop").isNull() | (F.col("page_no") <= F.col("stop")))
    last = F.max_by(F.struct("complete", "has_next", "seen"), "page_no")
    runs = read.groupBy("run_id").agg(
        F.count("*").alias("pages"), F.sum("jobs").alias("discovered"), F.bool_and("can_mark_removals").alias("all_allow"),
        last.alias("last"),
    )
    done = F.col("last.complete")
    # The notes a scan ends with
    unfinished = "Scan ended before its last page; no removals were marked."
    if max_jobs is not None:
        unfinished = f"Scan stopped at the {max_jobs}-job safety cap; no removals were marked."
    return runs.select(
        "run_id", "pages", "discovered",
        F.when(done, "Succeeded").otherwise("Partial").alias("status"),
        (done & F.col("all_allow")).alias("may_retire"),
        F.when(done & F.col("all_allow"), "").when(
            done, "This scan cannot prove the complete job inventory. Missing listings are not marked removed."
        ).when(
            F.col("last.has_next"), unfinished
        ).otherwise("Source returned an incomplete page without a continuation cursor; no removals were marked.").alias("note"),
    )
