"""A corpus pipeline: quality rules, toxicity, one text of each near-duplicate group, decontamination, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before kept; its result is written as
Parquet and read again as the next one's ``docs``. All stages but the last return the columns of ``documents`` as they
came. Rows without an id keep their text's verdict in the first two stages, are never dropped as copies, and are told
apart by their text in decontamination. Near copies of one id, equal rows too, are one document to
the join: one row stays; different texts of one id all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingspark.llm import decontaminate, jaccard_join, packing, quality_rules, toxicity
from listingspark.llm.texts import read, written

#: Near duplicates: runs of five words, 80 % of the union shared.
NEAR = jaccard_join.Likeness(size=5, percent=80)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    return quality_rules.kept_rows(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic; learns from all labels of the documents that are left."""
    return toxicity.clean_rows(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, one of its smallest id."""
    return jaccard_join.one_of_each(docs, NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark passage."""
    return decontaminate.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces that fill the training sequences."""
    pieces = packing.packed(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learnt models, hashes and tokenizers are beyond SQL; ``tests/llm/test_pipeline.py`` has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
