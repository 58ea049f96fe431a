"""Sharding by rendezvous hashing of record keys over weighted shards.

Each shard draws a value in (0, 1) for a key, ``-ln(u) / weight`` decides, the smallest wins. A shard that is added
only takes the keys for which its own draw wins, so all others stay; one that is removed hands out its keys alone.
Places within a shard come from two passes: counts per shard and bucket give each bucket its first place, and only
rows of one bucket, a bounded share of the shard, are ranked against each other.

Defined cases: a null key is a key of its own kind and hashes as ``null``; a null text counts as empty; equal rows get
different places; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .texts import own_columns, written

#: Rows of a shard that one ranking should hold on average.
BUCKET_ROWS = 20_000
_DRAW_DIGITS = 13  # hex digits of a draw: 52 bits, exact in a double


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard, numbered from 0, that wins the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    name = F.coalesce(key.cast("string"), F.lit("null"))

    def cost(shard: int) -> Column:
        digits = F.substring(F.md5(F.concat(name, F.lit(f":{shard}")).cast("binary")), 1, _DRAW_DIGITS)
        draw = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DRAW_DIGITS)
        return -F.log(draw) / float(weights[shard])

    return F.array_min(F.array(*[F.struct(cost(i).alias("cost"), F.lit(i).alias("shard")) for i in range(len(weights))]))["shard"]


def sharded(docs: DataFrame, shards: int = 16, weights: Sequence[float] | None = None, grown_weight: float = 1.0) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of every row."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce("text", F.lit(""))
    rows = own_columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"),
    )
    rows = written(rows, "shards")
    buckets = max(4, rows.count() // (BUCKET_ROWS * len(weights)) + 1)
    spread = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(buckets)) + F.col("text_crc32")
    rows = rows.withColumn("_bucket", F.pmod(spread, F.lit(buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("_rank", rank).join(first, ["shard", "_bucket"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
