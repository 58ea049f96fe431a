import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from listingspark.llm import sharding as S


def winner(key, weights):
    cost = []
    for i, w in enumerate(weights):
        digits = hashlib.md5(f"{'null' if key is None else key}:{i}".encode()).hexdigest()[:13]
        cost.append((-math.log((int(digits, 16) + 0.5) / 16**13) / w, i))
    return min(cost)[1]


def test_equals_by_hand(spark, documents, odd, prose):
    rows = [*enumerate(odd), *((100 + i, prose(i, 5)) for i in range(300)), (None, None), (None, "x"), (5, odd[5]), (5, odd[5])]
    got = S.sharded(documents(rows).repartition(3), 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), winner(i, [1] * 16), winner(i, [1] * 17)) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 3)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    rows = S.sharded(docs, 4).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("d")).collect()
    assert all((r.a, r.b + 1, r.d) == (0, r.n, r.n) for r in rows) and sum(r.n for r in rows) == 2000


def test_weights_and_growth(spark):
    keys = spark.range(20_000)
    weights = [1.0, 2.0, 3.0, 4.0]
    shares = {r.s: r["count"] / 20_000 for r in keys.groupBy(S.shard_of(F.col("id"), weights).alias("s")).count().collect()}
    assert shares == pytest.approx({0: 0.1, 1: 0.2, 2: 0.3, 3: 0.4}, abs=0.015)
    both = keys.select(S.shard_of(F.col("id"), [1.0] * 10).alias("a"), S.shard_of(F.col("id"), [1.0] * 11).alias("b"))
    moved = both.filter("a != b").collect()
    assert {r.b for r in moved} == {10} and len(moved) / 20_000 == pytest.approx(1 / 11, abs=0.01)


def test_bad_and_empty(spark, documents):
    assert S.sharded(documents([])).collect() == []
    with pytest.raises(ValueError):
        S.shard_of(F.col("x"), [1.0, 0.0])
