import random

from pyspark.sql import functions as F

from listingspark.operators import reports
from listingspark.operators.joins import SALTS, hot_keys, spread_join, with_hot_repeated


def tables(spark):
    rng = random.Random(3)
    big = [(i, None if i % 50 == 0 else "hot" if i % 3 else f"k{rng.randrange(900)}") for i in range(6000)]
    small = [(f"k{i}", i) for i in range(800)] + [("hot", -1), ("hot", -2), (None, -3)]
    return spark.createDataFrame(big, "id long, k string"), spark.createDataFrame(small, "k string, v long")


def rows(df):
    return sorted(map(tuple, df.select("id", "k", "v").collect()), key=str)


def test_spread_join_gives_the_rows_of_a_plain_join(spark):
    big, small = tables(spark)
    for how in ("inner", "left"):
        plain = rows(big.join(small, "k", how))
        assert rows(spread_join(big, small, "k", "id", how)) == plain
        assert rows(spread_join(big, small, "k", "id", how, shuffled=True)) == plain
        # whatever keys are counted, the rows are the same
        assert rows(spread_join(big, small, "k", "id", how, counted=big.limit(0))) == plain
        assert rows(spread_join(big, small, "k", "id", how, counted=small)) == plain


def test_frequent_keys_are_those_with_most_rows(spark):
    big, _ = tables(spark)
    assert [r.k for r in hot_keys(big, "k", most=1).collect()] == ["hot"]
    assert hot_keys(big, "k").count() == 256


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_people_are_not_sent_to_every_task(spark):
    """Their side was repeated sixteen times and broadcast, as its file size told too little."""
    big, small = tables(spark)
    plan = executed(spread_join(big, small, "k", "id", shuffled=True))
    assert "SortMergeJoin [k" in plan


def test_only_frequent_keys_are_repeated(spark):
    """Of a small side with many keys the rows of 256 are repeated, not all 5 000 sixteen times."""
    big, small = spark.range(20000).selectExpr("id", "id % 5000 AS k"), spark.range(5000).selectExpr("id AS k", "id AS v")
    assert with_hot_repeated(small, hot_keys(big, "k"), "k").count() == 5000 + 256 * (SALTS - 1)


def test_a_hot_key_is_shared_out(spark):
    """Its rows meet in more than one partition, those of each other key in one."""
    big = spark.range(8000).selectExpr("id", "CASE WHEN id % 4 < 3 THEN -1 ELSE id % 700 END AS k")
    small = spark.range(-1, 700).selectExpr("id AS k")
    met = spread_join(big, small, "k", "id", counted=big.filter("k = -1"), shuffled=True)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        places = {(r.k, r.at) for r in met.select("k", F.spark_partition_id().alias("at")).distinct().collect()}
    finally:
        spark.conf.set(coalesce, before)
    keys = [k for k, _ in places]
    assert keys.count(-1) == 4 and all(keys.count(k) == 1 for k in set(keys) - {-1})


def test_batch_sizes_are_joined_by_shuffle(spark):
    candidates = spark.createDataFrame([(1, 10, 5), (1, 11, 6), (2, 12, 1)], "user_id long, job_id long, discovered_at long")
    sizes = spark.createDataFrame([(1, 1), (2, 3)], "user_id long, batch_size int")
    batch = reports.eval_batch(candidates, sizes)
    assert sorted((r.user_id, r.job_id) for r in batch.collect()) == [(1, 11), (2, 12)]
    assert "BroadcastHashJoin" not in batch._jdf.queryExecution().executedPlan().toString()


def test_lines_are_parsed_before_the_rules_across_lines(spark):
    """Parsed lines are written once; the plan that judges them holds no parsing, which ran for each of its branches."""
    from listingspark.sources import seeds

    lines = spark.createDataFrame([("a", 1, "Acme, acme.com"), ("a", 2, "acme.com"), ("a", 3, "Only Name")], "list_id string, line int, text string")
    judged = seeds.import_seeds(lines)
    assert [(r.line, r.outcome) for r in judged.orderBy("line").collect()] == [(1, "imported"), (2, "Duplicate domain"), (3, "No domain found")]
    assert "regexp_extract_all" not in judged._jdf.queryExecution().optimizedPlan().toString()


def test_an_evaluation_is_planned_once(spark, tmp_path):
    """Batch, matches and alerts are read from what was evaluated, so none of them holds the plan that looks up vectors."""
    from suite import planned

    n = spark.range(1, 61)
    tables = {
        "customer": n.selectExpr("id AS c_custkey"),
        "supplier": n.selectExpr("id AS s_suppkey", "concat('S', id) AS s_name"),
        "orders": n.selectExpr("id AS o_orderkey", "id AS o_custkey", "CAST(id * 7.5 AS DOUBLE) AS o_totalprice", "TIMESTAMP'2023-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority"),
        "documents": n.selectExpr("id AS doc_id", "concat('A text of some length, number ', id) AS text", "'en' AS lang", "'Acme' AS source"),
        "embeddings": n.selectExpr("id AS vec_id", "array(CAST(1 AS FLOAT), CAST(id AS FLOAT)) AS embedding", "CAST(id % 20 AS INT) AS label"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    done = planned.evaluate_job(spark, str(tmp_path))
    assert not [f for f in done.inputFiles() if "embeddings.parquet" in f]
    assert done.count() == done.select("user_id", "job_id").distinct().count() > 0
