"""The corpus operators over the given tables, with production parameters, and the SQL that some are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, html_extract, jaccard_join, language_id, license_scan, packing, periodic_runs, quality_rules, secret_scan, sharding, toxicity, url_filter, whitening
from .texts import read

URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def fold(parts: int, held: int) -> Column:
    """Whether a row's ``doc_id`` is in the fold that must not be learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clustered(read(spark, sf_dir, "documents"), jaccard_join.Likeness(size=4, percent=85))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(3, 1))
    return rows.select("doc_id", fold(3, 1).alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licensed(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(read(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_id.language(read(spark, sf_dir, "documents"), fold(4, 2))
    return rows.select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.sharded(read(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "matches", "length", "doc_start", "item_start", "item_words", "telling")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.kind != "guess")
    kinds = F.transform("spans", lambda s: s.kind)
    many = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return rows.select("doc_id", *many, F.sha2(secret_scan.spelled(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic_runs.periodic_runs(periodic_runs.looped(docs, F.crc32(F.col("doc_id").cast("string").cast("binary"))), periodic_runs.Shape(least=6, times=4))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return rows.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * -F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    q.__name__: q
    for q in (
        op1_ngram_jaccard_join, op2_toxicity, op3_quality_rules, op4_packing, op5_license_scan, op6_url_filter, op7_language_id, op8_html_extraction, op9_sharding,
        op10_decontamination, op11_embedding_whitening, op12_secret_scan, op13_periodic_runs,
    )
}
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP1 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a JOIN documents USING (doc_id)
WHERE documents.doc_id = r.a GROUP BY doc_id
"""

_OP3 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM t WHERE len(w) >= 8),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g),
c AS (SELECT doc_id, count(DISTINCT i + k) AS covered FROM h, range(8) AS r(k) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered, 0) AS n_repeat_words, len(lines) AS n_lines,
  len(list_filter(w, lambda x: list_contains({list(quality_rules.STOP_WORDS)!r}, x))) AS n_stop,
  length(regexp_replace(text, '[^{quality_rules.UNLISTED[1:]}', '', 'g')) AS n_unlisted,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter FROM t LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE n_symbols / n_words <= 0.15::DOUBLE
    AND (n_unlisted / word_chars > 0.5::DOUBLE OR word_chars / n_words BETWEEN 2::DOUBLE AND 14::DOUBLE AND n_stop / n_words >= 0.03::DOUBLE) AND n_dup_lines / n_lines <= 0.4::DOUBLE AND n_stutter / n_words <= 0.2::DOUBLE END AS kept
FROM b
"""

_OP9 = r"""
WITH RECURSIVE steps AS (SELECT i AS b, i AS c, 0 AS k FROM range(256) AS r(i)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
h AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
d AS (SELECT doc_id, list_transform(h, lambda v: ('0x' || v)::BIGINT) AS bytes FROM h),
x AS (SELECT doc_id, len(bytes) + 1 AS size,
  xor(list_reduce(bytes, lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
  list_transform(range(17), lambda s: -ln((('0x' || md5(doc_id || ':' || s)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496)) AS cost FROM d, crc),
y AS (SELECT *, list_position(cost[1:16], list_min(cost[1:16])) - 1 AS shard, list_position(cost, list_min(cost)) - 1 AS grown_shard,
  greatest(4, (SELECT count(*) FROM documents) // 320000 + 1) AS buckets FROM x)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY (doc_id % buckets + text_crc32) % buckets, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard
FROM y
"""

ORACLE: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op3_quality_rules": _OP3, "op9_sharding": _OP9}
