import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listingspark.llm import packing, toxicity
from listingspark.llm.grams import code_points  # noqa: F401  the module must import on its own
from tests.llm.test_decontaminate import by_hand as leaks
from tests.llm.test_jaccard_join import brute_force
from tests.llm.test_quality_rules import by_hand as quality

COMMON = " the and of to in is that for it"


@pytest.fixture
def tables(tmp_path, spark, prose, odd):
    """Small tables with junk, toxic texts, copies, near copies and benchmark passages."""
    bench = [(i, prose(900 + i, 30)) for i in range(4)]
    rows, labels = [], []
    for i in range(150):
        text = prose(i, 40 + i) + COMMON
        if i % 5 == 0:
            text = text.replace(" ", " grobnik ", 3)
        if i % 11 == 3:
            text += " " + bench[i % 4][1]
        rows.append((i, text))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200 + i, rows[i][1] + " more") for i in range(0, 40, 3)] + [(300 + i, "# " + rows[i][1].replace(" ", " # ")) for i in range(4)] + [(400 + i, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, labels, bench


def test_equals_brute_force(spark, tables):
    sf_dir, rows, labels, bench = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, stages = rows, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        if name == "quality":
            kept = [(i, t) for i, t in kept if quality(t)[-1]]
        elif name == "toxicity":
            model = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True)))
            kept = [(i, t) for i, t in kept if model.scores([t])[0] < toxicity.THRESHOLD]
        elif name == "near_duplicates":
            kept = [(i, t) for i, t in kept if any(x == i == c for x, _, c in stages["classes"])]
        else:
            hit = {i for i, _ in leaks(kept, bench)}
            kept = [(i, t) for i, t in kept if i not in hit]
        docs = corpus_pipeline.written(out, name)
        assert sorted(map(tuple, docs.select("doc_id", "text").collect())) == sorted(kept), name
        stages[name] = len(kept)
        stages["classes"] = brute_force(kept, 5, 80)
    assert len(rows) > stages["quality"] > stages["toxicity"] > stages["near_duplicates"] > stages["decontamination"] > 0

    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    total = 0
    for i, t in kept:
        ids = np.frombuffer(packing.token_bytes(t), dtype="<u2").tolist() + [1]
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) for p in own]
        assert sum(p.length for p in own) == len(ids)
        total += len(ids)
    places = sorted((p.sequence_id * 2048 + p.offset, p.length) for p in pieces)
    assert [a for a, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist() and sum(n for _, n in places) == total


def test_empty_documents(spark, tables, tmp_path):
    sf_dir = tables[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []
