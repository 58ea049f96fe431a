import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from listingspark.llm import periodic_runs as P, queries
from listingspark.llm.texts import plain_words


def by_hand(words, least=6, times=4):
    """All runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def kept(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def loops(rng, kinds, size):
    words = [rng.randint(1, kinds) for _ in range(size)]
    if size and rng.random() < 0.7:
        a, p = rng.randrange(size), rng.randint(1, max(1, size // 5))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
    return words


@pytest.mark.parametrize("shape", [P.Shape(), P.Shape(least=2, times=2), P.Shape(least=9, times=3)])
def test_equals_by_hand(shape):
    rng = random.Random(shape.least)
    for _ in range(120):
        texts = [loops(rng, rng.choice([1, 2, 3, 9]), rng.choice([0, 1, 2, 5, 6, 7, 24, 90, 200])) for _ in range(rng.randint(1, 10))]
        begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = [[] for _ in texts]
        for text, *run in zip(*P.runs_of(np.array([x for t in texts for x in t], dtype=np.int64), begins, shape)):
            got[text].append(tuple(map(int, run)))
        assert got == [by_hand(t, shape.least, shape.times) for t in texts]


def test_agreement_of_any_two_places():
    rng = random.Random(3)
    words = [0, *loops(rng, 2, 60), 0]
    grammar = P.Grammar(np.array(words))
    pairs = [(x, y) for x in range(1, 61) for y in range(x + 1, 61)]
    x, y = np.array(pairs).T
    ahead, back = grammar.agree(x, y)[0] - x, x - grammar.agree(x, y, back=True)[0]
    for (a, b), n, m in zip(pairs, ahead, back):
        assert n == next(k for k in range(99) if words[a + k] != words[b + k])
        assert m == next(k for k in range(99) if words[a - k] != words[b - k])


def test_grammar_shrinks_fast():
    words = np.random.default_rng(0).integers(1, 50, 100_000)
    grammar = P.Grammar(np.concatenate([[0], words, [0]]))
    assert sum(map(len, grammar.symbols)) < 12 * len(words) and len(P.Grammar(np.concatenate([[0], np.ones(10**6, int), [0]])).symbols) == 2


def test_rows(spark, documents, odd, prose):
    one = "a b c " * 5 + "end"
    rows = [*enumerate(odd), (50, one), (50, one), (None, one), (51, "A a " * 9), (52, prose(1, 40) + " x" * 7), (53, "x y " * 8), (54, "no no no no no")]
    got = P.periodic_runs(documents(rows).repartition(3)).collect()
    want = Counter()
    for key, text in rows:
        words = plain_words(text)
        runs = by_hand(words)
        want[key, len(words), tuple(runs), kept(words, runs)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got) == want
    assert P.periodic_runs(documents([])).collect() == []


def test_very_long_texts(spark):
    texts = [(1, "a " * 300_000), (2, " ".join(str(i * i % 997) for i in range(200_000))), (3, "b" * 6_000_000)]
    got = {r.doc_id: r for r in P.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 1)] and got[1].collapsed == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, 200_000, 997)] and len(got[2].collapsed.split()) == 997
    assert got[3].runs == [] and got[3].n_words == 1


def test_query(spark, documents, prose, tmp_path):
    rows = [(i, prose(i, i % 160) or None) for i in range(400)] + [(None, "z " * 9)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for key, text in rows:
        words = plain_words(text)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = by_hand(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.add((key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(kept(words, runs))))
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want and any(r.n_runs for r in got)


def test_looped_leaves_other_rows(spark):
    df = spark.createDataFrame([(1, "a  b"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in P.looped(df, F.lit(7).cast("bigint")).collect()] == ["a  b", None, ""]
    assert [r.text for r in P.looped(df, F.lit(10).cast("bigint")).collect()] == ["a b", None, ""]
