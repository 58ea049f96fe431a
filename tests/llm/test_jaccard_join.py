import random
import re

import numpy as np
import pyarrow as pa
import pytest

from listingspark.llm import jaccard_join as J
from listingspark.llm.components import components, merged


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_force(rows, size, percent):
    """``doc_id, n, component`` by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted(((i, len(s), None if i is None else least[find(a)]) for a, (i, s) in enumerate(sets)), key=repr)


def edited(text, rng, share):
    w = text.split(" ")
    for _ in range(rng.randint(0, max(1, int(len(w) * share)))):
        k = rng.randrange(len(w))
        kind = rng.random()
        if kind < 0.4:
            w[k] = "changed" + str(rng.randrange(50))
        elif kind < 0.7 and len(w) > 1:
            del w[k]
        else:
            w.insert(k, "added")
    return " ".join(w)


@pytest.fixture
def rows(prose, odd):
    rng = random.Random(3)
    made = []
    for group in range(14):
        base = prose(group, rng.choice([3, 4, 6, 9, 14, 30, 80, 200]))
        made += [edited(base, rng, 0.05) for _ in range(rng.choice([1, 2, 3, 8]))] + [base] * rng.choice([0, 1, 3])
    shared = prose(99, 40)  # a passage that many texts hold
    made += [prose(200 + i, 12) + " " + shared for i in range(6)]
    return [(i * 3 % 101 + 1000 * (i % 2), t) for i, t in enumerate([*made, *odd, *odd[4:7]])] + [(None, made[0]), (None, None)]


@pytest.mark.parametrize("loose", [None, 0, 1])
def test_equals_brute_force(spark, documents, rows, loose):
    like = J.Likeness(4, 85)
    plans = None
    if loose is not None:  # without and with one-deletion segments, whatever they cost
        plans = {}
        for band in range(16):
            need = like.allowance((2 << band) - 1, band) + 1
            plans[band] = J.Layout(need - 2 * (need // 2 * loose) + 1, need // 2 * loose)
    got = J.clustered(documents(rows).repartition(4), like, plans)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows, 4, 85)


def test_a_chain_of_near_copies_is_one_component(spark, documents, prose):
    """Neighbours link, ends do not, and every text shares index entries with many others."""
    rng = random.Random(5)
    text, rows = prose(1, 120), []
    for i in range(60):
        rows.append((i, text))
        text = edited(text, rng, 0.02)
    got = J.clustered(documents(rows).repartition(3), J.Likeness(4, 85), star_rounds=1)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows, 4, 85)


def test_empty_table(spark, documents):
    assert J.clustered(documents([])).collect() == []
    assert J.clustered(documents([(1, None), (2, "")])).orderBy("doc_id").collect() == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_keeps_whole_rows(spark, documents, prose):
    docs = documents([(5, prose(1, 50)), (3, prose(1, 50)), (3, prose(1, 50)), (None, prose(1, 50)), (9, prose(2, 50)), (8, None)])
    kept = J.one_of_each(docs, J.Likeness(5, 80))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 8, 9, None], key=repr)


def test_every_linked_pair_shares_an_entry():
    rng, like = random.Random(1), J.Likeness(4, 85)
    for spare in (0, 2, 7):
        for part in (0, 4, 2):
            plans = {}
            for band in range(12):
                need = like.allowance((2 << band) - 1, band) + 1
                loose = need // part if part else 0
                plans[band] = J.Layout(need - 2 * loose + spare, loose)
            for _ in range(150):
                a = {rng.getrandbits(64) for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 15, 16, 31, 40, 64, 130, 300]))}
                b = set(a)
                for _ in range(rng.randint(0, len(a) // 5)):
                    b.discard(min(b)) if rng.random() < 0.5 and b else b.add(rng.getrandbits(64))
                x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
                if like.linked(x, y):
                    assert set(J.entries(x, like, plans)) & set(J.entries(y, like, plans))


def test_hashes_tell_words_apart(odd):
    seen = {}
    for text, found in zip(odd, J.sets_of(pa.array(odd), 1), strict=True):
        assert len(found) == len(set(words(text)))
        for w in set(words(text)):
            (h,) = next(J.sets_of(pa.array([w]), 1))
            assert h in found and seen.setdefault(int(h), w) == w


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(-50, 250), rng.randrange(-50, 250)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert dict(map(tuple, got.collect())) == {x: find(x) for x in linked}


def test_different_texts_of_one_id_stay(spark, documents, prose):
    near = prose(1, 50) + " more"
    docs = documents([(3, prose(1, 50)), (5, near), (5, prose(2, 50)), (6, prose(3, 50)), (6, prose(4, 50)), (7, prose(5, 50)), (7, prose(5, 50) + " more"), (8, ""), (8, prose(6, 50)), (8, prose(6, 50))])
    kept = [(r.doc_id, r.text) for r in J.one_of_each(docs, J.Likeness(5, 80)).collect()]
    assert sorted(x for x in kept if x[0] != 7) == sorted([(3, prose(1, 50)), (5, prose(2, 50)), (6, prose(3, 50)), (6, prose(4, 50)), (8, ""), (8, prose(6, 50))])
    assert len([x for x in kept if x[0] == 7]) == 1


def test_two_full_blocks_leave_in_small_batches():
    import tracemalloc

    from listingspark.llm import jaccard_join as J

    tokens = [np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 100 + i], dtype=np.uint64) for i in range(2 * 1024)]
    group = [[i, i, i % 2, 10, J.parity(t)] for i, t in enumerate(tokens)]
    tracemalloc.start()
    total = largest = 0
    for batch in J._allowed(group, (1, 0, 1), J.Likeness(size=4, percent=80), best=False):
        total, largest = total + batch.num_rows, max(largest, batch.num_rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 1024 * 1024 and largest < J.PAIRS + len(group) and peak < 60_000_000


def test_a_comparison_gives_fewer_pairs_than_rows():
    """All of 300 sets link with each other; two blocks and one block of them leave as a forest that joins them all."""
    like = J.Likeness(size=4, percent=80)
    tokens = [np.array([*range(1, 40), 100 + i], dtype=np.uint64) << np.uint64(20) for i in range(300)]
    for key, own in (((1, 0, 0), lambda i: 0), ((1, 0, 1), lambda i: i % 2)):
        group = [[i, i, own(i), 40, J.parity(t)] for i, t in enumerate(tokens)]
        pairs = [p for batch in J._allowed(group, key, like, best=True) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        assert len(pairs) == 299 and all(own(a) != own(b) or key[1] == key[2] for a, b in pairs)
        above = list(range(300))

        def find(x):
            while above[x] != x:
                x = above[x]
            return x

        for a, b in pairs:
            above[find(a)] = find(b)
        assert len({find(x) for x in range(300)}) == 1
        exact = [[*row, t.tobytes()] for row, t in zip(group, tokens, strict=True)]
        assert sum(batch.num_rows for batch in J._linked(exact, key, like)) == 299


def test_links_at_the_edge_are_found_where_a_forest_fails(spark, documents, prose):
    """Texts of one group that differ by about as much as links allow: many allowed pairs fail, and the rest still links."""
    rng, rows = random.Random(7), []
    for group in range(6):
        base = prose(300 + group, 160).split(" ")
        for i in range(25):
            w = list(base)
            for k in rng.sample(range(160), rng.choice([2, 3, 3])):
                w[k] = f"own{i}x{k}"
            rows.append((len(rows), " ".join(w)))
    like = J.Likeness(4, 85)
    sets = [next(J.sets_of(pa.array([t]), 4)) for _, t in rows]
    marks = [[i, i, 0, len(t), J.parity(t)] for i, t in enumerate(sets)]
    forest = [p for batch in J._allowed(marks, (1, 0, 0), like, best=True) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert not all(like.linked(sets[a], sets[b]) for a, b in forest)  # the case is met
    for rounds in (0, 1):
        got = J.clustered(documents(rows).repartition(3), like, star_rounds=rounds)
        assert sorted(map(tuple, got.collect()), key=repr) == brute_force(rows, 4, 85)


def test_exact_links_join_all_across_blocks(spark, prose, monkeypatch):
    monkeypatch.setattr(J, "TOKENS", 500)  # many blocks
    rng, like = random.Random(9), J.Likeness(4, 85)
    texts = [edited(prose(400 + i % 3, 120), rng, 0.03) for i in range(45)]
    sets = [next(J.sets_of(pa.array([t]), 4)) for t in texts]
    table = spark.createDataFrame([(J.node_of(s), len(s), t, J.parity(s)) for s, t in zip(sets, texts, strict=True)], "node bigint, n bigint, text string, bits binary").select("node", "n", "text", "bits").dropDuplicates(["node"])
    unsettled = table.selectExpr("7L AS key", "node")
    links = J._exact_links(unsettled, spark.createDataFrame([], "node bigint, root bigint"), table, like)
    got = components(links.select("a", "b"))
    want = brute_force(list(enumerate(texts)), 4, 85)
    of = {r.node: r.root for r in got.collect()}
    name = [of.get(J.node_of(s), J.node_of(s)) for s in sets]
    assert {(name[i], name[c]) for i, _, c in want} == {(name[i], name[i]) for i, _, _ in want}
    assert len(set(name)) == len({c for _, _, c in want})


def test_further_links_merge_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(170)]
    table = lambda x: spark.createDataFrame(x, "a bigint, b bigint")
    got = components(table(pairs[:60]))
    for first in (60, 110):
        got = merged(got, table(pairs[first : first + 60]))
    inside = lambda x: {tuple(r) for r in x.collect() if r.node != r.root}
    assert inside(got) == inside(components(table(pairs)))
    assert got.count() == got.select("node").distinct().count()
