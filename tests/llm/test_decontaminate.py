import random
import re

import pytest

from listingspark.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def by_hand(docs, items):
    """Best overlap of every text and item over all diagonals that share eight words of some mask."""
    masks = [sorted({a * x + b * y + c * z for x in (0, 1) for y in (0, 1) for z in (0, 1)}) for a, b, c in D.SHIFTS]
    out = {}
    for key, text in docs:
        w = words(text)
        for item, sample in items:
            v = words(sample)
            if len(v) < D.SHORTEST:
                continue
            for d in range(-len(v), len(w)):
                same = [0 <= i + d < len(w) and w[i + d] == v[i] for i in range(len(v))]
                if any(all(i + k < len(v) and same[i + k] for k in m) for m in masks for i in range(len(v))):
                    best = max((sum(1 if s else -D.MISMATCH for s in same[a:b]), sum(same[a:b])) for a in range(len(v)) for b in range(a + 1, len(v) + 1))
                    if best[1] >= min(D.MATCHES, -(-len(v) * 7 // 10)):
                        out[(key, item)] = max(out.get((key, item), 0), best[1])
    return out


@pytest.fixture
def items(prose):
    return [(i, prose(500 + i, n)) for i, n in enumerate([60, 40, 20, 15, 11])] + [(9, "Too short to be evidence"), (10, None), (11, "")]


def planted(items, prose):
    rng = random.Random(2)
    docs = []
    for k, (_, text) in enumerate(items[:5]):
        w = text.split(" ")
        docs.append(prose(k, 30) + " " + text.upper().replace(" ", ", ") + ". " + prose(k + 50, 30))
        for changes in (1, 2, 4):
            v = list(w)
            for at in rng.sample(range(len(v)), min(changes, len(v) // 6 + 1)):
                v[at] = "changed"
            docs.append(prose(k, 20) + " " + " ".join(v) + " " + prose(k + 70, 20))
        docs.append(prose(k, 20) + " " + " ".join(w[len(w) // 2 :]) + " " + prose(k + 90, 20))
        docs.append(prose(k + 300, 80) + " " + " ".join(w[:6]))
    return docs


def test_equals_by_hand(spark, documents, items, odd, prose):
    docs = list(enumerate([*planted(items, prose), *odd, prose(77, 400)]))
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS doc_id", "'x' AS seed", "'x' AS matches")
    got = {(r.doc_id, r.item_id): r.matches for r in D.overlaps(documents(docs).repartition(3), bench).collect()}
    want = by_hand(docs, items)
    assert set(got) == set(want) and len(want) >= 20
    assert all(abs(got[k] - want[k]) <= 2 for k in want)  # the same score may come with more or fewer equal words
    for k in range(5):  # verbatim and once changed
        assert (6 * k, k) in got and (k == 4 or (6 * k + 1, k) in got)


def test_items_of_eight_to_ten_words_follow_the_same_rule(spark, documents, prose):
    whole = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    items = [(n, " ".join(whole[:n])) for n in (8, 9, 10)]
    rng = random.Random(4)
    docs = [prose(1, 9) + " Alpha beta gamma delta epsilon; zeta eta theta iota kappa " + prose(3, 4), "alpha beta gamma delta x zeta eta theta iota kappa", "alpha beta x delta epsilon y eta theta", prose(2, 40)]
    for _ in range(60):
        docs.append(" ".join(w if rng.random() < 0.75 else "x" for w in whole) + " " + prose(rng.randrange(99), 3))
    docs = list(enumerate(docs))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.overlaps(documents(docs), bench).collect()}
    assert got == by_rule(docs, items) and {(0, 10), (1, 10), (1, 9), (2, 8)} <= got


def test_every_leak_of_a_short_item_holds_a_seed():
    masks = [[0, 1, 3, 4], [0, 1, 2]]
    seen = 0
    for n in range(D.SHORTEST, D.SPAN):
        for bits in range(1 << n):
            same = [bool(bits >> i & 1) for i in range(n)]
            best = max((sum(1 if s else -D.MISMATCH for s in same[a:b]), sum(same[a:b])) for a in range(n) for b in range(a + 1, n + 1))
            if best[0] > 0 and best[1] >= min(D.MATCHES, -(-n * 7 // 10)):
                seen += 1
                assert any(all(i + k < n and same[i + k] for k in m) for m in masks for i in range(n)), same
    assert seen > 50


def test_a_word_of_a_benchmark_does_not_empty_the_corpus(spark, documents, prose):
    bench = spark.createDataFrame([(1, "yes"), (2, "in Paris"), (3, "the cat sat down"), (4, "antidisestablishmentarianism")], "item_id bigint, text string")
    docs = documents([(1, prose(1, 9) + " yes"), (2, "It is in Paris."), (3, "So the cat sat down, yes?"), (4, "On antidisestablishmentarianism"), (5, prose(2, 9))])
    assert sorted((r.doc_id, r.item_id, r.telling) for r in D.overlaps(docs, bench).collect()) == [(1, 1, False), (2, 2, False), (3, 1, False), (3, 3, True), (4, 4, True)]
    assert sorted(r.doc_id for r in D.decontaminated(docs, bench).collect()) == [1, 2, 5]


def test_blocks_give_the_same(spark, documents, items, prose, monkeypatch):
    docs = documents(enumerate(planted(items, prose)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(D.overlaps(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_SEEDS", 60)
    assert sorted(D.overlaps(docs, bench).collect()) == whole


def test_rows_that_stay(spark, documents, items, prose):
    leak = prose(1, 20) + " " + items[0][1]
    docs = documents([(1, leak), (1, leak), (None, leak), (2, prose(2, 50)), (None, prose(3, 50)), (3, None), (4, "")])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    left = D.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([2, None, 3, 4], key=repr)
    assert D.decontaminated(docs, bench.limit(0)).count() == 7
    assert D.overlaps(documents([]), bench).collect() == []


def test_plan_is_native(spark, documents, items):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    plan = D.overlaps(documents([(1, "x")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def by_rule(docs, items):
    """Every text and item with a leak, over all diagonals and stretches; no masks."""
    out = set()
    for key, text in docs:
        w = words(text)
        for item, sample in items:
            v = words(sample)
            for d in range(-len(v), len(w)):
                same = [0 <= i + d < len(w) and w[i + d] == v[i] for i in range(len(v))]
                best = max((sum(1 if s else -D.MISMATCH for s in same[a:b]), sum(same[a:b])) for a in range(len(v)) for b in range(a + 1, len(v) + 1))
                if best[0] > 0 and best[1] >= min(D.MATCHES, -(-len(v) * 7 // 10)):
                    out.add((key, item))
    return out


def beginnings(equal, most):
    """Every order in which the first ``equal`` equal words of a leak can stand in at most ``most`` words."""
    found, open_ = [], [((), 0)]
    while open_:
        same, score = open_.pop()
        if sum(same) == equal:
            found.append(same)
        elif len(same) < most:
            open_.append(((*same, True), score + 1))
            if score >= D.MISMATCH:
                open_.append(((*same, False), score - D.MISMATCH))
    return found


def test_every_leak_holds_a_seed():
    masks = [sorted({a * x + b * y + c * z for x in (0, 1) for y in (0, 1) for z in (0, 1)}) for a, b, c in D.SHIFTS]
    orders = beginnings(10, 14) + beginnings(9, 12) + beginnings(8, 11)
    assert len(orders) > 400
    for same in orders:
        assert any(all(i + k < len(same) and same[i + k] for k in m) for m in masks for i in range(len(same)))


def test_finds_whatever_the_rule_calls_a_leak(spark, documents, prose):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([59, 40, 15, 12, 11])]
    docs = []
    for i, (_, text) in enumerate(items):
        w = text.split(" ")
        for every in (3, 4, 5):
            docs.append(prose(i, 20) + " " + " ".join("changed" if at % every == every - 1 else x for at, x in enumerate(w)))
        docs += [prose(i + 40, 20) + " " + " ".join(w[1 : 1 + many]) + " " + prose(i + 60, 20) for many in (7, 8, 9, 10)]
    docs = list(enumerate(docs))
    want = by_rule(docs, items)
    assert {(1, 0), (2, 0), (6, 0), (26, 3)} <= want and len(want) < len(docs)
    schema = "item_id bigint, text string"
    leaks = lambda rows: {(r.doc_id, r.item_id) for r in D.overlaps(documents(docs), spark.createDataFrame(rows, schema)).collect()}
    assert leaks(items) == want
    assert leaks([*items, (9, prose(900, 9))]) == want  # whatever other items there are


def test_items_without_id_and_items_of_the_same_id(spark, documents, prose):
    bench = spark.createDataFrame([(None, prose(1, 20)), (None, prose(2, 20)), (7, prose(3, 20)), (7, prose(4, 20)), (7, prose(4, 20))], "item_id bigint, text string")
    docs = documents([(k, prose(50 + k, 10) + " " + prose(k, 20)) for k in range(1, 6)])
    got = D.overlaps(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id or 0, r.matches) for r in got) == [(1, 0, 20), (2, 0, 20), (3, 7, 20), (4, 7, 20)]
    assert [r.doc_id for r in D.decontaminated(docs, bench).collect()] == [5]


def test_short_items_are_found_whole(spark, documents, prose):
    whole = "alpha beta gamma delta epsilon zeta eta".split()
    bench = spark.createDataFrame([(n, " ".join(whole[-n:])) for n in range(1, 8)] + [(0, "..."), (None, "one two three")], "item_id bigint, text string")
    docs = [(n, prose(n, 9) + ". " + " ".join(whole[-n:]).upper() + "! " + prose(n + 20, 5)) for n in range(1, 8)]
    docs += [(10, " ".join(whole[:6])), (11, "One, two -- three; one two three"), (12, "one two x three"), (13, ""), (14, None)]
    got = D.overlaps(documents(docs), bench).collect()
    want = {(n, m): m for n in range(1, 8) for m in range(1, n + 1)} | {(11, None): 3}
    assert {(r.doc_id, r.item_id): r.matches for r in got} == want and len(got) == len(want)
    assert next(r.doc_start for r in got if r.doc_id == 11) == 0
