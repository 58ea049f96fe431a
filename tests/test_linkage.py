import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from listingspark.operators import linkage as L

SCHEMA = "job_id long, source_id long, provider string, company string, title string, location string, description string, discovered_at long"
TITLES = ["Software Engineer", "Senior Software Engineer", "Data Engineer", "", "Lead Data Engineer Platform", "Nurse", "Software Engineer II"]
PLACES = ["London", "London, United Kingdom", "", None, "Berlin", "Remote"]


def listings(seed, many):
    rng = random.Random(seed)
    words = "we build data tools for teams and run them at scale in the cloud with care every day".split()
    base = " ".join(words)
    rows = []
    for i in range(many):
        text = list(words) * 3
        for _ in range(rng.choice([0, 0, 1, 4, 30])):
            text[rng.randrange(len(text))] = rng.choice("red blue green stone river".split())
        rows.append((i, rng.randrange(5), rng.choice(["JSON-LD", "Lever", "Adzuna"]), rng.choice(["Acme", "ACME, Inc.", "Acme Robotics", "The Beta", "", None]), rng.choice(TITLES),
                     rng.choice(PLACES), rng.choice([" ".join(text), base, None]), rng.randrange(9)))
    return rows


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def parts(row):
    d = words(row[6])
    runs = {tuple(d[i : i + 3]) for i in range(len(d) - 2)} if len(d) >= 3 else ({tuple(d)} if d else set())
    return set(words(row[3])) - set(L.LEGAL_FORMS), set(words(row[4])), set(words(row[5])), runs


def by_hand(rows):
    """All pairs of classes, scored one by one."""
    near = {"JSON-LD": 0, "Lever": 1}
    first = {}
    for r in sorted(rows, key=lambda r: (near.get(r[2], 2), r[7], r[0])):
        c, t, p, _ = parts(r)
        first.setdefault((frozenset(c), frozenset(t), frozenset(p), " ".join((r[6] or "").lower().split())), r)
    found = {}
    for a, b in itertools.combinations(first.values(), 2):
        if a[1] != b[1]:
            x, y = parts(a), parts(b)
            score = round(0.45 * jaccard(x[1], y[1]) + 0.2 * jaccard(x[0], y[0]) + 0.15 * jaccard(x[2], y[2]) + 0.2 * jaccard(x[3], y[3]), 9)
            if score >= 0.85:
                found[min(a[0], b[0]), max(a[0], b[0])] = score
    return found


@pytest.mark.parametrize("hot", [2, 10, 10_000])
def test_blocking_loses_no_pair(spark, hot):
    rows = listings(hot, 90)
    reps = L.representatives(L.classes(spark.createDataFrame(rows, SCHEMA))).cache()
    ids = {r.class_id: r["rank"].job_id for r in reps.collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))): r.score for r in L.duplicate_pairs(reps, hot=hot).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys() and len(want) > 20 and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_hot_block_is_split(spark):
    """One company lists one title 300 times over: its block falls apart by place and by what the descriptions say."""
    rows = [(i, i % 7, "Lever", "Acme", "Software Engineer", f"Town {i % 60}", f"we need {i} people for team{i} in hall{i} and site{i} now {i * 7}", i) for i in range(300)]
    rows += [(1000 + i, 8, "JSON-LD", "Acme Inc", "software engineer", f"town {i % 60}", rows[i][6] + " Apply", i) for i in range(0, 300, 3)]
    reps = L.representatives(L.classes(spark.createDataFrame(rows, SCHEMA))).cache()
    sizes = [r["count"] for r in L.blocks(reps, L.Weights(), 20).groupBy("block").count().collect()]
    assert max(sizes) <= 20
    got = {r.job_id: r.survivor_id for r in L.duplicate_listings(spark.createDataFrame(rows, SCHEMA), hot=20).collect()}
    assert all(got[i] == 1000 + i for i in range(0, 300, 3)) and all(got[i] == i for i in range(300) if i % 3)


def test_near_copies_are_not_split_by_what_they_share(spark):
    """Each of their runs of words would bring up all of them again; what they may lack altogether, a place word, is looked up instead."""
    base = [f"word{i}" for i in range(300)]
    rows = [(i, i % 5, "Lever", "Acme", "Software Engineer", f"Town {i % 3}" if i % 7 else None, " ".join([*base[:i], f"own{i}", *base[i + 1 :]]), i) for i in range(60)]
    rows += [(100 + i, 7, "JSON-LD", "Acme", "software engineer", "Elsewhere", rows[i][6], i) for i in range(0, 60, 5)]
    reps = L.representatives(L.classes(spark.createDataFrame(rows, SCHEMA))).cache()
    assert L.blocks(reps, L.Weights(), 20).count() <= 4 * len(rows)
    ids = {r.class_id: r["rank"].job_id for r in reps.collect()}
    got = {tuple(sorted((ids[r.a], ids[r.b]))): r.score for r in L.duplicate_pairs(reps, hot=20).collect()}
    want = by_hand(rows)
    assert got.keys() == want.keys() and any(b >= 100 for _, b in want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_of_each_source_and_survivor(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (1, 1, "Adzuna", "Acme", "Engineer", "Oslo", text, 1), (2, 2, "Lever", "Acme Inc", "Engineer", "Oslo", text + " eleven", 5),
        (3, 2, "Lever", "Acme", "Engineer", "Oslo", text + " eleven twelve", 4),  # second best of its source
        (4, 3, "JSON-LD", "ACME", "engineer", "OSLO", text, 9), (5, 4, "Adzuna", "Other", "Engineer", "Oslo", text, 0), (6, 5, None, None, None, None, None, None),
    ]
    got = {r.job_id: (r.survivor_id, r.links) for r in L.duplicate_listings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (4, 1), 4: (4, 1), 2: (4, 1), 3: (3, 0), 5: (5, 0), 6: (6, 0)}
    assert L.duplicate_listings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_pairs_are_scored_once(spark, monkeypatch):
    """Links read their pairs several times; the plan of those holds no comparison any more."""
    seen, whole = [], L.one_to_one
    monkeypatch.setattr(L, "one_to_one", lambda pairs, reps: seen.append(pairs) or whole(pairs, reps))
    assert L.duplicate_listings(spark.createDataFrame(listings(1, 30), SCHEMA)).count() == 30
    assert "array_intersect" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_need_follows_from_the_weights():
    w = L.Weights()
    assert w.need("company") > 0 and w.need("title") == pytest.approx(2 / 3) and w.need("description") == pytest.approx(0.25)
    p, d = w.either()
    assert w.title + w.company + w.place * p + w.description * d == pytest.approx(w.least)
