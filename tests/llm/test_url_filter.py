import math
import re
from collections import Counter

import pytest

from listingspark.llm import url_filter as U
from listingspark.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.A.NET/en/x", "https://a.example.net/en/1?q=/de/", "https://notnet/", "https://net/", "http://x.net", "https://example.com/de/1#x",
    "https://sub.example.com/de/", "https://example.com/DE/1", "https://a.org/fr/ä漢", "https://b.org/fr", "ftp://c.org/fr/?x", "a://b://c.net/", "https://example.net/en/", "http://a.net:80/",
    "https://d.org/other/" + "x" * 3000, "http://evil.com?x.net/",
] + [f"https://host{i}.example.com/en/{i}" for i in range(30)] + [f"https://h{i}.net/{i}" for i in range(30)] + [f"https://o{i}.org/fr/{i}" for i in range(30)]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def rule(host, path):
    fits = [(own + start, says) for own, start, says in URL_RULES if (host == own or host.endswith("." + own)) and path.startswith(start)]
    return max(fits, key=lambda r: len(r[0])) if fits else (None, None)


def characters(url, host):
    text = url or ""
    if "://" in text:
        text = host + re.sub(r"(?s)^[^/?#]*", "", text.split("://", 1)[1])
    return [U.BEGIN] * U.ORDER + list(text) + [U.END]


def by_hand(urls):
    rows = [(*parts(u), *rule(*parts(u))) for u in urls]
    seqs = [characters(u, r[0]) for u, r in zip(urls, rows, strict=True)]
    grams = lambda s: [tuple(s[i : i + U.ORDER + 1]) for i in range(len(s) - U.ORDER)]
    counts = {y: Counter(g for s, r in zip(seqs, rows, strict=True) if r[3] == y for g in grams(s)) for y in ("allow", "block")}

    def probability(count, gram):
        p = 1 / U.CHARACTERS
        for k in range(U.ORDER + 1):
            context, last = gram[U.ORDER - k : U.ORDER], gram[-1]
            same = {g: n for g, n in count.items() if g[U.ORDER - k : U.ORDER] == context}
            if same:
                kinds = len({g[-1] for g in same})
                p = (sum(n for g, n in same.items() if g[-1] == last) + kinds * p) / (sum(same.values()) + kinds)
        return p

    weight = {}
    for s in seqs:
        for g in grams(s):
            weight[g] = weight.get(g) or math.log(probability(counts["allow"], g)) - math.log(probability(counts["block"], g))
    scores = [sum(weight[g] for g in grams(s)) / len(grams(s)) for s in seqs]
    stats = {}
    for y in counts:
        own = [x for x, r in zip(scores, rows, strict=True) if r[3] == y]
        mean = sum(own) / len(own)
        stats[y] = mean, math.sqrt(sum((x - mean) ** 2 for x in own) / len(own))
    (ma, sa), (mb, sb) = stats["allow"], stats["block"]
    cut = (ma * sb + mb * sa) / (sa + sb)
    return [(h, p, name, says or ("allow" if x >= cut else "block"), x) for (h, p, name, says), x in zip(rows, scores, strict=True)]


def test_equals_by_hand(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").selectExpr("*", "'x' AS host", "'x' AS label", "'x' AS score", "'x' AS gram")
    rows = U.judged(pages, URL_RULES).orderBy("page_id").collect()
    for r, (host, path, name, verdict, score) in zip(rows, by_hand(URLS), strict=True):
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, verdict), URLS[r.page_id]
        assert r.score == pytest.approx(score, abs=1e-9)


def test_without_examples_all_is_allowed(spark):
    pages = spark.createDataFrame([(1, "https://a.io/x"), (1, "https://a.io/x"), (None, None)], "page_id bigint, url string")
    assert [(r.verdict, r.score) for r in U.judged(pages, URL_RULES).collect()] == [("allow", 0.0)] * 3
    assert U.judged(pages.limit(0), URL_RULES).collect() == []


def test_plan_is_native(spark):
    plan = U.judged(spark.createDataFrame([(1, "x")], "page_id bigint, url string"), URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


def test_query_and_other_scripts_count(spark):
    """URLs that differ only behind the path, or in letters that are not Latin, are told apart."""
    rules = [("net", "/", "block"), ("org", "/", "allow")]
    urls = [f"https://a{i}.net/x?casino={i}" for i in range(20)] + [f"https://b{i}.org/x?lesson={i}" for i in range(20)]
    urls += [f"https://\u043a\u0430\u0437\u0438\u043d\u043e{i}.net/" for i in range(20)] + [f"https://\u0443\u0440\u043e\u043a{i}.org/" for i in range(20)]
    asked = ["https://c.io/x?casino=1", "https://c.io/x?lesson=1", "https://\u043a\u0430\u0437\u0438\u043d\u043e.io/ab", "https://\u0443\u0440\u043e\u043a.io/ab", "https://%%%%%%.io/ab"]
    rows = U.judged(spark.createDataFrame(list(enumerate(urls + asked)), "page_id bigint, url string"), rules).orderBy("page_id").collect()[-5:]
    scores = [r.score for r in rows]
    assert scores[0] < scores[1] and scores[2] < scores[3] and len(set(scores)) == 5
    assert [r.verdict for r in rows[:4]] == ["block", "allow", "block", "allow"]


def test_a_very_long_url(spark):
    urls = [(1, "https://a.net/" + "x" * 200_000), (2, "https://b.org/fr/" + "\U0001f600" * 1000), (3, "https://c.io/")]
    assert len(U.judged(spark.createDataFrame(urls, "page_id bigint, url string"), URL_RULES).collect()) == 3
