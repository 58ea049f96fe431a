from listingspark.operators import robots


def by_hand(text):
    """``agent, line, allow, path`` of every rule, reading line by line."""
    groups, open_ = [], False
    for number, raw in enumerate((text or "").replace("\r\n", "\n").split("\n")):
        name, colon, value = raw.split("#")[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or name not in ("user-agent", "allow", "disallow"):
            continue
        if name == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif groups:
            open_ = False
            if name == "allow" or value:
                groups[-1][1].append((number, name == "allow", value))
        else:
            open_ = False
    rows = []
    for agents, rules in groups:
        for agent in dict.fromkeys(agents):
            rows += [(agent, *r) for r in rules] or [(agent, None, None, None)]
    return sorted(rows, key=str)


TEXTS = [
    "Disallow: /early\nUser-agent: *\nDisallow: /a\nAllow: /a/b # why\n\nUser-Agent: Bot\nuser-agent: other\nUser-agent: BOT\nDisallow:\nSitemap: x\nDisallow: /c d\r\nAllow:",
    "User-agent: lonely", "User-agent:\nDisallow: /x", "", None, "no colon here\n:\n: x\nUser-agent : * \n Disallow : /p:q:r", "User-agent: a\nDisallow: /\nUser-agent: b\nUser-agent: a\nAllow: /U1 x\nAllow: /U1 x",
    "User-agent: a\nCrawl-delay: 3\nUser-agent: b\nDisallow: /same group",
]


def test_rules_equal_a_reading_line_by_line(spark):
    files = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(TEXTS)], "host string, text string")
    found = {}
    for r in robots.robots_rules(files).collect():
        found.setdefault(r.host, []).append((r.agent, r.line, r.allow, r.path))
    for i, text in enumerate(TEXTS):
        assert sorted(found.get(f"h{i}", []), key=str) == by_hand(text), text


def test_long_texts_in_their_row(spark):
    text = "\n".join(f"User-agent: a{i % 3000}\nDisallow: /{i}" for i in range(30_000)) + "\nUser-agent: *\n" + "\n".join(f"Disallow: /x{i}" for i in range(50_000))
    rules = robots.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert rules.count() == 80_000
