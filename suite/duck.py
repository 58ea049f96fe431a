"""Pieces of checking SQL. Written independently of the library: another engine, another regex dialect."""

from __future__ import annotations

SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim_all(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def normalized(x: str) -> str:
    return collapse(f"lower({x})")


def strip_element(x: str, name: str) -> str:
    return f"regexp_replace({x}, '(?is)<{name}[^a-z0-9-].*?</{name}>', ' ', 'g')"


_ENTITY = "(?i)&(?:#x?[0-9a-f]+|[a-z]+);"


def decode_entities(x: str) -> str:
    token = (
        "CASE lower(k) WHEN '&amp;' THEN '&' WHEN '&apos;' THEN '''' WHEN '&gt;' THEN '>' WHEN '&lt;' THEN '<' "
        "WHEN '&nbsp;' THEN ' ' WHEN '&quot;' THEN '\"' ELSE CASE "
        "WHEN regexp_matches(k, '(?i)^&#x0*[0-9a-f]{1,5};$') THEN chr(CAST(lower(concat('0x', regexp_extract(k, '(?i)^&#x0*([0-9a-f]{1,5});$', 1))) AS INTEGER)) "
        "WHEN regexp_matches(k, '^&#0*[0-9]{1,6};$') THEN chr(CAST(regexp_extract(k, '^&#0*([0-9]{1,6});$', 1) AS INTEGER)) ELSE k END END"
    )
    return (
        "(SELECT array_to_string(list_transform(range(1, len(z.p) + 1), lambda i: concat(z.p[i], CASE WHEN i <= len(z.t) THEN z.t[i] ELSE '' END)), '') "
        f"FROM (SELECT regexp_split_to_array(y.v, '{_ENTITY}') AS p, list_transform(regexp_extract_all(y.v, '{_ENTITY}'), lambda k: {token}) AS t "
        f"FROM (SELECT {x} AS v) y) z)"
    )


def html_to_text(x: str) -> str:
    t = strip_element(strip_element(x, "script"), "style")
    t = f"regexp_replace({t}, '(?i)</(p|div|li|h[1-6]|tr)>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?i)<br{SPACE}*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^<>]+>', ' ', 'g')"
    t = decode_entities(t)
    t = rf"regexp_replace({t}, '[ \t\x{{a0}}]+', ' ', 'g')"
    t = rf"regexp_replace({t}, '\n{SPACE}+', chr(10), 'g')"
    return trim_all(t)


def round_up(x: str) -> str:
    return f"floor({x} + 0.5)"


def band(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 90 THEN 'Excellent Match' WHEN {x} >= 80 THEN 'Strong Match' WHEN {x} >= 65 THEN 'Possible Match' "
        f"WHEN {x} >= 50 THEN 'Stretch Opportunity' WHEN {x} >= 1 THEN 'Weak Match' ELSE 'Do Not Apply' END"
    )


def violations() -> str:
    """The listing contract over the columns in scope."""

    def size(n: str, lo: int, hi: int) -> str:
        return f"CASE WHEN NOT coalesce(length({trim_all(n)}) BETWEEN {lo} AND {hi}, false) THEN {q(n)} END"

    def one(n: str, values: str) -> str:
        listed = ",".join(q(v) for v in values.split("|"))
        return f"CASE WHEN coalesce({n}, '') NOT IN ({listed}) THEN {q(n)} END"

    def money(n: str) -> str:
        return f"CASE WHEN {n} < 0 OR {n} > 10000000 OR {n} <> floor({n}) THEN {q(n)} END"

    parts = [
        size("title", 2, 200), size("company", 1, 200), size("description", 20, 100000), size("location", 0, 200),
        size("country", 0, 200), size("industry", 0, 200),
        one("employment_type", "Full-time|Contract|Fractional|Consulting|Temporary|Permanent|Unknown"),
        one("seniority", "Manager|Senior Manager|Director|Senior Director|VP|SVP|EVP|C-Level|Founder|Advisor|Consultant|Individual Contributor|Unknown"),
        one("work_type", "Remote|Hybrid|On-site|Unknown"), money("salary_min"), money("salary_max"),
        "CASE WHEN salary_min > salary_max THEN 'salary_range' END",
        one("salary_period", "year|hour|month|week|day|unknown"), one("currency", "CAD|USD|EUR|GBP|Unknown"),
        r"CASE WHEN NOT (regexp_matches(coalesce(job_url, ''), '^(?i:https?)://[^\s/?#]+[^\s]*$') AND length(job_url) <= 2000) THEN 'job_url' END",
    ]
    return "concat_ws(',', " + ", ".join(parts) + ")"
