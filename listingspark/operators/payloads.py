"""Learning how a saved JSON response is read: where its postings are, which field is which, how it pages."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions.rows import with_once
from ..functions.text import let
from ..functions.urls import _form_pair, pointer_get, url_struct, url_text
from .joins import spread_join

# Keys that name a posting's fields, in the order the fields are mapped.
FIELD_KEYS = (
    ("title", "title|jobTitle|name|position|positionName|role", None),
    ("url", "url|absolute_url|absoluteUrl|applyUrl|apply_url|link|href|jobUrl|hostedUrl", None),
    ("id", "id|jobId|job_id|requisitionId|reqId|slug", None),
    ("location", "location|locationName|location_name|city|office", "name|city|label|text"),
    ("description", "description|content|body|descriptionHtml|jobDescription", None),
    ("posted_at", "postedAt|posted_at|datePosted|createdAt|created_at|updatedAt|updated_at|publishedAt", None),
)
PAGE_KEY = "(?i)^(page|pageNumber|page_number|pageIndex|p)$"
HEADERS = ("accept", "content-type", "x-requested-with")

_TITLE = re.compile("title|name|position", re.I)
_LINK = re.compile("url|link|href|permalink", re.I)


def _posting_like(entry: object) -> bool:
    if not isinstance(entry, dict):
        return False
    texts = [k for k, v in entry.items() if isinstance(v, str) and v.strip()]
    return any(map(_TITLE.search, texts)) and any(map(_LINK.search, texts))


_TOKEN = re.compile(r'[ \t\r\n]*([{}\[\],:]|"|[^ \t\r\n{}\[\],:"]+)')


def _read_deep(text: str) -> object:
    """``json.loads`` with a stack of its own, for texts that nest deeper than the interpreter's stack allows."""
    open_: list[tuple[object, str | None]] = []  # containers around the current place, and the key they stand under
    root: list = []
    here, key, want, at = root, None, "value", 0
    while found := _TOKEN.match(text, at):
        token, at = found.group(1), found.end()
        if token in "}]" and want in ("more", "first") and len(open_) > 0 and (token == "}") == isinstance(here, dict):
            done, (here, key) = here, open_.pop()
        elif token in "}],":
            if token != "," or want != "more" or not open_:
                raise ValueError(token)
            want = "key" if isinstance(here, dict) else "value"
            continue
        elif want in ("key", "first") and isinstance(here, dict):
            if token != '"':
                raise ValueError(token)
            key, at = scanstring(text, at)
            colon = _TOKEN.match(text, at)
            if not colon or colon.group(1) != ":":
                raise ValueError("no colon")
            at, want = colon.end(), "value"
            continue
        elif want not in ("value", "first"):
            raise ValueError(token)
        elif token in "{[":
            open_.append((here, key))
            here, key, want = {} if token == "{" else [], None, "first"
            continue
        elif token == '"':
            done, at = scanstring(text, at)
        else:
            done = json.loads(token)
        if isinstance(here, dict):
            here[key] = done
        else:
            here.append(done)
        want = "more" if open_ else "end"
    if want != "end" or text[at:].strip(" \t\r\n"):
        raise ValueError("no whole value")
    return root[0]


def _array_pointer(text: str | None) -> str | None:
    """Depth first, in document order, without recursion: a payload may nest as deep as it is long."""
    try:
        value = json.loads(text or "")
    except RecursionError:
        value = _deep_or_none(text)
    except ValueError:
        return None
    stack = [(value, "")]
    while stack:
        node, pointer = stack.pop()
        if isinstance(node, list):
            if len(node) >= 2 and all(map(_posting_like, node)):
                return pointer
        elif isinstance(node, dict):
            stack.extend(reversed([(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}") for k, v in node.items()]))
    return None


def _deep_or_none(text: str) -> object:
    try:
        return _read_deep(text)
    except ValueError:
        return None


@pandas_udf(StringType())
def listing_array_pointer(payloads: pd.Series) -> pd.Series:
    """Pointer to the first array of two or more posting-like objects. The search descends to any depth in Arrow batches:
    built-in functions have to parse what is below again at every level, which took eighty times as long on payloads 120 levels deep."""
    return payloads.map(_array_pointer)


def find_listing_array(payloads: DataFrame) -> DataFrame:
    """``payload_id`` and the pointer to its postings, null when there are none."""
    return payloads.select("payload_id", listing_array_pointer("payload").alias("jobs_path"))


def _escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def infer_field_map(samples: DataFrame) -> DataFrame:
    """Pointers for the six posting fields, from the keys of a sample object (``payload_id, sample`` as JSON).

    Keys are tried in document order; a nested location is read one level down. Without a title or
    a URL there is no map.
    """
    entries = F.zip_with(
        F.map_entries(F.from_json("sample", "map<string,string>")),
        F.map_entries(F.from_json("sample", "map<string,variant>")),
        lambda raw, typed: F.struct(raw["key"].alias("key"), raw["value"].alias("raw"), F.schema_of_variant(typed["value"]).alias("kind")),
    )
    parsed = samples.select("payload_id", entries.alias("entries"))

    def pick(pattern: str, nested: str | None) -> Column:
        def pointer(e: Column) -> Column:
            plain = (e["kind"] == "STRING") | e["kind"].rlike("^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
            found = F.when(plain, F.concat(F.lit("/"), _escape(e["key"])))
            if nested is None:
                return found
            inner = F.get(F.filter(F.json_object_keys(e["raw"]), lambda k: k.rlike(f"(?i)^({nested})$")), 0)
            return found.when(
                e["kind"].startswith("OBJECT") & inner.isNotNull(),
                F.concat(F.lit("/"), _escape(e["key"]), F.lit("/"), _escape(inner)),
            )

        named = F.filter("entries", lambda e: e["key"].rlike(f"(?i)^({pattern})$"))
        return F.get(F.filter(F.transform(named, pointer), lambda p: p.isNotNull()), 0)

    mapped = parsed.select("payload_id", *[pick(p, n).alias(name) for name, p, n in FIELD_KEYS])
    complete = F.col("title").isNotNull() & F.col("url").isNotNull()
    return mapped.select("payload_id", *[F.when(complete, F.col(n)).alias(n) for n, _, _ in FIELD_KEYS])


def page_template(requests: DataFrame) -> DataFrame:
    """A request that can be replayed page by page: ``request_id, url, headers`` (map) and ``body``.

    Page-like query parameters become ``{page}``; only without one is the first page-like field of a
    JSON body replaced. A body that is not JSON gives no template then. Headers off the list are dropped.
    """
    parts = url_struct(F.col("url"))
    names = F.filter(F.split(parts["query"], "&"), lambda p: p != "")
    pairs = F.transform(names, _form_pair)
    in_query = F.exists(pairs, lambda p: p["name"].rlike(PAGE_KEY))
    placed = F.transform(pairs, lambda p, i: F.struct(p["name"].alias("name"), p["text"].alias("text"), i.alias("i")))
    # setting a parameter replaces its first occurrence and drops the repeats
    kept = F.filter(placed, lambda p: ~p["name"].rlike(PAGE_KEY) | (
        F.array_position(F.transform(placed, lambda q: q["name"]), p["name"]) == p["i"] + 1
    ))
    query = F.array_join(F.transform(kept, lambda p: F.when(
        p["name"].rlike(PAGE_KEY), F.concat(F.url_encode(p["name"]), F.lit("={page}"))
    ).otherwise(p["text"])), "&")
    fields = F.from_json("body", "map<string,variant>")
    document = F.try_parse_json("body")
    key = F.get(F.filter(F.map_keys(fields), lambda k: k.rlike(PAGE_KEY)), 0)
    body = F.when(
        key.isNotNull(),
        F.to_json(F.transform_values(fields, lambda k, v: F.when(k == key, F.parse_json(F.lit('"{page}"'))).otherwise(v))),
    ).otherwise(F.col("body"))
    has_body = F.coalesce(F.col("body"), F.lit("")) != ""
    usable = in_query | ~has_body | document.isNotNull()
    return requests.select(
        "request_id",
        F.when(usable, F.when(in_query, let(parts, lambda p: url_text(p, query))).otherwise(F.col("url"))).alias("url_template"),
        F.when(usable, F.when(in_query | ~has_body, F.col("body")).otherwise(body)).alias("body"),
        F.map_filter("headers", lambda k, v: F.lower(k).isin(*HEADERS)).alias("headers"),
        usable.alias("usable"),
    )


def verify_field_map(payloads: DataFrame, patterns: DataFrame) -> DataFrame:
    """Whether a stored payload still gives postings and every mapped field; ``reason`` says what is missing."""
    joined = spread_join(payloads, patterns, "source_id", "payload")
    found = with_once(joined, found=pointer_get(F.try_parse_json("payload"), F.col("jobs_path")))
    rows = with_once(found, items=F.try_variant_get("found", "$", "array<variant>"))
    first = F.get(F.col("items"), 0)
    reason = F.when(~F.coalesce(F.schema_of_variant("found").startswith("ARRAY"), F.lit(False)), "No postings at jobsPath").when(
        F.size("items") == 0, "Replay returned no postings"
    )
    for name in ("title", "url", "id", "location", "description", "posted_at"):
        pointer = F.col(f"p_{name}")
        reason = reason.when(pointer.isNotNull() & F.isnull(pointer_get(first, pointer)), f"Cannot resolve field {name}")
    return rows.select(
        "source_id", reason.isNull().alias("ok"), F.when(reason.isNull(), F.size("items").cast("bigint")).alias("postings"), reason.alias("reason")
    )
