"""URL expressions: parts, canonical form, resolution and admission."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, regexp_map, trim_all

_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_AUTHORITY = r"^(?:([^@]*)@)?(\[[^\]]*\]|[^:]*)(?::(\d*))?$"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$"

# Suffixes under which a registrable name has three labels.
TWO_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "co.kr",
    "co.in", "co.za", "com.br", "com.mx", "com.ar", "com.sg", "com.hk", "com.tr", "co.il",
)

# Hosts of applicant tracking systems a careers page may link to.
ATS_HOSTS = (
    r"(?i)(^|\.)(boards\.greenhouse\.io|job-boards\.greenhouse\.io|boards-api\.greenhouse\.io|jobs\.lever\.co"
    r"|api\.lever\.co|jobs\.ashbyhq\.com|api\.ashbyhq\.com|myworkdayjobs\.com|jobs\.smartrecruiters\.com"
    r"|icims\.com|taleo\.net)$"
)


def _percent(run: Column) -> Column:
    return F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))


def encode_path(c: Column) -> Column:
    """Percent-encode what a path may not hold; existing escapes stay."""
    return regexp_map(c, r"(?:[^\x21-\x7e]|[\"<>`{}])+", _percent)


def encode_query(c: Column) -> Column:
    return regexp_map(c, r"(?:[^\x21-\x7e]|[\"<>'])+", _percent)


def url_struct(url: Column) -> Column:
    """``struct(origin, scheme, user, host, port, path, query)``; null when the text is not an absolute web URL.

    Scheme and host are lower case, a default port is dropped and an empty path is ``/``.
    """

    def build(v: Column) -> Column:
        scheme = F.lower(F.regexp_extract(v, _URL, 1))
        authority = F.regexp_extract(v, _URL, 2)
        port = F.regexp_extract(authority, _AUTHORITY, 3)
        path = F.regexp_extract(v, _URL, 3)
        default = ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80"))
        user = F.regexp_extract(authority, _AUTHORITY, 1)
        host = F.lower(F.regexp_extract(authority, _AUTHORITY, 2))
        shown_port = F.when(default | (port == ""), "").otherwise(F.concat(F.lit(":"), port))
        parts = F.named_struct(
            F.lit("origin"), F.concat(
                scheme, F.lit("://"), F.when(user != "", F.concat(user, F.lit("@"))).otherwise(""), host, shown_port
            ),
            F.lit("scheme"), scheme,
            F.lit("user"), user,
            F.lit("host"), host,
            F.lit("port"), F.when(default, "").otherwise(port),
            F.lit("path"), remove_dots(F.when(path == "", "/").otherwise(encode_path(path))),
            F.lit("query"), encode_query(F.regexp_extract(v, _URL, 4)),
        )
        wellformed = v.rlike(r"^(?i:https?)://(?:[^/?#@]*@)?(?:\[[0-9a-fA-F:.]+\]|[^/?#@:\s\[\]<>|^%\\]+)(?::\d{0,5})?(?:[/?#]|$)")
        return F.when(wellformed, parts)

    return let(trim_all(url), build)


def remove_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def walk(v: Column) -> Column:
        segments = F.split(F.substr(v, F.lit(2)), "/", -1)
        last = F.element_at(segments, -1)

        def step(kept: Column, segment: Column) -> Column:
            shorter = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
            return (
                F.when(segment == "..", shorter)
                .when(segment == ".", kept)
                .otherwise(F.concat(kept, F.array(segment)))
            )

        folded = F.aggregate(segments, F.array().cast("array<string>"), step)
        tail = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.lit("/"), F.array_join(F.concat(folded, tail), "/"))

    return let(path, lambda v: F.when(v.contains("/.") & v.rlike(r"/\.\.?(/|$)"), walk(v)).otherwise(v))


def url_text(parts: Column, query: Column | None = None) -> Column:
    """The text of a URL from its parts, without fragment."""
    query = parts["query"] if query is None else query
    return F.concat(parts["origin"], parts["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _form_pair(pair: Column) -> Column:
    """``name=value`` decoded and written back the way a form serializer writes it."""

    def recode(text: Column) -> Column:
        return F.url_encode(F.coalesce(F.try_url_decode(text), text))

    at = F.instr(pair, "=")
    name = F.when(at > 0, F.substr(pair, F.lit(1), at - 1)).otherwise(pair)
    value = F.when(at > 0, F.substr(pair, at + 1)).otherwise("")
    return F.struct(F.coalesce(F.try_url_decode(name), name).alias("name"), F.concat(recode(name), F.lit("="), recode(value)).alias("text"))


def canonical_query(query: Column) -> Column:
    """Tracking parameters removed, the rest in name order; equal names keep their order."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), _form_pair)
    kept = F.filter(pairs, lambda p: ~p["name"].rlike(r"(?i)^(utm_|ref$|source$)"))
    placed = F.transform(kept, lambda p, i: F.struct(p["name"].alias("name"), i.alias("at"), p["text"].alias("text")))
    return F.array_join(F.transform(F.array_sort(placed), lambda p: p["text"]), "&")


def canonical_url(url: Column) -> Column:
    """No fragment, no tracking parameters, sorted query; null for text that is not a web URL."""
    return let(url_struct(url), lambda p: F.when(p.isNotNull(), url_text(p, canonical_query(p["query"]))))


def resolve_url(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL seen from ``base`` (a struct of URL parts), without fragment.

    Null for other schemes and for text that cannot be read as a URL.
    """

    def absolute(h: Column) -> Column:
        return let(url_struct(h), lambda p: F.when(p.isNotNull(), url_text(p)))

    def relative(h: Column, b: Column) -> Column:
        # most links of a page are paths on its own host: they need no parsing of their own
        at = F.instr(h, "?")
        path = F.when(at > 0, F.substr(h, F.lit(1), at - 1)).otherwise(h)
        query = F.when(at > 0, encode_query(F.substr(h, at + 1))).when(h == "", b["query"]).otherwise("")
        full = let(path, lambda p: F.when(p == "", b["path"]).when(p.startswith("/"), encode_path(p)).otherwise(
            F.concat(F.regexp_extract(b["path"], r"(?s)^(.*/)", 1), encode_path(p))
        ))
        return F.concat(b["origin"], remove_dots(full), let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))

    def pick(h: Column, b: Column) -> Column:
        return (
            F.when(h.startswith("//"), absolute(F.concat(b["scheme"], F.lit(":"), h)))
            .when(~h.startswith("/") & h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(h.rlike(r"^(?i:https?)://"), absolute(h)))
            .otherwise(F.when(b.isNotNull(), relative(h, b)))
        )

    whole = let(trim_all(href), lambda h: F.when(h.contains("#"), F.regexp_replace(h, r"(?s)#.*$", "")).otherwise(h))
    return let(base, lambda b: let(whole, lambda h: pick(h, b)))


def as_https(url: Column) -> Column:
    return F.regexp_replace(url, r"^http://", "https://")


def host_of(url: Column) -> Column:
    return let(url_struct(url), lambda p: p["host"])


def registrable_domain(host: Column) -> Column:
    """The last two labels of a public host, or three under a two-level suffix; else null."""

    def cut(h: Column) -> Column:
        labels = F.split(h, r"\.", -1)
        two = F.array_join(F.slice(labels, -2, 2), ".")
        three = two.isin(*TWO_LEVEL_SUFFIXES)
        public = (h != "") & ~h.rlike(_IPV4) & h.contains(".") & h.rlike(r"^[a-z0-9.-]+$") & ~h.contains("..")
        return F.when(public & ~three, two).when(
            public & three & (F.size(labels) >= 3), F.array_join(F.slice(labels, -3, 3), ".")
        )

    cleaned = F.regexp_replace(F.regexp_replace(F.lower(trim_all(host)), r"\.$", ""), r"^www\.", "")
    return let(cleaned, lambda h: F.when(F.size(F.split(h, r"\.", -1)) >= 2, cut(h)))


def url_admitted(url: Column) -> Column:
    """HTTPS, no credentials, default port, a dotted public name that is not an address."""

    def rule(p: Column) -> Column:
        host = p["host"]
        return F.coalesce(
            (p["scheme"] == "https") & (p["user"] == "") & (p["port"] == "") & ~host.endswith(".")
            & host.contains(".") & ~host.rlike(_IPV4) & ~host.startswith("["),
            F.lit(False),
        )

    return let(url_struct(url), rule)


def host_allowed(target: Column, origin_host: Column) -> Column:
    """A link may stay on the same registrable domain or go to a known ATS host, over HTTPS."""

    def rule(p: Column) -> Column:
        home = registrable_domain(origin_host)
        return F.coalesce(
            (p["scheme"] == "https") & home.isNotNull()
            & (F.coalesce(registrable_domain(p["host"]) == home, F.lit(False)) | p["host"].rlike(ATS_HOSTS)),
            F.lit(False),
        )

    return let(url_struct(target), rule)


def redact_url(url: Column) -> Column:
    """Origin and path only; text that is not a URL becomes a fixed placeholder."""
    return F.coalesce(
        let(url_struct(url), lambda p: F.when(p.isNotNull(), F.concat(
            p["scheme"], F.lit("://"), p["host"],
            F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""), p["path"],
        ))),
        F.lit("[unparseable url]"),
    )


def pointer_path(pointer: Column, digits_are_indexes: bool = True) -> Column:
    """An RFC 6901 pointer as a variant path; null for text that is not a pointer."""

    def segment(raw: Column) -> Column:
        key = F.replace(F.replace(raw, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        named = F.concat(F.lit('["'), key, F.lit('"]'))
        if not digits_are_indexes:
            return named
        return F.when(key.rlike(r"^(0|[1-9]\d{0,8})$"), F.concat(F.lit("["), key, F.lit("]"))).otherwise(named)

    steps = F.transform(F.split(F.substr(pointer, F.lit(2)), "/", -1), segment)
    return F.when(pointer == "", "$").when(
        pointer.startswith("/") & ~pointer.contains('"'), F.concat(F.lit("$"), F.array_join(steps, ""))
    )


def pointer_get(document: Column, pointer: Column, as_type: str = "variant") -> Column:
    """RFC 6901 lookup in a variant; the pointer is data, so it may differ from row to row.

    A digit segment is an index into an array, and a plain key of an object.
    """
    indexed = F.try_variant_get(document, pointer_path(pointer), as_type)
    named = F.try_variant_get(document, pointer_path(pointer, digits_are_indexes=False), as_type)
    return F.coalesce(indexed, F.when(pointer.rlike(r"/\d+(/|$)"), named))


def pointer_text(document: Column, pointer: Column) -> Column:
    """A string (trimmed) or number at a pointer as text; anything else, or no pointer, is an empty string."""
    kind = F.schema_of_variant(pointer_get(document, pointer))
    plain = (kind == "STRING") | kind.rlike("^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.coalesce(F.when(plain & (pointer != ""), trim_all(pointer_get(document, pointer, "string"))), F.lit(""))
