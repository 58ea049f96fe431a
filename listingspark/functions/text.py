"""Text expressions: whitespace, markup, entities, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The white space a JavaScript regular expression calls \s.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# As a character class. Printable ASCII is refused first, so most of a text costs one comparison per character.
_WIDE = "\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[[^!-~]&&[\t\n\x0b\f\r {_WIDE}]]"

# Named entities that are decoded; every other name is left alone.
NAMED_ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, so a costly input is not repeated in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_all(c: Column) -> Column:
    """Trim every Unicode space, not only U+0020. Linear in the text."""
    return F.btrim(c, F.lit(SPACE_CHARS))


_OTHER_SPACE = f"[[^ -~]&&[\t\n\x0b\f\r{_WIDE}]]"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed. A lone plain space is not rewritten."""
    return F.trim(F.regexp_replace(c, f"{_OTHER_SPACE}{SPACE}*| {SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_nonblank(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def join_nonblank(separator: str, *columns: Column) -> Column:
    return F.array_join(F.filter(F.array(*columns), lambda v: v != ""), separator)


def regexp_map(c: Column, pattern: str, fn: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern`` by ``fn(match)`` in one pass over the text."""

    def rebuild(v: Column) -> Column:
        found = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), fn)
        pairs = F.zip_with(
            F.split(v, pattern, -1), found, lambda piece, token: F.array(piece, F.coalesce(token, F.lit("")))
        )
        return F.when(v.rlike(pattern), F.array_join(F.flatten(pairs), "")).otherwise(v)

    return let(c, rebuild)


def char_of(code_point: Column) -> Column:
    """The character of a Unicode code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code_point), 8, "0")), "UTF-32")


def _decode_piece(piece: Column) -> Column:
    """What follows an ampersand: an entity and the text after it, or plain text that keeps its ampersand."""
    body = F.lower(F.regexp_extract(piece, r"(?i)^(#x?[0-9a-f]+|[a-z]+);", 1))
    names = F.create_map(*[F.lit(x) for pair in NAMED_ENTITIES.items() for x in pair])

    def char(code: Column) -> Column:
        hexes = F.regexp_extract(code, r"^#x0*([0-9a-f]{1,8})$", 1)
        point = F.when(code.startswith("#x"), F.when(hexes != "", F.conv(hexes, 16, 10).try_cast("bigint"))).otherwise(
            F.regexp_extract(code, r"^#0*(\d{1,8})(?!\d)", 1).try_cast("bigint")
        )
        number = let(point, lambda p: F.when(p.between(1, 0x10FFFF) & ~p.between(0xD800, 0xDFFF), char_of(p)))
        return F.when(code == "", F.lit(None).cast("string")).when(code.startswith("#"), number).otherwise(F.try_element_at(names, code))

    def rebuild(code: Column) -> Column:
        return let(char(code), lambda c: F.when(c.isNull(), F.concat(F.lit("&"), piece)).otherwise(
            F.concat(c, F.substr(piece, F.length(code) + 2))
        ))

    return let(body, rebuild)


def decode_entities(c: Column) -> Column:
    """Decode named, decimal and hexadecimal entities once; ``&amp;lt;`` becomes ``&lt;``."""
    pieces = F.split(c, "&", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_decode_piece(p))), "")


def strip_element(c: Column, name: str) -> Column:
    """Remove ``<name ...>...</name>`` elements, each replaced by one space.

    Only the text up to the last closing tag can hold a complete element, so the
    lazy match always succeeds there and the work stays linear on hostile input.
    """
    close = f"</{name}>"

    def cut(v: Column) -> Column:
        return let(
            F.regexp_extract(v, f"(?is)^.*{close}", 0),
            lambda head: F.concat(
                F.regexp_replace(head, f"(?is)<{name}(?![a-z0-9-]).*?{close}", " "),
                F.substr(v, F.length(head) + 1),
            ),
        )

    return let(c, lambda v: F.when(_spelled(v, name), cut(v)).otherwise(v))


def _spelled(v: Column, name: str) -> Column:
    """Whether a closing tag may be there, whatever its casing: a byte search that spares most texts the regex."""
    a, b = name[0], name[1]
    found = F.lit(False)
    for pair in (a + b, a + b.upper(), a.upper() + b, (a + b).upper()):
        found = found | v.contains(f"</{pair}")
    return found


def html_to_text(c: Column) -> Column:
    """Readable text of an HTML fragment. Text without markup or entities skips those passes."""

    def unmark(v: Column) -> Column:
        text = strip_element(strip_element(v, "script"), "style")
        text = F.regexp_replace(text, r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n")
        text = F.regexp_replace(text, rf"(?i)<br{SPACE}*/?>", "\n")
        return F.when(v.contains("<"), F.regexp_replace(text, r"<[^<>]+>", " ")).otherwise(v)

    decoded = let(let(c, unmark), lambda v: F.when(v.contains("&"), decode_entities(v)).otherwise(v))
    spaced = F.replace(F.replace(decoded, F.lit("\t"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(spaced, " {2,}", " ")
    return trim_all(F.regexp_replace(text, f"\n{SPACE}+", "\n"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def normalized_text(c: Column) -> Column:
    """Lower case, single spaces, trimmed."""
    return collapse(F.lower(c))


def keyword_text(title: Column, company: Column, description: Column) -> Column:
    """The text keyword rules look at."""
    return normalized_text(F.concat_ws(" ", title, F.coalesce(company, F.lit("")), description))


def company_key(company: Column) -> Column:
    return normalized_text(company)
