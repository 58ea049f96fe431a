"""Secret scan: fixed patterns, and values in a credential's place that are hard to guess.

Three patterns give the base spans (``assign``, ``access``, ``hex``). Wider contexts (a credential's name and a separator, a
bearer or basic token, the password of a URL or of a command) give values, and a value becomes a ``guess`` span if the cheapest
way to put it together costs ``Guessing.least`` or more, as a power of ten of guesses. The cost is the least sum over all
ways to cut the value into

* words: one in (corpus size / occurrences) guesses, with capitals and look-alike signs read as letters at a price,
* dates, with or without signs between their parts,
* repeats of a unit of up to ``Guessing.unit`` characters: what the unit costs as one span, and the number of repeats,
* walks over neighbouring keys, or through the alphabet: where they begin, and every turn,
* single characters by brute force, out of the kinds of characters that the value has.

Words are counted over all documents, less the values themselves, so a secret doesn't vouch for itself. Only the distinct
values' own stretches of letters meet those counts, in a join; no dictionary is collected or broadcast. A value inside a base
span is judged as well, so that ``guess`` also tells which base spans hold something hard to guess. Values have 6 characters or more and no white
space; references (``${NAME}``, ``<your-token>``, ``{{ x }}``, ``%NAME%``) and masks (``****``) are none.

Every row gives one row. Null and empty texts have no spans; repeated rows and rows without an id are rows like any other.
Texts are taken whole, whatever their length. Spans that begin at one place come in the order of ``KINDS``. Of further
columns only those named ``doc_id`` and ``text`` are read. An empty table gives an empty result. What the scan of the texts
finds is a table in the shared folder, with a number for each row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from listingspark.operators.joins import repeated_join

from .texts import own_columns, written

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Names that a credential's value follows, and what stands between them.
_NAMES = (
    r"pass(?:word|wd|phrase|code|key)?s?|pwd|pswd|secrets?|tokens?|credentials?|creds?|auth(?:orization|entication)?|jwt|cookie|signature|"
    r"(?:api|app|access|account|auth|client|consumer|encryption|master|private|secret|service|session|shared|signing|storage)[_ -]?(?:key|token|secret|id|pass(?:word|wd)?)"
)
_QUOTED = r"""(?P<%s>"[^"\r\n]*"|'[^'\r\n]*'|`[^`\r\n]*`|[^\s"'`<>,;()\[\]{}]+|[<\[({$%%][^\s"'`,;]*)"""
CONTEXTS = tuple(
    re.compile(p, re.IGNORECASE | re.ASCII)
    for p in (
        rf"(?<![A-Za-z])(?:{_NAMES})[A-Za-z0-9_]{{0,3}}[\"'`]?[ \t]*(?::=|=>|==?|:)[ \t]*(?:(?:bearer|basic|token)[ \t]+)?{_QUOTED % 'value'}",
        r"(?<![A-Za-z])(?:bearer|basic)[ \t]+(?P<value>[A-Za-z0-9+/_.=~-]{16,})",
        rf"(?<![^\s])--?(?:{_NAMES})[ \t=]+{_QUOTED % 'value'}",
        r"://[^\s:/@?#]*:(?P<value>[^\s/@]+)@",
    )
)
#: Any text with a base span or a value matches one of these; the engine that tries them takes no look-behinds.
HINT = r"(?i)akia[a-z0-9]|[0-9a-f]{32}|://[^\s:/@?#]*:[^\s/@]+@|(pass|pwd|pswd|secret|token|cred|auth|jwt|cookie|signature|bearer|basic|key|id)[a-z0-9_]*[\"'`]?[ \t]*([:=]|[ \t][\"'`]?\S{6})"
REFERENCE = re.compile(r"\$\{.*|\$\(.*|\$[A-Z_][A-Z0-9_]*|<.*>?|\{\{.*|\{.*\}|%[A-Za-z_][A-Za-z0-9_]*%|\[.*\]|[*.x_-]+", re.IGNORECASE)
_LEAST_LENGTH = 6


@dataclass(frozen=True)
class Guessing:
    """A value is a secret from 10**least guesses on."""

    least: float = 10.0
    #: Longest repeated unit, in characters; a longer one costs more than ``least`` unless it is made of words.
    unit: int = 32
    #: Longest word, and shortest.
    longest: int = 24
    shortest: int = 3
    #: Words that a small corpus is taken to hold on top of its own.
    prior: int = 100_000
    #: A guesser's dictionary: no word costs more.
    rarest: float = 7.0


_LOOKALIKE = str.maketrans({"4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "1": "i", "!": "i", "|": "l", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "2": "z"})
#: Rows of keys that walks go along; neighbours in a row, or above each other, are one step apart.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")


def _neighbours() -> dict[str, dict[str, int]]:
    """For each key, its neighbours and the direction they lie in."""
    at: dict[str, dict[str, int]] = {}
    for r, row in enumerate(_ROWS):
        for i, key in enumerate(row):
            near = at.setdefault(key, {})
            if i:
                near.setdefault(row[i - 1], 6 * (r == 4) + 0)
            if i + 1 < len(row):
                near.setdefault(row[i + 1], 6 * (r == 4) + 1)
    for upper, lower in ((0, 1), (1, 2), (2, 3)):
        for i, key in enumerate(_ROWS[lower]):
            shift = 1 if upper == 0 else 0
            for step, way in ((0, 2), (1, 3)):
                j = i + step + shift
                if j < len(_ROWS[upper]):
                    at[key].setdefault(_ROWS[upper][j], way)
                    at[_ROWS[upper][j]].setdefault(key, way + 2)
    return at


_NEAR = _neighbours()
_YEAR = re.compile(r"(?:19|20)\d\d")
_DATE = tuple(
    re.compile(p)
    for p in (
        r"(?P<d>\d{1,2})(?P<s>[-/._ ]?)(?P<m>\d{1,2})(?P=s)(?P<y>(?:19|20)\d\d|\d\d)",
        r"(?P<y>(?:19|20)\d\d|\d\d)(?P<s>[-/._ ]?)(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})",
    )
)
_PATTERNS = math.log10(5)  # which kind of span comes next


def alphabet(value: str) -> int:
    """How many characters the kinds of characters of a value hold."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 10 if value.isdigit() else 16
    kinds = (str.isdigit, 10), (str.islower, 26), (str.isupper, 26), (lambda c: not c.isalnum() and c < "\x7f", 33), (lambda c: c >= "\x7f", 100)
    return sum(size for holds, size in kinds if any(map(holds, value)))


def plain(value: str) -> str:
    """The value in small letters, look-alike signs as letters; of the same length, as only single letters change."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in value).translate(_LOOKALIKE)


def stretches(value: str, guessing: Guessing = Guessing()) -> set[str]:
    """All stretches of letters that a word could be."""
    found = set()
    for run in re.finditer(r"[^\W\d_]+", plain(value)):
        letters = run.group()
        for i in range(len(letters)):
            found.update(letters[i:j] for j in range(i + guessing.shortest, min(len(letters), i + guessing.longest) + 1))
    return found


def _spelling(written_as: str, word: str) -> float:
    """The price of capitals and look-alike signs."""
    upper = sum(c.isupper() for c in written_as)
    signs = sum(not c.isalpha() for c in written_as)
    cost = 0.0
    if upper:
        usual = upper == len(written_as) or (upper == 1 and (written_as[0].isupper() or written_as[-1].isupper()))
        cost += math.log10(2 if usual else sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) + 1)
    return cost + signs * math.log10(2) if signs < len(word) else math.inf


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    for i in range(len(value)):
        if found := _YEAR.match(value, i):
            yield i, found.end(), math.log10(150)
        if not value[i].isdigit():
            continue
        for pattern in _DATE:
            for end in range(i + 4, min(len(value), i + 10) + 1):
                if (found := pattern.fullmatch(value, i, end)) and any(0 < int(found[a]) <= 12 and 0 < int(found[b]) <= 31 for a, b in (("m", "d"), ("d", "m"))):
                    yield i, end, math.log10(365 * 100) + (math.log10(4) if found["s"] else 0)


def _walks(value: str) -> Iterator[tuple[int, int, float]]:
    keys = value.lower().translate(_SHIFTED) if len(value.lower()) == len(value) else value.translate(_SHIFTED)
    i = 0
    while i + 1 < len(keys):
        turns, way, j, upper = 0, -1, i, value[i].isupper()
        while j + 1 < len(keys) and (step := _NEAR.get(keys[j], {}).get(keys[j + 1])) is not None:
            turns, way, j = turns + (step != way), step, j + 1
            upper |= value[j].isupper()
            if j - i >= 2:
                yield i, j + 1, math.log10(47) + turns * math.log10(5) + math.log10(j - i + 1) + math.log10(2) * upper
        i = max(j, i + 1)


def guess_cost(value: str, words: dict[str, float], guessing: Guessing = Guessing()) -> float:
    """Power of ten of the guesses that the value takes; ``words`` gives what each word costs."""
    size = len(value)
    brute = math.log10(max(2, alphabet(value)))
    spans: dict[tuple[int, int], float] = {}

    def offer(i: int, j: int, cost: float) -> None:
        if cost < spans.get((i, j), math.inf):
            spans[i, j] = cost

    as_letters = plain(value)
    for i in range(size) if words else ():
        for j in range(i + guessing.shortest, min(size, i + guessing.longest) + 1):
            cost = words.get(as_letters[i:j])
            if cost is not None:
                offer(i, j, cost + _spelling(value[i:j], as_letters[i:j]))
    for found in (_dates(value), _walks(value)):
        for i, j, cost in found:
            offer(i, j, cost)
    for unit in range(1, min(guessing.unit, size // 2) + 1):
        i = 0
        while i + unit < size:
            j = i
            while j + unit < size and value[j] == value[j + unit]:
                j += 1
            for k in range(i, min(i + unit, j + 1 - unit)):  # value[i : j + unit] has this period; a repeat begins in its first unit
                times = (j + unit - k) // unit
                once = min(unit * brute, spans.get((k, k + unit), math.inf))
                offer(k, k + unit * times, once + math.log10(times))
            i = max(j, i) + 1
    begin: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    for (i, j), cost in spans.items():
        begin[i].append((j, cost + _PATTERNS))
    best = [math.inf] * (size + 1)
    best[0] = 0.0
    for i in range(size):
        best[i + 1] = min(best[i + 1], best[i] + brute)
        for j, cost in begin[i]:
            best[j] = min(best[j], best[i] + cost)
    return best[size]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The spans of the three patterns: start, end and kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def values(text: str) -> list[tuple[int, int]]:
    """Where values stand in a credential's place."""
    found = set()
    for context in CONTEXTS:
        for m in context.finditer(text):
            start, end = m.span("value")
            if text[start] in "\"'`" and end - start > 1:
                start, end = start + 1, end - 1
            else:
                while end > start and text[end - 1] in ".,;:)]}>'\"`":
                    end -= 1
            if end - start >= _LEAST_LENGTH and not REFERENCE.fullmatch(text, start, end) and not re.search(r"\s", text[start:end]):
                found.add((start, end))
    return sorted(found)


_SPAN = "array<struct<start: int, end: int, kind: string>>"
_VALUE = "array<struct<start: int, end: int, value: string>>"


def _scanned(df: DataFrame) -> DataFrame:
    """``doc_id, base, found`` of every row: base spans, and values in a credential's place."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    value = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def look(text: str) -> tuple[list[dict], list[dict]]:
        base = [{"start": a, "end": b, "kind": kind} for a, b, kind in base_spans(text)]
        return base, [{"start": i, "end": j, "value": text[i:j]} for i, j in values(text)]

    def scan(batches):
        for batch in batches:
            texts = batch.column("text")
            hints = pc.fill_null(pc.match_substring_regex(texts, HINT), False)
            looks = [look(t.as_py()) if hint else ([], []) for t, hint in zip(texts, hints.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([b for b, _ in looks], pa.list_(span)), pa.array([f for _, f in looks], pa.list_(value))], ["doc_id", "base", "found"]
            )

    return own_columns(df, "doc_id", "text").mapInArrow(scan, f"doc_id bigint, base {_SPAN}, found {_VALUE}")


def _word_costs(df: DataFrame, found: DataFrame, wanted: DataFrame, guessing: Guessing) -> DataFrame:
    """``word, cost`` of the wanted words that occur in the documents outside of values."""
    letters = lambda c: F.explode(F.split(F.lower(c), r"[^\p{L}]+")).alias("word")
    said = df.select(letters(F.col("text"))).groupBy("word").agg(F.count("*").alias("n"))
    own = found.select(letters(F.col("value"))).groupBy("word").agg((-F.count("*")).alias("n"))
    counts = said.unionByName(own).filter("word != ''").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.filter("n > 0"), "word-counts")
    total = (counts.agg(F.sum("n")).first()[0] or 0) + guessing.prior
    cost = F.least(F.log10(F.lit(float(total)) / F.col("n")), F.lit(guessing.rarest))
    return counts.join(wanted.hint("merge"), "word", "left_semi").select("word", cost.alias("cost"))


def _judged(distinct: DataFrame, costs: DataFrame, guessing: Guessing) -> DataFrame:
    """The distinct values that cost enough."""

    def cost(batches):
        for batch in batches:
            kept = [
                value
                for value, words in zip(batch.column("value").to_pylist(), batch.column("words").to_pylist())
                if guess_cost(value, {w["word"]: w["cost"] for w in words or ()}, guessing) >= guessing.least
            ]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["value"])

    parts = _stretched(distinct, guessing)
    known = parts.hint("merge").join(costs, "word").groupBy("value").agg(F.collect_list(F.struct("word", "cost")).alias("words"))
    return distinct.join(known.hint("merge"), "value", "left").mapInArrow(cost, "value string")


def _stretched(distinct: DataFrame, guessing: Guessing) -> DataFrame:
    def cut(batches):
        for batch in batches:
            for value in batch.column("value").to_pylist():
                parts = pa.array(sorted(stretches(value, guessing)), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([value] * len(parts), pa.string()), parts], ["value", "word"])

    return distinct.mapInArrow(cut, "value string, word string")


def secrets(df: DataFrame, guessing: Guessing = Guessing()) -> DataFrame:
    """``doc_id, spans`` of every row: all spans by start, then kind; start and end in code points, the end exclusive."""
    rows = written(_scanned(df).withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    found = rows.filter(F.size("found") > 0).select("row", F.inline("found"))
    distinct = written(found.select("value").distinct(), "secret-values")
    wanted = _stretched(distinct, guessing).select("word").distinct()
    costs = _word_costs(own_columns(df, "text"), found, wanted, guessing)
    hard = written(_judged(distinct, costs, guessing).withColumn("hard", F.lit(True)), "secret-hard")
    guessed = repeated_join(found, hard.hint("merge"), "value", "row").groupBy("row").agg(F.collect_list(F.struct("start", "end", F.lit("guess").alias("kind"))).alias("more"))
    place = F.create_map(*[x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))])
    spans = F.transform(
        F.array_sort(F.transform(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))), lambda s: F.struct(s.start.alias("start"), place[s.kind].alias("place"), s.end.alias("end"), s.kind.alias("kind")))),
        lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")),
    )
    asked = rows.filter(F.size("found") > 0).join(guessed.hint("merge"), "row", "left")
    others = rows.filter(F.size("found") == 0).withColumn("more", F.lit(None).cast(_SPAN))
    return asked.unionByName(others).select("doc_id", spans.alias("spans"))


def spelled(spans: Column) -> Column:
    """Spans as text, ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
