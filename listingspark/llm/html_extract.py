"""HTML extraction by tag-path ratios.

A page is read into blocks of text, each under a root-to-leaf path of tags. Parts that are not the article by their
kind go first: scripts, menus, asides and what is hidden. A form, or an element that a class name, its id or its role
calls so, goes only if it holds less than ``MINOR`` of the page's text and of its punctuation, and not all blocks of
the content paths, as a wrapper of the article does; where a page has one article or main element, what lies beside it
goes and what holds it stays. Reader comments, which may be longer than the article, go as soon as the paragraphs beside them
hold ``BESIDE`` of theirs: around an article there are menus, beside comments there is one. A class name calls an element so if it has a
word for such a part and apart from that only words for pages and boxes (``cookie-bar``, but not ``with-sidebar``). Over what is left, text
length and punctuation are added up per path and divided by the path's blocks; each path's figure is smoothed with
those of the paths next to it on the page, the two figures are fused, and paths above a threshold, a share of the
mean and deviation, are content. The smallest element that holds the content paths' blocks is the article; its
blocks, short ones such as headings included, are the text.

Defined cases: null and empty html give an empty text; a page of plain text is its own article; tags may be unclosed
and a tag that never ends swallows the rest, as in browsers; reading is linear in the page's length; equal pages get
equal texts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .texts import own_columns

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre "
    "search section table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table body html article section div td th".split())

# Elements, roles and name parts that mark what is not the article.
ASIDE_TAGS = frozenset(
    "script style template noscript iframe object embed svg canvas audio video map nav menu aside footer button select textarea input dialog title head noframes search".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar aside menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget "
    "comment comments reply replies discussion discussions disqus respond feedback pagination pager toolbar skip hidden".split()
)
# Of these, those for what readers write; words that say where a part is or what box it is; words for the article itself.
COMMENT_WORDS = frozenset("comment comments reply replies discussion discussions disqus respond feedback".split())
BOX_WORDS = frozenset(
    "site page main global top bottom left right primary secondary user users reader readers visitor visitors customer box bar area slot list section block wrap wrapper container thread threads "
    "button buttons link links item items unit zone panel region group inner outer holder title form posts articles stories content article post entry story blog".split()
)
ARTICLE_WORDS = frozenset("content article post entry story blog".split())
PAGE_WORDS = frozenset("site page global".split())
MINOR = 0.5
BESIDE = 0.05
#: A paragraph has a sign of punctuation and this many characters.
PARAGRAPH = 40
HEADINGS = frozenset({"header", "masthead", "banner"})  # within an article, its own heading
CONTENT_TAGS = frozenset({"html", "body", "article", "main"})

_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_WORD = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Element:
    tag: str
    parent: Element | None
    path: str
    aside: bool
    depth: int
    soft: Element | None = None  # the nearest element, itself or above, that only its share of the page tells from the article
    article: Element | None = None  # the outermost article or main element, itself or above
    comments: bool = False  # called reader comments


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name, rest)``: text, open, close. Each character is passed over a bounded number of times."""
    at, size = 0, len(page)
    unpaired = {'"': False, "'": False}
    stop = re.compile(r"[\"'>]")
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing or page.startswith(("!", "?"), lt + 1):
                end = page.find(">", lt)
                at = size if end < 0 else end + 1
            else:
                yield "text", "", "<"
                at = lt + 1
            continue
        spot = name.end()
        while True:
            found = stop.search(page, spot)
            if not found:
                return  # the tag never ends
            spot = found.end()
            mark = found[0]
            if mark == ">":
                break
            end = -1 if unpaired[mark] else page.find(mark, spot)
            if end < 0:
                unpaired[mark] = True
            else:
                spot = end + 1
        tag, rest = name[0].lower(), page[name.end() : spot - 1]
        at = spot
        yield ("close" if closing else "open"), tag, rest
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(page, at)
            yield "raw", tag, page[at : end.start() if end else size]
            at = end.start() if end else size


def attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _is_aside(tag: str, rest: str, parent: Element | None) -> bool:
    if tag in ASIDE_TAGS:
        return True
    if tag == "header":  # a page's, not that of an article
        above = parent
        while above and above.tag not in ("article", "main"):
            above = above.parent
        return above is None
    if not rest.strip() or tag in ("html", "body"):
        return False
    found = attributes(rest)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


def _is_soft(tag: str, rest: str, parent: Element | None) -> bool:
    """A form, or called aside by its role, a whole class or its id."""
    if tag == "form":
        return True
    if not rest.strip() or tag in ("html", "body"):
        return False
    found = attributes(rest)
    if found.get("role", "").lower() in ASIDE_ROLES:
        return True
    above = parent
    while above and above.tag not in ("article", "main"):
        above = above.parent
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    return tag not in CONTENT_TAGS and any(_says_aside(name, above is not None) for name in names)


def _says_aside(name: str, in_article: bool) -> bool:
    words = set(_WORD.findall(name))
    said = words & ASIDE_WORDS
    if not said or not words <= ASIDE_WORDS | BOX_WORDS:
        return False
    if said <= HEADINGS:  # an article's own heading, in it or named after it
        return not words & ARTICLE_WORDS and (not in_article or bool(words & PAGE_WORDS))
    return True


def _is_comments(rest: str) -> bool:
    found = attributes(rest)
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    return any(_says_aside(name, False) and COMMENT_WORDS & set(_WORD.findall(name)) for name in names)


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order, without those of elements that are aside whatever they hold."""
    root = Element("", None, "", False, 0)
    top, out, now = root, [], None

    def pop_to(target: Element) -> None:
        nonlocal top, now
        top, now = target, None

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if not top.aside:
                if now is None:
                    holder = top
                    while holder.tag in INLINE and holder.parent:
                        holder = holder.parent
                    now = Block(top if holder is root else holder)
                    out.append(now)
                now.parts.append(html.unescape(rest))
            continue
        if kind == "raw":
            continue
        if kind == "open":
            if tag == "br" or tag == "hr":
                now = None
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                _close_until(top, {"p"}, SCOPES, pop_to)
            elif tag in CLOSED_BY:
                _close_until(top, CLOSED_BY[tag], SCOPES - {"td", "th"} if tag == "tr" else SCOPES - CLOSED_BY[tag], pop_to)
            if tag not in INLINE:
                now = None
            if top.depth < 512:  # deeper elements count as their parent
                new = Element(tag, top, f"{top.path}/{tag}" if tag not in INLINE else top.path, top.aside or _is_aside(tag, rest, top), top.depth + 1, top.soft, top.article)
                if not new.article and tag in ("article", "main"):
                    new.article = new
                if not new.aside and _is_soft(tag, rest, top):
                    new.soft, new.comments = new, _is_comments(rest)
                top = new
            continue
        above = top
        while above is not root and above.tag != tag:
            above = above.parent
        if above is not root:
            if tag in INLINE and above is not top and any(x.tag not in INLINE for x in _between(top, above)):
                continue  # a stray end of an inline element does not end blocks
            after = now if tag in INLINE else None
            pop_to(above.parent)
            now = after
        elif tag == "p":
            now = None
    return out


def _between(low: Element, high: Element) -> Iterator[Element]:
    while low is not high:
        yield low
        low = low.parent


def _close_until(top: Element, tags: set, scopes: frozenset | set, pop_to) -> None:
    at, hit = top, None
    while at.parent:
        if at.tag in tags:
            hit = at
        elif at.tag in scopes:
            break
        at = at.parent
    if hit:
        pop_to(hit.parent)


def main_text(page: str | None) -> str:
    """The article's text: each block with single spaces, blocks joined by one."""
    found = [(b.element, " ".join("".join(b.parts).split())) for b in blocks(page or "")]
    found = _without_minor([(e, t) for e, t in found if t])
    if not found:
        return ""
    article = _container(found)
    return " ".join(t for e, t in found if article is None or _within(e, article))


def _without_minor(found: list[tuple[Element, str]]) -> list[tuple[Element, str]]:
    """Without the blocks of soft elements that hold a minor part of the page and not all of its content paths' blocks."""
    if not any(e.soft for e, _ in found):
        return found
    sums: dict[int, list] = {}  # by element: text, punctuation, blocks of content paths, blocks of articles, text of paragraphs
    soft: dict[int, Element] = {}
    whole = [0, 0, 0, 0, 0]
    beside = 0  # text of paragraphs outside of all soft elements

    def add(to: Element | None, part: list) -> None:
        if to:
            sums[id(to)] = [a + b for a, b in zip(sums[id(to)], part, strict=True)]

    for (e, t), content in zip(found, _content(found), strict=True):
        at = e.soft
        while at and id(at) not in soft:
            soft[id(at)], sums[id(at)] = at, [0, 0, 0, 0, 0]
            at = at.parent.soft
        marks = len(_PUNCTUATION.findall(t))
        paragraph = len(t) if marks and len(t) >= PARAGRAPH else 0
        part = [len(t), marks, int(content), int(e.article is not None), paragraph]
        beside += paragraph if e.soft is None else 0
        whole = [a + b for a, b in zip(whole, part, strict=True)]
        add(e.soft, part)
    by_depth = sorted(soft.values(), key=lambda e: e.depth)
    for e in reversed(by_depth):  # what an element holds, those around it hold, too
        add(e.parent.soft, sums[id(e)])
    one = len({id(e.article) for e, _ in found if e.article}) == 1
    gone = set()
    for e in by_depth:
        text, marks, content, named, paragraphs = sums[id(e)]
        above = e.parent.soft
        if e.comments and beside and beside >= BESIDE * paragraphs:
            minor = True
        elif one and not e.article:
            minor = not named
        else:
            minor = text < MINOR * whole[0] and marks <= MINOR * whole[1] and content < whole[2]
        if minor or (above and id(above) in gone):
            gone.add(id(e))
    return [(e, t) for e, t in found if not e.soft or id(e.soft) not in gone]


def _within(element: Element | None, holder: Element) -> bool:
    while element is not None and element.depth >= holder.depth:
        if element is holder:
            return True
        element = element.parent
    return False


def _content(found: list[tuple[Element, str]]) -> list[bool]:
    """Whether each block's path is content."""
    order: dict[str, int] = {}
    for e, _ in found:
        order.setdefault(e.path, len(order))
    length, marks, many = (np.zeros(len(order)) for _ in range(3))
    for e, t in found:
        k = order[e.path]
        length[k] += len(t)
        marks[k] += len(_PUNCTUATION.findall(t))
        many[k] += 1
    ratio = np.stack([length / many, marks / many])
    near = np.pad(ratio, ((0, 0), (1, 1)), mode="edge")
    smooth = 0.25 * near[:, :-2] + 0.5 * near[:, 1:-1] + 0.25 * near[:, 2:]
    smooth = np.maximum(ratio, smooth)  # a long path keeps its figure beside short ones
    fused = smooth[0] * (1 + smooth[1]) * np.sqrt(many)
    weight = length / length.sum()
    chosen = fused >= min(0.5 * float((fused * weight).sum()), float(fused.max()))
    return [bool(chosen[order[e.path]]) for e, _ in found]


def _container(found: list[tuple[Element, str]]) -> Element | None:
    """The smallest element that holds all blocks of the content paths."""
    holders = [e for (e, _), content in zip(found, _content(found), strict=True) if content]
    common = holders[0]
    for e in holders[1:]:
        while not _within(e, common):
            common = common.parent
    while common.parent and common.tag not in ("article", "main", "section", "div", "body", "td"):
        common = common.parent
    return common


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own_columns(pages, "page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
