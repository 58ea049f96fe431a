import time

import pytest

from listingspark.llm import html_extract as H

BODY = "<p>First paragraph, with enough words to count; it goes on for a while.</p><p>Second one, also long enough, with <em>em</em>phasis and more text.</p>"
TEXT = "First paragraph, with enough words to count; it goes on for a while. Second one, also long enough, with emphasis and more text."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><article>{BODY}</article></body></html>",
        f"<nav><a href=x>Menu entry</a></nav><div class='content'>{BODY}</div><footer>Foot, note. With words.</footer>",
        f"<header><h1>The site's name, and a slogan.</h1></header><main>{BODY}<aside>Read also: this, that.</aside></main>",
        f"<div id=sidebar><p>A sidebar, of some length, that is not text.</p></div><div>{BODY}</div>",
        f"<div class='cookie-notice'>We use cookies, as you know, all the time.</div><article>{BODY}<section class='comments'><p>Great post, thanks a lot!</p></section></article>",
        f"<article>{BODY}<form><p>Subscribe, please, to our letter.</p><input name=q></form></article><div role=complementary><p>More, more, more.</p></div>",
        f"<script>var a = '<p>no</p>';</script><style>p > a {{}}</style><!-- <p>no</p> --><article>{BODY}<noscript>Enable it, please.</noscript></article>",
        f"<article hidden><p>Hidden words, that nobody sees.</p></article><article>{BODY}</article>",
    ],
)
def test_article_without_the_rest(page):
    assert H.main_text(page) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain", "plain"), ("a &lt;b&gt; &amp;amp; &#233; &#x41;&nbsp;c", "a <b> &amp; é A c"), ("<p>one<p>two", "one two"), ("<p>a <b>b</b>c<br>d</p>", "a bc d"),
        ("<ul><li>x<li>y</ul>", "x y"), ("<p>x</p> tail <a", "x tail"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ('<p title="a > b">t</p>', "t"), ("<!-- open", ""), ("<script>x", ""),
        ("<article><h1>Head</h1><p><b>One.<br><p>Two words, and three.</article><footer>f</footer>", "Head One. Two words, and three."),
    ],
)
def test_small_pages(page, text):
    assert H.main_text(page) == text


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<", '<a "', "</p>", "<p>", "<li>", "<b>", "<!--", "&", "<table><tr><td>"])
def test_hostile_pages_stay_linear(unit):
    times = []
    for size in (100_000, 400_000):
        start = time.perf_counter()
        H.main_text(unit * (size // len(unit)) + "x")
        times.append(time.perf_counter() - start)
    assert times[1] < 12 * times[0] + 0.5


def test_table(spark):
    page = f"<nav>Menu</nav><article>{BODY}</article>"
    rows = [(1, "u", page), (2, None, None), (1, "u", page), (None, "v", ""), (3, "w", f"<article>{BODY * 2000}</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS text", "'x' AS n_chars")
    got = H.extracted(pages).orderBy("page_id", "text").collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(None, "v", 0), (1, "u", len(TEXT)), (1, "u", len(TEXT)), (2, None, 0), (3, "w", 2000 * (len(TEXT) + 1) - 1)]
    assert H.extracted(pages.limit(0)).collect() == []


@pytest.mark.parametrize("attribute", ["class='content with-sidebar'", "class=no-comments", "class=hidden-print", "id=social-studies", "class='comments'", "role=form", "class='modal share'"])
def test_a_wrapper_of_the_article_stays(attribute):
    assert H.main_text(f"<div {attribute}>{BODY}</div>") == TEXT
    assert H.main_text(f"<ul><li>One</li><li>Two</li></ul><div {attribute}><div class='ad'>Buy, now.</div>{BODY}</div><div class='related'><p>Read on, here.</p></div>") == TEXT


def test_a_page_within_a_form():
    assert H.main_text(f"<body><form action=x><input name=q><nav>Menu</nav><div>{BODY}</div><div class=ad>Buy this, now.</div><button>Go</button></form></body>") == TEXT


@pytest.mark.parametrize("name", ["with-sidebar", "no-comments", "hidden-print", "social-studies"])
def test_parts_of_a_class_do_not_name_an_aside(name):
    assert H.main_text(f"<article>{BODY}<p class='{name}'>Third, and last.</p></article>") == TEXT + " Third, and last."


def test_nested_wrappers_stay_linear():
    times = []
    for size in (2_000, 8_000):
        start = time.perf_counter()
        H.main_text("<div class=modal>" * 200 + "<p class=ad>x, y.</p><p>z</p>" * size)
        times.append(time.perf_counter() - start)
    assert times[1] < 12 * times[0] + 0.5


def test_a_long_aside_beside_a_short_article_goes():
    ad = "<div class='ad'>Buy this, now, today. And that, too, tomorrow.</div>"
    assert H.main_text(f"{ad}<article><h1>Short one.</h1><p><b>Short one.<br></article>") == "Short one. Short one."
    assert H.main_text(f"<div class=modal>{ad}<main><p>Short one.</main></div>{ad}") == "Short one."


PARTS = (
    "comment-list user-comments post-comments comments-area discussion-thread feedback cookie-bar ad-slot site-nav main-menu site-footer page-header advertisement-box newsletter-box related-posts share-buttons"
).split()
OTHER = "<p>Other words that are not of it, in a sentence of some length; nobody asked for them.</p>"


@pytest.mark.parametrize("name", PARTS)
@pytest.mark.parametrize("tag", ["div", "section", "ul"])
def test_named_parts_go_in_the_article_and_beside_it(name, tag):
    part = f"<{tag} class='{name}'>{OTHER}</{tag}>"
    for page in (f"<article>{BODY}{part}</article>", f"<article>{part}{BODY}</article>", f"<article>{BODY}</article>{part}", f"<div class=content>{BODY}{part}</div>", f"<div id=page>{part}<div>{BODY}</div></div>",
                 f"<main><div>{BODY}</div><{tag} id={name}>{OTHER}</{tag}></main>"):
        assert H.main_text(page) == TEXT, page


@pytest.mark.parametrize("name", PARTS[:6])
def test_comments_ten_times_the_article_go(name):
    comments = f"<div class='{name}'>" + f"<div class=body>{OTHER}</div>" * 20 + "</div>"
    for page in (f"<article>{BODY}</article>{comments}", f"<article>{BODY}{comments}</article>", f"<div>{BODY}{comments}</div>", f"<div><div>{BODY}</div>{comments}</div>",
                 f"<div>{BODY}</div><section class='{name}'><h2>Comments</h2>" + f"<article class=comment>{OTHER}</article>" * 20 + "</section>"):
        assert H.main_text(page) == TEXT, page


@pytest.mark.parametrize("name", ["article-header", "entry-header", "post-header", "header"])
def test_the_heading_of_an_article_stays(name):
    head = f"<div class='{name}'><h1>Its heading, and more.</h1></div>"
    assert H.main_text(f"<article>{head}{BODY}</article>") == f"Its heading, and more. {TEXT}"
    if name != "header":
        assert H.main_text(f"<div class=content>{head}{BODY}</div>") == f"Its heading, and more. {TEXT}"
