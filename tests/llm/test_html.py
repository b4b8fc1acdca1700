import time

import pytest

from folioflux.llm import html

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b>\n\n text<br>next<p>Second &lt;x&gt;.</p><p>No.</p>"
TEXT = "Title & more First bold text next Second <x>. No."
FURNITURE = [
    "<nav><ul><li><a href=/x>Home</a></li></ul></nav>", "<header><p>Site name here</p></header>", "<div class='ad banner'>Buy now, a long advert text it is</div>",
    "<aside><p>Related things to read, many of them</p></aside>", '<div id="comments"><p>I agree with all of this, great article</p></div>', "<footer>&copy; us</footer>",
    "<form><label>Mail</label><input></form>", "<script>var t='</p><p>no';</script>", "<style>p{}</style>", "<!-- <p>hidden</p> -->", "<div class=cookie-notice><p>We use cookies on this site</p></div>",
    "<div class='siteFooter'><p>All about us, and where to find us</p></div>", "<p hidden>Not to be seen by anyone at all</p>", "<section style='display: none'><p>Nor this</p></section>",
]


@pytest.mark.parametrize("place", ["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>", "<td>{}"])
@pytest.mark.parametrize("furniture", FURNITURE)
def test_only_the_article_stays(place, furniture):
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{furniture}{place.format(ARTICLE)}{furniture}</body></html>"
    assert html.extract(page)[0] == TEXT


def test_odd_pages():
    assert html.extract(None) == ("", []) and html.extract("")[0] == "" and html.extract("<p> </p>")[0] == ""
    assert html.extract("just text &amp; more")[0] == "just text & more"
    assert html.extract("<nav><a>x</a><article><p>a < b</p><div class=ad>buy</div><p>y")[0] == "a < b y"
    assert html.extract("<a href=x>only a link</a>")[0] == "only a link"
    page = "<main><article class='post has-sidebar'><header><h1>Head</h1></header><p>Body text.</p></article><article class='comment'><p>I agree</p></article></main>"
    assert html.extract(page)[0] == "Head Body text."
    assert html.extract("<div class='with-sidebar'><p>Body text here</p></div>")[0] == "Body text here"
    assert html.extract("<p>a&nbsp; b</p>")[0] == "a b"


@pytest.mark.parametrize("page", ["<div class=x>" * 100_000 + "end", "<p>" * 100_000 + "a <" * 100_000, '<a "' * 100_000, "<x>" * 50_000 + "</y>" * 50_000, "<!--" * 100_000])
def test_time_is_linear(page):
    began = time.time()
    html.extract(page)
    assert time.time() - began < 5


def test_rows(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<p>" + "long text " * 100_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.main_text(pages).collect()
    assert len(got) == 5 and sorted(len(r["text"]) for r in got) == [0, 0, 1, 1, 999_999]
    assert html.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["<section id='discussion'><p>{}</p></section>", "<h2 id='related-work'>{}</h2>", "<h2 id='search-results'>{}</h2>", "<section id=privacy>{}</section>", "<p class='notice'>{}</p>", "<p class=related-work>{}</p>"])
def test_names_in_an_article_count_as_a_whole(part):
    page = f"<article><p>Before it.</p>{part.format('A part of the text.')}<div class='share-buttons'>Tell all</div><p>After it.</p></article>"
    assert html.extract(page)[0] == "Before it. A part of the text. After it."


@pytest.mark.parametrize("wrapper", ["class='page-with-sidebar'", "id='content' class='col right-sidebar'", "class=search-page"])
def test_a_wrapper_with_the_text_is_no_furniture(wrapper):
    page = f"<body><nav><a href=/>Home</a></nav><div {wrapper}><p>The complete text of the page.</p><div class=sidebar>Read on</div></div></body>"
    assert html.extract(page)[0] == "The complete text of the page."


def test_short_runs_of_the_text_stay():
    long = "A long text. " * 150
    ad = "<div class=ad>Buy</div>"
    page = f"<div id=top><p>Low run</p></div>{ad}<div id=content><h1>Title</h1>{ad}<p>{long}</p>{ad}<p>Short closing paragraph.</p></div>{ad}<div id=end><p>Far</p></div>"
    assert html.extract(page)[0] == f"Title {long.strip()} Short closing paragraph."


def test_lines_of_links_in_an_article_stay():
    items = "".join(f"<li><a href=/{k}>Item {k}</a></li>" for k in range(5))
    page = f"<main><ul>{items}</ul><p>Text.</p><ul>{items}</ul><p><a href=/z>Last</a></p></main>"
    five = " ".join(f"Item {k}" for k in range(5))
    assert html.extract(page)[0] == f"{five} Text. {five} Last"


@pytest.mark.parametrize("head", ["<head><title>T</title><script>var t='<p>';</script>", "<head><title>T</title><meta charset=utf-8></head>", "<HEAD><link href=x><title>T</title>\n", ""])
@pytest.mark.parametrize("start", ["<body><article><p>", "<article><header>Head</header><p>", "<p>"])
def test_a_head_may_lack_its_end(head, start):
    text = "Head text" if "Head" in start else "text"
    assert html.extract(f"<!doctype html><html>{head}{start}text")[0] == text
    assert html.extract(f"<html><head><style>x</styles></style>{start}text")[0] == text


LONG = "A long paragraph of the article, which goes on for a while and says a good deal. " * 6
PROBE = "<div>Home</div><div>Contact</div><div>About us</div>{}<div>Copyright 2020 Foo</div><div>All rights reserved</div>"


def test_the_distribution_alone_finds_the_text():
    """No element or name tells the article from the rest."""
    two = f"<p>{LONG}</p><p>{LONG}</p>"
    assert html.extract(PROBE.format(two))[0] == " ".join([LONG.strip()] * 2)
    assert html.extract(PROBE.format(f"<div>{LONG}</div><div>{LONG}</div>"))[0] == " ".join([LONG.strip()] * 2)
    assert html.extract(PROBE.format(f"<div><h1>Title</h1>{two}<p>End.</p></div>"))[0] == f"Title {LONG.strip()} {LONG.strip()} End."
    links = "".join(f"<li><a href=/{k}>Some story number {k}</a></li>" for k in range(40))
    assert html.extract(f"<ul>{links}</ul>{two}<ul>{links}</ul><div>{LONG}</div>")[0] == " ".join([LONG.strip()] * 3)
    assert html.extract(f"<div><p>{LONG}</p></div><div>A box</div><div><div>In it</div><div>Out of it</div></div>")[0] == LONG.strip()


def test_an_article_without_a_surge_is_not_the_text():
    teaser = "<article><p>Read this</p></article>"
    assert html.extract(f"<div><p>{LONG}</p><p>{LONG}</p></div>{teaser}{teaser}")[0] == " ".join([LONG.strip()] * 2)
    assert html.extract(f"<main><article><p>{LONG}</p><p>So.</p></article>{teaser}</main>")[0] == f"{LONG.strip()} So."


@pytest.mark.parametrize("part", ["<ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li><li><a href=/d>Four</a></li></ul>", "<p><a href=/x>The whole closing paragraph</a></p>", "<p class='share-price'>The price rose</p>", "<p class='notice-of-intent'>It was served</p>", "<table><tr><td>7</td><td>8</td></tr></table>"])
def test_everything_in_an_article_stays(part):
    import re

    words = " ".join(re.sub(r"<[^>]*>", " ", part).split())
    assert html.extract(f"<article><p>{LONG}</p>{part}</article>")[0] == f"{LONG.strip()} {words}"
    assert html.extract(f"<article><p>Intro</p>{part}</article>")[0] == f"Intro {words}"


def test_sections_named_after_their_subject_stay():
    page = f"<p>{LONG}</p><section class='social-history-of-france'><h2>History</h2><p>{LONG}</p></section><p>{LONG}</p>"
    assert html.extract(page)[0] == f"{LONG.strip()} History {LONG.strip()} {LONG.strip()}"


def test_comments_go_however_long():
    page = f"<article><p>{LONG}</p></article><div id=comments><p>{LONG * 5}</p></div>"
    assert html.extract(page)[0] == LONG.strip()
    assert html.extract(page.replace("<article>", "<div>").replace("</article>", "</div>"))[0] == LONG.strip()


def brute_between(weights, window=3, share=0.2):
    """Every window is summed on its own; a line is between if high windows lie on both sides of it without a low one between them."""
    n = len(weights)
    total = lambda a, b: sum(weights[max(0, a) : min(n, b)])
    least = max(1, share * max((total(i, i + window) for i in range(n)), default=0))
    kept = set()
    for a in range(n):
        for b in range(a, n):
            high = all(total(i, i + window) >= least for i in range(a, b + 1))
            first_of_run = a == 0 or total(a - 1, a - 1 + window) < least
            last_of_run = b == n - 1 or total(b + 1, b + 1 + window) < least
            if high and first_of_run and last_of_run:
                starts = max(j for j in range(a, min(n, a + window)) if total(j, a + window) >= least)
                ends = min(k for k in range(b, n) if total(b, k + 1) >= least)
                kept |= set(range(min(starts, ends), max(starts, ends) + 1))
    return [i in kept for i in range(n)]


def test_windows_against_brute_force():
    import random

    rng = random.Random(9)
    for _ in range(400):
        weights = [rng.choice([0, 0, 1, 3, 10, 30, 100, 400]) for _ in range(rng.randrange(0, 25))]
        assert html.between(weights) == brute_between(weights)


def test_words_of_pages_without_their_marks(spark):
    """Precision and recall of words on the test pages, once as they are and once with every mark of the article taken out."""
    import re
    from collections import Counter
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for marked, least in ((True, 1.0), (False, 0.97)):
        both = got_n = want_n = 0
        for r in rows:
            body = re.search(r"<(article|main)\b[^>]*>(.*?)</\1>", r["html"], re.S)
            want = Counter(unescape(re.sub(r"<[^>]*>", " ", body[2])).split())
            page = r["html"] if marked else re.sub(r"</?(article|main|nav|header|footer|aside)\b[^>]*>|(?<=<div) class=[^>]*", lambda m: "" if m[0].startswith(" ") else m[0].replace(m[1], "div"), r["html"])
            got = Counter(html.extract(page)[0].split())
            both, got_n, want_n = both + (got & want).total(), got_n + got.total(), want_n + want.total()
        print(f"marked {marked}: precision {both / got_n:.4f}, recall {both / want_n:.4f}")
        assert both / got_n >= least and both / want_n >= least


def test_an_advert_longer_than_the_article_goes():
    page = "<div class=ad>A long advert for things that nobody needs at all.</div><article><h1>Short.</h1><p>Text.</p></article>"
    assert html.extract(page)[0] == "Short. Text."
