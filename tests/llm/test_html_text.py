import html
import re

import pytest

from gaugeflow.llm import html_text, queries

PAGE = """<html><head><title>T</title></head><body><header class="site-header"><h1>Site</h1><p>Welcome to our site and more</p></header>
<div class="cookie-notice"><p>We use cookies to do stuff and other long things</p><button>OK</button></div>
<div id="content"><h2>Real title</h2><p>First paragraph with <a href=x>a link</a> and words&nbsp;words <b>bold</b>ly.</p><div class="ad-slot"><p>Buy now this thing</p></div>
<p>Second paragraph &amp; more &lt;b&gt; &#233;t&eacute;.<br>Long enough text to count as words and so on.</p><script>var x = "<p>no</p>";</script><ul><li>point one</li><li>point two</li></ul></div>
<aside class="sidebar"><h3>Popular</h3><ul><li><a href=1>Link one</a></li></ul></aside>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I really liked this article, thanks for all the words you wrote.</p></div></section>
<form><label>Your name please</label><textarea>abc</textarea></form><footer><p>Copyright and long footer text here with words</p></footer></body></html>"""


def test_page_without_a_main_element(spark):
    weights = html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    want = "Real title\n\nFirst paragraph with a link and words words boldly.\n\nSecond paragraph & more <b> été. Long enough text to count as words and so on.\n\npoint one\n\npoint two"
    assert html_text.main_text(PAGE, weights) == want
    assert html_text.main_text(PAGE, html_text.Weights()) == want


def test_given_pages(spark):
    """Against the text between the article tags of these pages."""
    folder = "/root/testdata/sf0.001"
    told = {r.page_id: r for r in queries.QUERIES["op3_html_text"](spark, folder).collect()}
    for page in spark.read.parquet(f"{folder}/pages.parquet").collect():
        article = page.html[page.html.index("<article>") : page.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n\n".join(b for b in blocks if b)
        assert told[page.page_id].text == want and told[page.page_id].n_chars == len(want) and told[page.page_id].url == page.url


ARTICLE = "<h1>Real title</h1><p>" + "First paragraph with plain words. " * 8 + '</p><div class="ad-slot"><p>Buy now</p></div><p>' + "Second paragraph and more words. " * 8 + "</p>"
MENU = '<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav>'
END = '<section id="comments"><p>I liked this.</p></section><footer><p>Footer text here</p></footer>'
WRAPPERS = [
    "<div class='content no-sidebar'>", "<div class='has-sidebar'>", "<div class='ad-free'>", "<div class='header-fixed'>", "<div id='page-with-widgets'>",
    "<form id='aspnetForm' method='post'>", "<div class='layout-sidebar-right'>", "<div id='header-and-content'>", "<div role='dialog'>", "<div class='share'>",
]


@pytest.mark.parametrize("start", WRAPPERS)
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>", "<main><div class='no-sidebar'><article>{}</article></div></main>", "<article><div class='widget-area'>{}</div></article>"])
def test_wrapper_with_the_name_of_another_part(spark, start, inner):
    weights = html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    end = f"</{start[1:].split()[0]}>"
    want = "\n\n".join(["Real title", ("First paragraph with plain words. " * 8).strip(), ("Second paragraph and more words. " * 8).strip()])
    for page in (f"<html><body>{start}{MENU}{inner.format(ARTICLE)}{END}{end}</body></html>", f"<html><body>{MENU}{start}{inner.format(ARTICLE)}{end}{END}</body></html>"):
        assert html_text.main_text(page, weights) == html_text.main_text(page, html_text.Weights()) == want


def test_small_article_in_a_wrapper_beside_much_other_text():
    page = f"<body><div class='has-sidebar'><div class='share'><article><p>Short but whole text.</p></article></div></div><footer>{'words of the footer ' * 50}</footer></body>"
    assert "Short but whole text." in html_text.main_text(page, html_text.Weights())


def test_comments_as_articles_in_an_article_stay_apart():
    page = f"<article>{ARTICLE}<section class='comments'><article><p>I liked it all.</p></article></section></article>"
    assert "liked" not in html_text.main_text(page, html_text.Weights()) and "Second" in html_text.main_text(page, html_text.Weights())


def test_best_region_is_the_greatest_sum():
    scores = [3, -5, 2, -1, 4, -9, 5, -1, 1, 0, -2]
    sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
    a, b = html_text.best_region(scores)
    assert sums[a, b] == max(sums.values())
    assert html_text.best_region([]) == html_text.best_region([-1, 0]) == (0, 0)


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<!--", "<script>alert(1)", "<div class='x", "</p></div>", "&#x110000;", "<p>" * 3000, "a<b>c</i>d", "<p>x</p>" * 2000, "\x00�"])
def test_broken_markup(page):
    assert isinstance(html_text.main_text(page, html_text.Weights()), str)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain words only", "x"), (3, "u", "plain words only", "x"), (None, "v", "<p>a &amp; b</p>", "x"), (4, "w", "<p>" + "long " * 50_000 + "</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    told = [(r.page_id, r.text) for r in html_text.extract(pages, html_text.fit(pages)).collect()]
    assert sorted(told, key=str) == sorted([(1, ""), (2, ""), (3, "plain words only"), (3, "plain words only"), (None, "a & b"), (4, ("long " * 50_000).strip())], key=str)
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


LONG = "Many more words than the article has. " * 60
KEPT = "\n\n".join(["Real title", ("First paragraph with plain words. " * 8).strip(), ("Second paragraph and more words. " * 8).strip()])


@pytest.mark.parametrize("part", ["<nav>{}</nav>", "<footer><p>{}</p></footer>", "<aside><p>{}</p></aside>", "<div class='sidebar'><p>{}</p></div>", "<section class='comments'><article><p>{}</p></article></section>", "<div id='comments'><div class='comment'><p>{}</p></div></div>", "<form><p>{}</p></form>", "<div class='related'><p>{}</p></div>"])
@pytest.mark.parametrize("page", ["<body><article>{a}{p}</article></body>", "<body><article>{a}</article>{p}</body>", "<body>{p}<main>{a}</main></body>", "<body><main><article>{a}</article>{p}</main></body>"])
def test_long_parts_stay_apart(spark, part, page):
    weights = html_text.fit(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    html_page = page.format(a=ARTICLE, p=part.format(LONG))
    assert html_text.main_text(html_page, weights) == html_text.main_text(html_page, html_text.Weights()) == KEPT


@pytest.mark.parametrize("part", ["<nav>{}</nav>", "<footer><p>{}</p></footer>", "<section class='comments'><article><p>{}</p></article></section>", "<aside><p>{}</p></aside>"])
def test_long_parts_beside_a_plain_text(part):
    assert html_text.main_text(f"<body><div>{ARTICLE}</div>{part.format(LONG)}</body>", html_text.Weights()).startswith("Real title") or "comments" in part
    assert "Many more" not in html_text.main_text(f"<body><article>{ARTICLE}</article>{part.format(LONG)}</body>", html_text.Weights())


def test_the_only_article_may_stand_among_comments():
    assert html_text.main_text(f"<div class='comments-page'><article>{ARTICLE}</article></div>", html_text.Weights()) == KEPT


@pytest.mark.parametrize("unit", ["<font>w ", "<b>w <i>x </u>", "<div>w ", "<a \"w ", "</p>w ", "<div class='share'>w "])
def test_time_is_linear_in_the_page(unit):
    import time

    seconds = []
    for n in (8_000, 64_000):
        begin = time.process_time()
        html_text.main_text(unit * n, html_text.Weights())
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 16 * seconds[0] + 0.5, seconds
