"""Main text of pages whose text is known."""

import html
import random
import re

import pytest

from textmeter.llm import main_text as m
from textmeter.llm import queries

WORDS = "the stone river of quiet morning was under a bridge and nobody there said why it went on so long".split()


def prose(rng, least, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))).capitalize() + "."


BEFORE = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav>',
    "<header><p>Daily paper, founded long ago in a small town by the sea</p></header>",
    '<div class="cookie-notice">We use cookies to make this site work better for you. <button>Accept all</button></div>',
    '<div id="menuMain"><a href="/x">One</a> <a href="/y">Two</a></div>', "<!-- ad --><div class='ad'>Buy the finest shoes in all the world today, cheap.</div>",
    '<form action="/s"><label>Search</label><input name="q"><select><option>All</option></select></form>',
    '<div role="banner">A banner of the site</div>', '<noscript>Please switch on scripts to read this page as it was meant.</noscript>',
]
AFTER = [
    "<aside><h3>Related</h3><p>Another text that has nothing to do with this one at all.</p></aside>",
    '<div class="comments"><h3>Comments</h3><article><p>I read this twice and still do not agree with a word of it.</p></article></div>',
    '<section id="respond"><form><textarea>Say something</textarea></form></section>',
    "<footer>&copy; 2020 The paper. All rights reserved by the paper and its owners.</footer>",
    '<div class="sidebar"><p>Most read of all the things that we have written this week.</p></div>',
    '<script>document.write("<p>not a text</p>")</script>', "<style>p{margin:0}</style>",
]
INNER = [
    '<div class="ad">An advert in the middle of the text that nobody asked for.</div>', "<script>track('</p>')</script>",
    '<div class="newsletter-signup"><p>Write your address here and get a letter each week.</p></div>', "<!-- <p>hidden</p> -->",
    '<ul class="share"><li><a href="#">Share</a></li></ul>', '<figure><img src="x.png" alt="not text"></figure>',
]


def page(rng, marked):
    blocks = [prose(rng, 3, 9), *(prose(rng, *rng.choice([(1, 4), (30, 90)])) for _ in range(rng.randint(1, 9))), prose(rng, 30, 60)]
    body = [f"<h1>{html.escape(blocks[0])}</h1>"]
    for text in blocks[1:]:
        spaced = text.replace(" ", rng.choice([" ", "\n", " \t "]), 2)
        one = f"<p>{spaced}" + rng.choice(["</p>", "</p>", ""])
        if rng.random() < 0.3:
            one = one.replace(" ", " <b>", 1).replace(".", "</b>.", 1)
        body.append(one)
        if rng.random() < 0.3:
            body.append(rng.choice(INNER))
    held = "".join(body)
    inner = f"<{marked}>{held}</{marked.split()[0]}>" if marked else held
    before, after = rng.sample(BEFORE, rng.randint(0, 4)), rng.sample(AFTER, rng.randint(0, 4))
    return f"<!DOCTYPE html><html><head><title>{blocks[0]} | Site</title></head><body>{''.join(before)}{inner}{''.join(after)}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("marked", ["article", "main", 'div role="main"', 'div class="article-body"', 'section class="content"'])
def test_known_pages(marked):
    rng = random.Random(len(marked))
    for _ in range(300):
        source, text = page(rng, marked)
        assert m.main_text(source) == text, source


def test_pages_of_the_tables(spark):
    # Its pages have one article each: all its blocks, and nothing else.
    folder = "/root/testdata/sf0.01"
    given = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.QUERIES["op11_line_blocks"](spark, folder).collect()
    assert len(rows) == len(given)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", given[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
        # Without the element that marks it, the lines alone find the same text.
        assert m.main_text(re.sub("</?article>", "", given[r.page_id])) == r.text


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("<", "<"), ("<p>", ""), ("only words", "only words"), ("<!-- never closed <p>a</p>", ""), ("<script>a</p>", ""),
    ("<p>a &lt;b&gt; &amp;amp; &#233;&nbsp;&eacute;", "a <b> &amp; é é"), ("<div class=ad>one<p>two three four five six", "two three four five six"),
    ('<p title="a > b">kept</p>', "kept"), ("<p>a<br>b</p><p> \n </p><p>c</p>", "a b\nc"), ("<nav>menu</nav>", ""),
    ("<article><header><h1>Head</h1></header><p>Text of it.</p><footer>by nobody</footer></article>", "Head\nText of it."),
    ("<table><tr><td>a<td>b</table>", "a\nb"), ("</p></div></b>text", "text"), ("<P CLASS='Cookie'>no</P><P>yes", "yes"),
    ('<p hidden>no</p><p data-hidden="x">yes</p>', "yes"), ("<article></article><p>outside of it, a text", "outside of it, a text"),
])
def test_hard_pages(source, text):
    assert m.main_text(source) == text


def test_windows():
    assert m.segments([]) == [] and m.segments([0, 0]) == []
    assert m.segments([5, 0, 0, 0, 90, 0, 0, 100, 0, 0, 0, 0, 3]) == [(4, 8)]
    assert m.segments([100, 0, 0, 0, 0, 100]) == [(0, 1), (5, 6)]


def test_long_and_broken_pages_take_time_in_proportion():
    for part in ("<p>word ", "<div class='ad'>x", "<a href=\"", "&amp;", "<", "</div>", "<!--", "<article>", "<script>"):
        m.main_text(part * 30000)


def test_hard_rows(table):
    pages = table([(1, None, "x"), (1, None, "x"), (None, "<p>a</p>", None), (2, "", "y")], "page_id long, html string, text string")
    got = m.extract(pages)
    assert got.columns == ["page_id", "text"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, ""), (1, ""), (None, "a"), (2, "")], key=repr)
    assert m.extract(pages.limit(0)).collect() == []
