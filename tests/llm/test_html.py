"""Operator 13 on planted pages, on the given pages, and on broken markup."""

import html
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from quire.llm.html_text import Rules, blocks_of, keeps, main_text, page_blocks, page_text

DATA = "/root/testdata/sf0.001"
LONG = "The committee said that it had not been able to find out who was in the building when the fire began, and that the report of the engineers would be read again by all of its members before the next meeting in the spring of that year."
SHORT = "And so it was."


def text(page):
    return page_text(page, Rules())


def test_given_page_form():
    page = f'<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div><article><h1>Title</h1><p><b>One.<br><p>{LONG}</p><p>x&nbsp;&amp;\n\t y &lt;b&gt; caf&eacute; &#8364;</p></article><footer>&copy; site</footer></body></html>'
    assert text(page) == f"Title\n\nOne.\n\n{LONG}\n\nx & y <b> café €"


BOILERPLATE = {
    "menu": '<nav><ul><li><a href="/">Home</a></li><li>About us</li></ul></nav>',
    "menu by class": f'<div id="mainMenu"><p>{LONG}</p></div>',
    "header": f"<header><h1>The Daily</h1><p>{LONG}</p></header>",
    "site header by class": f'<div class="site-header"><p>{LONG}</p></div>',
    "footer": f"<footer><p>{LONG}</p></footer>",
    "sidebar": f"<aside><p>{LONG}</p></aside>",
    "sidebar by class": f'<div class="col right-sidebar"><p>{LONG}</p></div>',
    "notice": f'<div class="cookie-notice"><p>{LONG}</p></div>',
    "advert": f'<section class="adBox"><p>{LONG}</p></section>',
    "form": f"<form><p>{LONG}</p><label>Name</label><select><option>One</option></select><button>Send it</button></form>",
    "script": "<script>if (a < b) { document.write('<p>The text</p>') }</script>",
    "style": "<style>p > a { color: red }</style>",
    "comments": f'<section id="comments"><h2>3 comments</h2><article class="comment"><p>{LONG}</p></article><article><p>{LONG}</p></article></section>',
    "comments by role": f'<div role="complementary"><p>{LONG}</p></div>',
    "hidden": f"<div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div>",
    "noscript": f"<noscript><p>{LONG}</p></noscript>",
    "link list": "<ul>" + '<li><a href="x">The story of the day that was</a></li>' * 4 + "</ul>",
}


@pytest.mark.parametrize("kind", sorted(BOILERPLATE))
@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_boilerplate_goes(kind, wrap):
    """Before and after the article, with article markup and without; and inside the article where it can stand there."""
    bad = BOILERPLATE[kind]
    body = f"<h1>A title of the story</h1><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p>"
    want = f"A title of the story\n\n{LONG}\n\n{SHORT}\n\n{LONG}"
    assert text(f"<body>{bad}<{wrap}>{body}</{wrap}>{bad}</body>") == want
    if "header" not in kind and wrap == "article":
        assert text(f"<body><article>{body}{bad}</article></body>") == want


def test_short_blocks_take_their_neighbours_label():
    page = f"<body><div>{SHORT}</div><div><a href=a>Home</a></div><p>{LONG}</p><p>{SHORT}</p><p>{LONG}</p><div><a href=b>Next</a></div><div>x y</div></body>"
    assert text(page) == f"{LONG}\n\n{SHORT}\n\n{LONG}"


def test_pages_without_evidence_keep_their_text():
    assert text("<p>Only this.</p>") == "Only this."
    assert text("<body><article><h1>One.</h1><p>One.</p></article><footer>x</footer></body>") == "One.\n\nOne."


def test_other_languages():
    polish = "Komisja stwierdziła, iż brak jest dowodów, które pozwoliłyby ustalić, kto przebywał wtedy wewnątrz budynku, kiedy wybuchł pożar, dlatego raport ekspertów zostanie ponownie przeczytany przez wszystkich członków przed następnym posiedzeniem."
    assert text(f"<div><a href=a>Menu</a></div><p>{polish}</p><div><a href=b>Dalej</a></div>") == polish


def test_article_inside_layout_elements():
    body = f"<article><p>{LONG}</p></article>"
    assert text(f'<form id="all"><div class="has-sidebar">{body}</div></form>') == LONG
    assert text(f"<nav><ul><li><a href=a>Home</a>{body}") == LONG  # a menu that is never closed
    assert text(f'<body class="no-sidebar single-comment"><div class="layout-sidebar-right">{body}</div></body>') == LONG


def test_article_own_header():
    assert text(f'<article><header class="entry-header"><h1>Title</h1></header><p>{LONG}</p><footer>Tags: <a>x</a></footer></article>') == f"Title\n\n{LONG}"


def test_links_in_running_text():
    p = f'<p>See <a href="x">the report of the committee on the building</a>.</p>'
    assert text(f"<article><p>{LONG}</p>{p}<p>{LONG}</p></article>") == f"{LONG}\n\nSee the report of the committee on the building.\n\n{LONG}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        (" \n ", ""),
        ("no markup at all", "no markup at all"),
        ("a < b and c > d", "a < b and c > d"),
        ("1 <2", "1 <2"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("<p title='a > b'>one</p>", "one"),
        ('<p title="it\'s > b">one</p>', "one"),
        ("<p title=it's>it's one</p>", "it's one"),
        ("<P>one</P><!-- x -- > y --><p>two", "one\n\ntwo"),
        ("<p>one</p><!-- never closed <p>two", "one"),
        ("<p>one</p><script>never closed <p>two", "one"),
        ("<p>one</p><", "one\n\n<"),
        ("<p>&notit; &bogus; &#x41;&#0;</p>", "¬it; &bogus; A�"),
        ("</div></p></b><p>one</div></p>", "one"),
        ("<p>a<b>b</b>c<br>d<i> e</i></p>", "abc d e"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ],
)
def test_broken_markup(page, want):
    assert text(page) == want


def test_time_is_linear():
    n = 100_000
    for page in ("<a" * n, "<b>" * n + "<div></div>" * n, '<span class="ad">' * n + "</a>" * n, "<div>" * n + "</span>" * n, '<p "' * n, "<!--" * n, "<" * n, "<li>x" * n, "<script>" * n, "<a href=x>y" * n, "<a" * n + "<!--"):
        began = time.time()
        blocks = blocks_of(page)
        keeps(blocks, Rules())
        assert time.time() - began < 10


def test_a_very_long_page():
    words = " ".join([LONG] * 20_000)  # 4.6 MB
    assert text(f"<nav>x</nav><article><p>{words}</p></article>") == words


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_given_pages(spark):
    """All given pages against a reading that knows how they are built."""

    def truth(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S).group(1).replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        return "\n\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    got = main_text(pages)
    assert {r["page_id"]: r["text"] for r in got.collect()} == want
    assert got.where(F.length("text") != F.col("n_chars")).isEmpty()


def test_table(spark):
    """Nulls in any column, repeated rows, clashing names, an empty table."""
    schema = "page_id long, url string, html string, text string, n_chars string, block int"
    rows = [(1, "u", f"<p>{LONG}</p>", "t", "n", 1), (1, "u", f"<p>{LONG}</p>", "t", "n", 1), (None, None, None, None, None, None), (2, None, "<p>é😀</p>", "t", "n", 1)]
    pages = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, main_text(pages).collect()), key=repr)
    assert got == sorted([(1, "u", LONG, len(LONG)), (1, "u", LONG, len(LONG)), (None, None, "", 0), (2, None, "é😀", 2)], key=repr)
    assert main_text(spark.createDataFrame([], schema)).collect() == []
    blocks = page_blocks(spark.createDataFrame([(5, "u", f"<nav>a</nav><p>{LONG}</p>", "", "", 1), (6, "u", None, "", "", 1)], schema)).orderBy("block").collect()
    assert [(r["page_id"], r["block"], r["text"], r["zone"], r["kept"]) for r in blocks] == [(5, 0, "a", "layout", False), (5, 1, LONG, "neither", True)]
