"""Operator 13: the main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags in one scan, whole, with the zone of each block: inside an article or
main element, inside boilerplate (by tag, role, or a word of a class or id), or neither. Pass one decides blocks by zone,
link density, length and stop-word density; short blocks stay open. In pass two open blocks take the label of the
nearest decided neighbours. Where an article holds at least half of the page's running text, other blocks are
boilerplate, and what stands in it is text unless its links say otherwise.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import handing_back, staged

# Frequent function words of four languages.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can did do for from had has have he her his i if in into is it its more my no not of on one or our out she so than that the their them then there these they this to up was we were what when which who will with would you",
    "de": "aber als am an auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für haben hat ich ihr im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aux avec ce cette ces comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous",
    "es": "al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también un una y ya yo",
}
# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, roles and words of names that mark boilerplate. An article inside a layout part is still one; inside an aside or a comment it isn't.
LAYOUT_TAGS = frozenset("nav menu header footer form".split())
ASIDE_TAGS = frozenset("aside dialog button select noscript template svg math object canvas video audio map datalist label fieldset".split())
LAYOUT_ROLES = frozenset("navigation banner contentinfo search form menu menubar toolbar tablist alert".split())
ASIDE_ROLES = frozenset("complementary dialog alertdialog".split())
LAYOUT_WORDS = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner topbar toolbar notice notices alert cookie cookies consent gdpr skip footer pagination pager copyright".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promoted promotion promotions sidebar aside comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay widget teaser".split()
)
NO_HINT = frozenset("no not has with without is show hide enable".split())  # words that start a name which tells only of a page's layout
OWN_HEADER = frozenset("article entry post content story section title".split())

NEITHER, ARTICLE, LAYOUT, ASIDE = range(4)
BAD, OPEN, NEAR, GOOD = range(4)

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=|["'])*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_CLOSE = {name: re.compile(f"</{name}(?![A-Za-z0-9-])[^>]*>?", re.I) for name in RAW}


@dataclass(frozen=True)
class Rules:
    """Lengths in characters; densities are shares of characters (links) or words (stop words)."""

    short: int = 70
    long: int = 200
    links: float = 0.33
    article_links: float = 0.5
    stops_low: float = 0.15
    stops_high: float = 0.25
    known: float = 0.05
    stop_words: frozenset[str] = frozenset(w for words in STOP_WORDS.values() for w in words.split())


def _hint(attributes: str, in_article: bool) -> int | None:
    """The zone that an element's attributes tell of, if any."""
    found = None
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return ASIDE
        if name == "role":
            roles = set(value.lower().split())
            if roles & ASIDE_ROLES:
                return ASIDE
            found = LAYOUT if roles & LAYOUT_ROLES else ARTICLE if "main" in roles and found is None else found
        elif name == "itemprop" and "articlebody" in value.lower() and found is None:
            found = ARTICLE
        elif name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _NAME_WORD.findall(one)]
                if not words or words[0] in NO_HINT or "layout" in words:
                    continue
                if ASIDE_WORDS.intersection(words):
                    return ASIDE
                layout = LAYOUT_WORDS.intersection(words)
                if layout == {"header"} and (in_article or OWN_HEADER.intersection(words)):
                    continue
                found = LAYOUT if layout else found
    return found


_hint_of_short = functools.lru_cache(8192)(_hint)


def _zone(tag: str, attributes: str, around: int) -> int:
    if around == ASIDE or tag in ASIDE_TAGS:
        return ASIDE
    hint = None
    if attributes and not attributes.isspace() and tag not in ("html", "body"):
        hint = (_hint_of_short if len(attributes) < 500 else _hint)(attributes, around == ARTICLE)
    if hint == ASIDE:
        return ASIDE
    if tag in ("article", "main"):
        return LAYOUT if hint == LAYOUT else ARTICLE
    if hint == LAYOUT or tag in LAYOUT_TAGS and not (tag == "header" and around == ARTICLE):
        return LAYOUT
    return ARTICLE if hint == ARTICLE and around == NEITHER else around


@dataclass
class Block:
    text: str
    zone: int
    heading: int  # 1 to 6, else 0
    item: bool  # of a list
    link_chars: int


def blocks_of(page: str) -> list[Block]:
    """All blocks with text, in page order, boilerplate included. Time is linear in the page: each open element closes once."""
    out: list[Block] = []
    stack: list[tuple[str, int, int, bool, int, bool]] = [("", 0, NEITHER, False, 0, False)]  # tag, place of the innermost block, zone, in a link, heading, in an item
    n_open: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    state: list = [NEITHER, 0, False]

    def end_block() -> None:
        if pieces:
            joined = " ".join(unescape("".join(p for p, _ in pieces)).split())
            if joined:
                linked = sum(len(" ".join(unescape(p).split())) for p, link in pieces if link)
                out.append(Block(joined, state[0], state[1], state[2], min(linked, len(joined))))
            pieces.clear()

    def add(text: str) -> None:
        _, _, zone, link, heading, item = stack[-1]
        if not text:
            return
        if not pieces or not any(p.strip() for p, _ in pieces):
            state[:] = [zone, heading, item]
        elif zone >= LAYOUT > state[0]:  # boilerplate within a line of text
            return
        pieces.append((text, link))

    def pop() -> None:
        n_open[stack.pop()[0]] -= 1

    def close(tag: str) -> None:
        if n_open[tag]:
            while stack[-1][0] != tag:
                pop()
            pop()

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = _TOKEN.search(page, at) if at <= last else None
        if m is None:
            comment = page.find("<!--", at)
            add(page[at:comment] if comment >= 0 else page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else size
        elif tag == "br":
            add(" ")
        elif tag in VOID:
            if tag == "hr":
                end_block()
        elif closing:
            if tag in BLOCK:
                end_block()
            close(tag)
        else:
            if tag in BLOCK:
                end_block()
                while stack[stack[-1][1]][0] == "p" or stack[stack[-1][1]][0] in SIBLINGS.get(tag, ()):  # end tags that HTML lets out
                    close(stack[stack[-1][1]][0])
            elif tag == "a" and stack[-1][3]:
                close("a")
            _, block, zone, link, heading, item = stack[-1]
            own = _zone(tag, m[3], zone)
            if tag in BLOCK or tag == "a" or own != zone or n_open[tag]:
                heading = int(tag[1]) if tag in HEADINGS else heading if tag not in BLOCK else 0
                stack.append((tag, len(stack) if tag in BLOCK else block, own, link or tag == "a", heading, item or tag == "li"))
                n_open[tag] += 1
    end_block()
    return out


def _nearest(labels: list[int], shut: Callable[[int, int], bool]) -> Iterator[tuple[int, tuple[int, int] | None, tuple[int, int] | None]]:
    """For each open block: its place, and (distance, label) of the decided block before and after it. shut(i, j): j doesn't count for i."""
    before: list = [None] * len(labels)
    after: list = [None] * len(labels)
    for side, places, step in ((before, range(len(labels)), 1), (after, range(len(labels) - 1, -1, -1), -1)):
        seen = None
        for i in places:
            if seen is not None and not shut(i, seen):
                side[i] = (step * (i - seen), labels[seen])
            if labels[i] in (BAD, GOOD):
                seen = i
    for i, label in enumerate(labels):
        if label in (OPEN, NEAR):
            yield i, before[i], after[i]


def keeps(blocks: list[Block], rules: Rules) -> list[bool]:
    """Which blocks are main text."""
    n_words, n_stops = [], []
    for b in blocks:
        words = _WORD.findall(b.text.lower()) if b.zone == NEITHER else []
        n_words.append(len(words))
        n_stops.append(sum(w in rules.stop_words for w in words))
    running = [len(b.text) - b.link_chars for b in blocks]
    inside, outside = (sum(n for n, b in zip(running, blocks, strict=True) if b.zone == z) for z in (ARTICLE, NEITHER))
    article = inside > 0 and inside >= outside
    known = sum(n_stops) >= rules.known * sum(n_words)
    titled = any(b.heading == 1 and b.zone == ARTICLE for b in blocks)
    labels = []
    for b, words, stops in zip(blocks, n_words, n_stops, strict=True):
        size, links = len(b.text), b.link_chars / len(b.text)
        if b.zone >= LAYOUT or "©" in b.text and size < rules.long and not (article and b.zone == ARTICLE):
            labels.append(BAD)
        elif article and b.zone == ARTICLE:
            labels.append((BAD if b.item else OPEN) if links > rules.article_links else GOOD if size >= rules.short else OPEN)
        elif article:
            labels.append(OPEN if b.heading == 1 and not titled else BAD)
        elif links > rules.links:
            labels.append(BAD)
        elif size < rules.short:
            labels.append(BAD if b.link_chars else OPEN)
        elif known:
            share = stops / max(words, 1)
            labels.append((GOOD if size > rules.long else NEAR) if share >= rules.stops_high else NEAR if share >= rules.stops_low else BAD)
        else:  # a language without stop words here
            labels.append(GOOD if size > rules.long and not b.link_chars else NEAR)
    final = list(labels)
    if GOOD not in labels and not article:  # near-good blocks are the best the page has
        labels = [GOOD if x == NEAR else x for x in labels]
        final = list(labels)
    own = lambda i, j: article and blocks[i].zone == ARTICLE and blocks[j].zone != ARTICLE
    for i, before, after in _nearest(labels, own):
        sides = [x for x in (before, after) if x]
        votes = {x[1] for x in sides}
        if labels[i] == NEAR:
            final[i] = GOOD if GOOD in votes or not votes else BAD
        elif not votes or len(votes) == 1:
            final[i] = votes.pop() if votes else GOOD
        elif before[0] != after[0]:
            final[i] = min(sides)[1]
        else:
            final[i] = GOOD if blocks[i].zone == ARTICLE or blocks[i].heading and after[1] == GOOD else BAD
    return [x == GOOD for x in final]


def page_text(page: str | None, rules: Rules) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, keep in zip(blocks, keeps(blocks, rules), strict=True) if keep)


def main_text(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages of boilerplate only, have an empty text. Broken markup is read leniently: open elements end with
    what holds them, an unclosed comment or script runs to the page's end, a `<` without a `>` after it is text. Pages that repeat are read
    each for itself; null ids and urls stay. No rows give no rows. Other columns are not read. A task holds one Arrow batch and one page's blocks.
    """
    rules = rules or Rules()
    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py(), rules) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return staged(pages.select("page_id", "url", "html").mapInArrow(handing_back(run), schema), "page-text")


def page_blocks(pages: DataFrame, rules: Rules | None = None) -> DataFrame:
    """page_id, block (from 0), text, zone, link_chars, kept for every block of every page, boilerplate included; a page without blocks has no row."""
    rules = rules or Rules()
    schema = pages.select("page_id", F.lit(0).alias("block"), F.lit("").alias("text"), F.lit("").alias("zone"), F.lit(0).cast("bigint").alias("link_chars"), F.lit(True).alias("kept")).schema
    zones = ("neither", "article", "layout", "aside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, html in zip(batch.column(0), batch.column(1), strict=True):
                blocks = blocks_of(html.as_py() or "")
                rows = [(i, b.text, zones[b.zone], b.link_chars, k) for i, (b, k) in enumerate(zip(blocks, keeps(blocks, rules), strict=True))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.bool_()), strict=True)] if rows else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([page_id.as_py()] * len(rows), batch.column(0).type), *columns], ["page_id", "block", "text", "zone", "link_chars", "kept"])

    return staged(pages.select("page_id", "html").mapInArrow(handing_back(run), schema), "page-blocks")
