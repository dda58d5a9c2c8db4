"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags. Pass one decides what markup, link
density, length and stop-word density make clear; pass two lets the undecided, mostly
short, blocks inherit the label of their nearest decided neighbours. Parts that the
markup itself names as menus, footers, adverts and the like are out, and have no say
about their neighbours. A class name puts a part out if it names the part as a whole, as
``site-footer`` does and ``has-sidebar`` does not, and an article in such a part is an
article still. Stop words say nothing about a page whose language has none of them.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgauge.llm.words import small_batches

# Frequent function words.
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by can for from had has have he her his i in into is it its more no not of on one or "
    "our she so than that the their them then there these they this to was we were which who will with would you "
    # German
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat "
    "ich im in ist mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war wenn wie wir zu zum zur über "
    # French
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour "
    "qu que qui sa se ses son sont sur un une vous à été être "
    # Spanish
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no "
    "nos o para pero por que se sin sobre su sus también un una y ya".split())
# Element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
REPEATED = frozenset("li dt dd td th tr option".split())  # the next one ends an open one
OUTSIDE = frozenset("nav footer aside form menu dialog search fieldset button label".split())
ARTICLES = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr p b i em strong span a".split())
# Words of class, id and role attributes that name what is not main text.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "contentinfo cookie cookies consent disclaimer discussion disqus footer menu modal nav navbar navigation newsletter "
    "notice notification popup promo promoted promotion related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe toolbar widget".split())

# Words that follow such a name, as in ``comment-list``, and words that deny it.
PART_NAMES = frozenset(
    "area bar block body bottom box button buttons col column container content dialog form group header icons inner item "
    "items left link links list menu message modal nav outer overlay panel popup posts right row section slot title top "
    "unit wrap wrapper".split())
DENIALS = frozenset("has hide hides is no non with without".split())

SHORT_CHARS = 70
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.2, 0.3
LINK_SHARE = 0.5

_HIDDEN = "script|style|noscript|template|iframe|object|textarea|select|title|svg|math|audio|video|canvas"
_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<hidden>{_HIDDEN})\b[^>]*>.*?(?:</(?P=hidden)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-z/!?][^>]*+>""",
    re.IGNORECASE | re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_HIDDEN_ATTRIBUTE = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
_NAME_PART = re.compile(r"[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")

GOOD, BAD, OUT, OPEN = "good", "bad", "out", "open"


@dataclass
class Block:
    """Text of a block with the characters of it inside links, the article it is in
    (0: none) and whether its markup puts it outside of all articles."""

    text: str
    link_chars: int
    article: int
    outside: bool
    label: str = OPEN


@dataclass
class _Element:
    name: str
    article: int
    outside: bool  # by an element or as hidden: nothing inside is main text
    named_outside: bool  # by a name, which an article inside ends


@dataclass
class _Page:
    """Open elements and the block being filled."""

    open: list[_Element] = field(default_factory=lambda: [_Element("", 0, False, False)])
    parts: list[str] = field(default_factory=list)
    named_outside: bool = False  # the paragraph being filled
    link_depth: int = 0  # open elements where the current link began, 0 without one
    link_chars: int = 0
    articles: int = 0
    blocks: list[Block] = field(default_factory=list)

    def add(self, raw: str) -> None:
        self.parts.append(raw)
        if self.link_depth:
            self.link_chars += len(raw)

    def close_block(self) -> None:
        text = " ".join(html_lib.unescape("".join(self.parts)).split())
        if text:
            now = self.open[-1]
            self.blocks.append(Block(text, self.link_chars, now.article, now.outside or now.named_outside or self.named_outside))
        self.parts.clear()
        self.link_chars = 0
        self.named_outside = False

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        if name == "a":
            self.link_depth = len(self.open)
        if name in BLOCKS:
            self.close_block()
        if name == "p" and attributes:
            self.named_outside = _hidden(attributes) or _named_outside(attributes)
        if name in REPEATED and self.open[-1].name == name:
            self.open.pop()
        if name in VOID or attributes.endswith("/"):
            return
        now = self.open[-1]
        article = now.article
        if name in ARTICLES and not article:
            self.articles += 1
            article = self.articles
        outside = now.outside or name in OUTSIDE or (name == "header" and not article)
        named = now.named_outside and name not in ARTICLES
        if attributes and name not in ("html", "body"):
            outside = outside or _hidden(attributes)
            named = named or (name not in ARTICLES and _named_outside(attributes))
        self.open.append(_Element(name, article, outside, named))

    def end(self, name: str) -> None:
        if name == "a":
            self.link_depth = 0
        if name in BLOCKS:
            self.close_block()
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == name:
                del self.open[at:]
                break
        if len(self.open) < self.link_depth:  # a link that was never closed
            self.link_depth = 0


def _hidden(attributes: str) -> bool:
    return bool(_HIDDEN_ATTRIBUTE.search(attributes))


def _named_outside(attributes: str) -> bool:
    return any(_names_outside(_NAME_PART.findall(token)) for found in _NAMES.finditer(attributes)
               for token in (found[1] or found[2] or found[3] or "").lower().split())


def _names_outside(parts: list[str]) -> bool:
    """Whether a class name, cut at its marks, says what the whole part is: by its last
    word, or by its first if only words for parts follow."""
    if not parts or parts[0] in DENIALS:
        return False
    return parts[-1] in OUTSIDE_NAMES or (parts[0] in OUTSIDE_NAMES and all(p in PART_NAMES or p in OUTSIDE_NAMES for p in parts[1:]))


def blocks_of(page: str | None) -> list[Block]:
    """Blocks in page order, without scripts, styles and other hidden content."""
    state, at = _Page(), 0
    page = page or ""
    for found in _MARKUP.finditer(page):
        if found.start() > at:
            state.add(page[at:found.start()])
        at = found.end()
        if name := found["name"]:
            if found["end"]:
                state.end(name.lower())
            else:
                state.start(name.lower(), found["rest"])
    state.add(page[at:])
    state.close_block()
    return state.blocks


def stop_density(text: str) -> float:
    """Share of stop words among the words of a text."""
    words = _LETTERS.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def speaks(blocks: list[Block]) -> bool:
    """Whether stop words tell anything on a page: its text outside of links has some.
    Else its language has none or few of them."""
    texts = [b.text for b in blocks if not b.outside and b.link_chars <= LINK_SHARE * len(b.text)]
    return not texts or stop_density(" ".join(texts)) >= STOP_LOW


def first_pass(block: Block, by_stop_words: bool = True) -> str:
    """The label that a block's own features give it. Without stop words its length
    speaks for it and nothing against it."""
    if block.outside:
        return OUT
    if block.link_chars > LINK_SHARE * len(block.text):
        return BAD
    if len(block.text) < SHORT_CHARS:
        return OPEN
    if not by_stop_words:
        return GOOD if len(block.text) >= LONG_CHARS else OPEN
    density = stop_density(block.text)
    if density >= STOP_HIGH and len(block.text) >= LONG_CHARS:
        return GOOD
    # Within an article plain text without function words, a list for instance, is
    # left to its neighbours.
    return OPEN if density >= STOP_LOW or block.article else BAD


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided block of their article,
    or of the page outside articles; the good one if two are as near. Without any,
    text is good if the page has no article or the block is in one."""
    has_article = any(b.article for b in blocks)
    groups: dict[int, list[Block]] = {}
    for block in blocks:
        groups.setdefault(block.article, []).append(block)
    for article, group in groups.items():
        decided = [(at, b.label) for at, b in enumerate(group) if b.label in (GOOD, BAD)]
        after = 0
        for at, block in enumerate(group):
            if block.label != OPEN:
                continue
            while after < len(decided) and decided[after][0] < at:
                after += 1
            near = decided[max(0, after - 1):after + 1]
            if near:
                block.label = min(near, key=lambda d: (abs(d[0] - at), d[1] != GOOD))[1]
            else:
                block.label = GOOD if article or not has_article else BAD


def main_text(page: str | None) -> str:
    """Main text of one page: its good blocks, a line each; empty if there are none."""
    blocks = blocks_of(page)
    by_stop_words = speaks(blocks)
    for block in blocks:
        block.label = first_pass(block, by_stop_words)
    second_pass(blocks)
    if any(b.article and b.label == GOOD for b in blocks):
        blocks = [b for b in blocks if b.article]
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract_text(html: Column) -> Column:
    """Main text of whole pages; null and empty html give an empty text."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)
    return extract(html)


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id>, <url>, text, n_chars`` for every row of ``pages``.

    Null and empty html have an empty text of 0 characters. Character references are
    decoded, white space within a block becomes one space, and blocks are joined by
    one newline. Repeated rows, null ids and null urls pass through; other columns are
    not read. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    texts = pages.select(F.col(id_col), F.col(url_col), extract_text(F.col(html_col)).alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
