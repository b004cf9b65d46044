"""Main text of web pages by tree scoring.

A page becomes a tree in one pass over its tags; nothing recurses, so depth is no limit,
and every pass is linear in the page. Text falls into blocks, which block tags delimit.
Each block of prose passes points for its length and commas to the elements around its
paragraph, less to those further out; an element's points are discounted by its link
density. The best element, and those of its siblings that hold prose too, are kept, and
all their blocks in page order, whatever their length. Elements that are no part of an
article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles,
comments of readers, hidden ones) are set aside before, by tag, role, class or id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

#: HTML elements by what they do to a tree: fixed values of the language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
#: A start tag that ends an open one, and the tags beyond which that one is not looked for.
LISTS, TABLES, TERMS = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",)), frozenset(("dl",))
ENDS = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), TERMS), "dd": (("dt", "dd"), TERMS), "tr": (("tr",), TABLES), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))),
    "thead": (("thead", "tbody", "tfoot"), TABLES), "tbody": (("thead", "tbody", "tfoot"), TABLES), "tfoot": (("thead", "tbody", "tfoot"), TABLES), "option": (("option",), frozenset(("select", "datalist"))),
}
#: Tags whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dt dd tr td th tbody thead tfoot".split())

#: An end tag in a cell ends nothing outside it, unless it is one of these.
CELLS, WHOLE = frozenset(("td", "th", "caption")), frozenset("td th caption tr tbody thead tfoot table body html".split())

#: What an element is set aside for: its tag, its role, or a word of its class or id.
ASIDE_TAGS = frozenset("nav footer aside form button select datalist fieldset script style template noscript svg head iframe object embed canvas dialog textarea title noembed noframes".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos promotion promoted banner banners nav navbar navigation menu menus menubar breadcrumb breadcrumbs sidebar sidebars aside footer foot masthead topbar "
    "header cookie cookies consent gdpr notice notices notification notifications alert popup popover modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies "
    "pagination pager skip hidden toolbar search searchbox".split()
)
#: Words of these stand for readers' comments, whatever the element holds.
COMMENT_WORDS = frozenset("comment comments disqus respond replies".split())
#: Beside one of these a word stands for something else: an article's own header, or a layout named after a part.
ARTICLE_WORDS, LAYOUT_WORDS = frozenset("article entry post story".split()), frozenset("has no with without is not free hide show js".split())
KEPT_TAGS = frozenset(("html", "body", "main", "article"))

#: Words of class or id that speak for or against a container, and points of tags: fixed values of tree scoring.
GOOD_WORDS = frozenset("article body content entry hentry main page post text blog story".split())
BAD_WORDS = frozenset("meta outbrain shoutbox tags tool caption byline author date links list teaser teasers".split())
TAG_POINTS = {"article": 10, "main": 10, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
WORD_POINTS, PROSE_CHARS, LONG_CHARS, MOST_LENGTH_POINTS, ANCESTORS = 25, 25, 100, 3, 5
SIBLING_POINTS, SIBLING_LINKS, LIST_LINKS, LIST_LEAST = 10, 0.25, 0.66, 3
PARAGRAPHS = frozenset("p pre li dt dd td th h1 h2 h3 h4 h5 h6 blockquote figcaption caption summary address".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LINK_LISTS = frozenset(("ul", "ol", "dl", "menu", "table", "div", "section"))
COMMAS = re.compile("[,،、，]")

#: A comment, a declaration, an end tag or a start tag with attributes; one that never ends takes the rest of the page.
TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/[^a-zA-Z][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?|["'])*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")
NAMED = re.compile(r"(?i)class|id|role|hidden|style")
SPLIT_WORDS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def names_of(classes: str) -> Iterator[list[str]]:
    """Words of each class name."""
    for name in classes.split():
        yield [w.lower() for w in SPLIT_WORDS.split(name) if w]


#: How an element is set aside: not, by its name (unless it holds the page's article), in any case.
SHOWN, SOFT, HARD = 0, 1, 2


def judged(tag: str, attributes: str, in_article: bool) -> tuple[int, int]:
    """How an element is set aside, and the points that its names add."""
    if tag in ASIDE_TAGS or (tag == "header" and not in_article):
        return SOFT if tag == "form" else HARD, 0
    if not attributes or not NAMED.search(attributes):
        return SHOWN, 0
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        values.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    if "hidden" in values or UNSEEN.search(values.get("style", "")):
        return HARD, 0
    names = [*names_of(values.get("class", "")), *names_of(values.get("id", ""))]
    words = {w for name in names for w in name}
    points = WORD_POINTS * (bool(words & GOOD_WORDS) - bool(words & BAD_WORDS))
    if tag in ("html", "body", "main"):
        return SHOWN, points
    if tag != "article" and values.get("role", "").strip().lower() in ASIDE_ROLES:
        return HARD, 0
    for name in names:
        found = ASIDE_WORDS.intersection(name)
        if not found or LAYOUT_WORDS.intersection(name):
            continue
        if found & COMMENT_WORDS:
            return HARD, 0
        if tag != "article" and not (found == {"header"} and (in_article or ARTICLE_WORDS.intersection(name))):
            return SOFT if tag not in INLINE else HARD, 0
    return SHOWN, points


class Page:
    """Elements in page order as parallel lists, and the blocks of text between them."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.own, self.points = ["#page"], [-1], [SHOWN], [0]
        #: The element itself or the nearest one around it that is not inline; whether it holds other such elements.
        self.block, self.has_blocks, self.in_article = [0], [False], [False]
        #: (element, text, characters in links, links)
        self.blocks: list[tuple[int, str, int, int]] = []
        self._stack, self._hard = [0], 0
        self._open: dict[str, list[int]] = {}
        self._begin()
        self._read(html)
        self._flush()

    def _begin(self) -> None:
        self._text: list[str] = []
        self._linked, self._anchors = 0, 0

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self.block[self._stack[-1]], text, min(self._linked, len(text)), self._anchors))
        self._begin()

    def _add(self, raw: str) -> None:
        if self._hard:
            return
        text = unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._open.get("a"):
            self._linked += len(" ".join(text.split()))

    def _last(self, names) -> int:
        """The place in the stack of the innermost open element of these names, else -1."""
        return max((self._open[n][-1] for n in names if self._open.get(n)), default=-1)

    def _close(self, names: tuple[str, ...], bounds: frozenset[str] = frozenset()) -> None:
        """End the innermost open element of these names and all in it, unless an element of bounds is further in."""
        place = self._last(names)
        if place < 0 or place < self._last(bounds):
            return
        for e in reversed(self._stack[place:]):
            if self.block[e] == e:
                self._flush()
            self._stack.pop()
            self._open[self.tags[e]].pop()
            self._hard -= self.own[e] == HARD

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P:
            self._close(("p",), TABLES)
        if tag in ENDS:
            self._close(*ENDS[tag])
        if tag == "a":
            self._close(("a",), TABLES)
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._add(" ")
            return
        parent, e, inline = self._stack[-1], len(self.tags), tag in INLINE
        if not inline:
            self._flush()
            self.has_blocks[self.block[parent]] = True
        own, points = (SHOWN, 0) if self._hard else judged(tag, attributes, self.in_article[parent])
        self.tags.append(tag)
        self.parents.append(parent)
        self.own.append(own)
        self.points.append(points)
        self.block.append(self.block[parent] if inline else e)
        self.has_blocks.append(False)
        self.in_article.append(self.in_article[parent] or tag in ("article", "main"))
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(e)
        self._hard += own == HARD
        self._anchors += tag == "a" and not self._hard

    def _end(self, tag: str) -> None:
        if tag == "p" and not self._open.get("p"):
            self._flush()
        elif tag == "br":
            self._add(" ")
        else:
            self._close((tag,), frozenset() if tag in WHOLE else CELLS)

    def _read(self, html: str) -> None:
        at, search = 0, TAG.search
        while (m := search(html, at)) is not None:
            if m.start() > at:
                self._add(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, m[3])
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                if end is None:
                    return
                at = end.start()
        self._add(html[at:])

    def aside(self) -> list[bool]:
        """For each element whether it is set aside, by itself or by one around it.

        An element that is named after a part of the page but holds its article is a layout
        and not that part; so is a form around an article or a heading of the first rank.
        """
        own, seen, under_heading = list(self.own), [False] * len(self.own), [False] * len(self.own)
        for e, tag in enumerate(self.tags):
            if tag not in ("article", "main", "h1"):
                continue
            walked, up = under_heading if tag == "h1" else seen, self.parents[e]
            while up > 0 and own[up] != HARD and not walked[up]:
                if own[up] == SOFT and (tag != "h1" or self.tags[up] == "form"):
                    own[up] = SHOWN
                walked[up] = True
                up = self.parents[up]
        out = [False] * len(own)
        for e in range(1, len(own)):
            out[e] = own[e] != SHOWN or out[self.parents[e]]
        return out


def block_points(text: str) -> float:
    return 1 + len(COMMAS.findall(text)) + min(len(text) / LONG_CHARS, MOST_LENGTH_POINTS)


def main_text(html: str) -> str:
    """The page's main text: blocks in page order, joined by one space."""
    page = Page(html)
    tags, parents, n, aside = page.tags, page.parents, len(page.tags), page.aside()
    blocks = [b for b in page.blocks if not aside[b[0]]]
    chars, linked, anchors, prose, scores = [0] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n
    scored = [False] * n
    for owner, text, in_links, links in blocks:
        chars[owner] += len(text)
        linked[owner] += in_links
        anchors[owner] += links
        if tags[owner] in HEADINGS or (len(text) < PROSE_CHARS and not page.in_article[owner]):
            continue
        points = block_points(text)
        prose[owner] += points
        # A paragraph, and an element that holds nothing but text, stands inside what it belongs to.
        inner = owner > 0 and (tags[owner] in PARAGRAPHS or not (page.has_blocks[owner] or tags[owner] in KEPT_TAGS))
        around = page.block[parents[owner]] if inner else owner
        for level in range(ANCESTORS):
            scores[around] += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            scored[around] = True
            if around == 0:
                break
            around = page.block[parents[around]]
    for e in range(n - 1, 0, -1):  # children come after their parents
        for total in (chars, linked, anchors, prose):
            total[parents[e]] += total[e]
    density = [linked[e] / chars[e] if chars[e] else 0.0 for e in range(n)]
    best, most = 0, None
    for e in range(n):
        if scored[e]:
            score = (scores[e] + TAG_POINTS.get(tags[e], 0) + page.points[e]) * (1 - density[e])
            if most is None or score > most:
                best, most = e, score
    around = best
    while around > 0 and tags[around] != "article":
        around = parents[around]
    best = around or best

    children = [e for e in range(1, n) if parents[e] == parents[best]] if best else []
    chosen, following = {best}, None
    for e in children:
        if not aside[e] and density[e] < SIBLING_LINKS and chars[e]:
            sentence = tags[e] in PARAGRAPHS and tags[e] not in HEADINGS
            if tags[e] == tags[best] == "article" or sentence or prose[e] + TAG_POINTS.get(tags[e], 0) >= SIBLING_POINTS:
                chosen.add(e)
    for e in reversed(children):  # a heading belongs to what comes after it
        if tags[e] in HEADINGS and following in chosen and not aside[e] and density[e] < SIBLING_LINKS:
            chosen.add(e)
        following = e if chars[e] or e in chosen else following

    kept = [False] * n
    for e in range(n):
        menu = tags[e] in LINK_LISTS and anchors[e] >= LIST_LEAST and density[e] > LIST_LINKS
        kept[e] = e in chosen or (e > 0 and kept[parents[e]] and not menu)
    loose = parents[best]
    out = []
    for owner, text, in_links, _ in blocks:
        if kept[owner] or (owner == loose and len(text) >= PROSE_CHARS and in_links < SIBLING_LINKS * len(text)):
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    Null and empty html, and a page without text, give an empty text. Markup may be broken
    in any way, nested to any depth and of any length; a page is read whole. Repeated rows
    and null ids keep their rows. Other columns are not looked at; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = map_batches(read, run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
