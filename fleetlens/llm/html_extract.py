"""Main text of web pages by tree scoring.

A page becomes a light element tree.  Every paragraph (a block with text of its
own) gives points for its length and commas to its ancestors, less the higher
they are; an element's points are discounted by its link density and adjusted
for its tag and its class and id words.  Kept are the container with the most
points, or the outermost article or main around it, and those of its siblings
that score well or read like prose.  Outside an article or main, the elements
around are taken whole as long as more than half of their text, without
link lists, is what was kept so far, so titles, short sections and closing
lines stay.  Menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles inside are left out: elements of such a tag or
landmark role, hidden ones, and those whose class or id has a word that says so
(names are cut at signs and capitals, and a telling word counts whatever stands
beside it), unless the element holds most of the page's text.

Text rules: character references are decoded; a block is the text between
block-level tags; white space in it, line breaks included, becomes one space; blocks are trimmed,
empty ones dropped, and the rest joined in page order by one line feed.  Defined
cases: a NULL or empty page, and a page without a paragraph outside
boilerplate, give the empty text; unclosed elements end where their parent ends
or, for p, li, dt, dd, tr, td, th and option, at the next block that cannot be
inside them; a link ends at its end tag, at the next link or with the element it
began in; elements nested deeper than MAX_DEPTH belong to the one at that depth; a
tag that never ends (an open quote) ends at its first ">".  Repeated rows give a row
each, rows with a NULL page_id too; an empty table gives no rows; only page_id, url
and html are read, so extra columns may have any name.  Parsing takes time linear in
the page, whatever it holds.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import annotate

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt
    ruby s samp small span strike strong sub sup time tt u var wbr""".split())
BOILERPLATE = frozenset("""head nav header footer aside form script style noscript template button select option input
    textarea title iframe object embed svg canvas audio video dialog menu xmp noembed noframes""".split())
#: A new one of these ends an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body html article section main div".split())

#: Words of class and id names, and roles, of what is not the article.
BAD_WORDS = frozenset("""ad ads adslot adsense advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments
    commentlist commenter consent cookie cookies disqus foot footer footnav gdpr header masthead login menu menus menubar modal nav navbar
    navigation newsletter notice pagination pager popup promo promos promotion promotions related replies reply respond rss search share
    sharing shoutbox sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets""".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
MAX_DEPTH = 512
TAG_POINTS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0,
              "ul": -3.0, "ol": -3.0, "li": -3.0, "dl": -3.0, "address": -3.0, "html": -10.0, "body": -5.0}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))|(?<![\w-])(hidden)(?![\w-])""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("tag", "parent", "children", "bad", "suspect", "points", "chars", "link_chars", "blocks", "depth")

    def __init__(self, tag: str, parent: Element | None, bad: bool, suspect: bool, points: float):
        self.tag, self.parent, self.bad, self.suspect, self.points = tag, parent, bad, suspect, points
        self.children: list[Element] = []
        self.chars = self.link_chars = 0
        self.blocks: list[int] = []  # numbers of the blocks directly inside
        self.depth = 0 if parent is None else parent.depth + 1


def _element(tag: str, attrs: str, parent: Element) -> Element:
    """A new element: bad for its tag, its role or because it is hidden, and
    suspect for its names."""
    points, bad, suspect, words = TAG_POINTS.get(tag, 0.0), tag in BOILERPLATE, False, set()
    for key, *values, hidden in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values)
        if hidden or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDING.search(value):
            bad = True
        elif key == "role":
            bad = bad or value.strip().lower() in BAD_ROLES
            words.update(value.lower().split())
        elif key in ("class", "id"):
            words.update(w.lower() for w in _WORDS.findall(value))
    if tag not in ("html", "body"):
        suspect = not BAD_WORDS.isdisjoint(words)
    if not suspect and not GOOD_WORDS.isdisjoint(words):
        points += 25
    e = Element(tag, parent, bad, suspect, points)
    parent.children.append(e)
    return e


def _tag_end(page: str, at: int, plain: bool) -> int:
    """Where the ">" of a tag is, quoted attribute values skipped; -1 if there is none."""
    if plain:
        return page.find(">", at)
    while (m := _TAG_STOP.search(page, at)) is not None:
        if m[0] == ">":
            return m.start()
        at = page.find(m[0][-1], m.end()) + 1
        if not at:
            return -1
    return -1


def parse(page: str) -> tuple[Element, list[str]]:
    """The tree of non-inline elements, and the text of all blocks in order."""
    root = Element("#", None, False, False, -100.0)
    here, texts, piece, links = root, [], [], 0
    link: Element | None = None  # the element in which an open link began
    opened: dict[str, int] = {}
    at, end, plain = 0, len(page), False

    def flush():
        nonlocal piece, links
        if piece:
            text = "".join(piece)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                here.blocks.append(len(texts))
                texts.append(text)
                here.chars += len(text)
                here.link_chars += min(links, len(text))
            piece, links = [], 0

    def up_to(e: Element):
        """Close all elements below ``e``."""
        nonlocal here, link
        while here is not e:
            opened[here.tag] -= 1
            if link is here:
                link = None
            here = here.parent

    def text(start: int, stop: int):
        nonlocal links
        if stop > start:
            piece.append(page[start:stop])
            if link is not None:
                links += stop - start

    while at < end:
        start = page.find("<", at)
        if start < 0:
            text(at, end)
            break
        text(at, start)
        closing = page.startswith("/", start + 1)
        m = _NAME.match(page, start + 1 + closing)
        if m is None:
            if page.startswith("<!--", start):
                stop = page.find("-->", start + 4)
                at = end if stop < 0 else stop + 3
            elif closing or page.startswith(("!", "?"), start + 1):
                stop = page.find(">", start)
                at = end if stop < 0 else stop + 1
            else:  # a sign of its own
                text(start, start + 1)
                at = start + 1
            continue
        stop = _tag_end(page, m.end(), plain)
        if stop < 0 and not plain:  # an open quote: from here on tags end at the first ">"
            plain = True
            stop = _tag_end(page, m.end(), plain)
        if stop < 0:
            break  # no tag ends any more
        tag, attrs, at = m[0].lower(), page[m.end():stop], stop + 1
        if tag in INLINE:
            if tag == "a":
                link = None if closing else here
            elif tag == "br":
                piece.append(" ")
            continue
        flush()
        if closing:
            if opened.get(tag):
                e = here
                while e.tag != tag:
                    e = e.parent
                up_to(e.parent)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag in VOID:
            continue
        up_to(_closed_by(tag, here, opened))
        if here.depth >= MAX_DEPTH or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        here = _element(tag, attrs, here)
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return root, texts


def _closed_by(tag: str, here: Element, opened: dict[str, int]) -> Element:
    """Where a new element goes when it ends open ones."""
    if here.tag == "p":  # no block stands inside a paragraph
        here = here.parent
    group = CLOSES.get(tag)
    if group and tag != "p" and any(opened.get(g) for g in group):
        e = here
        while e.parent is not None and e.tag not in SCOPES:
            if e.tag in group:
                return e.parent
            e = e.parent
    return here


def _score(root: Element, texts: list[str]) -> list[Element]:
    """Decides what is boilerplate and passes points up; returns all elements in page order."""
    order, stack = [], [root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack.extend(reversed(e.children))
    whole = dict.fromkeys(order, 0)  # characters inside that are not bad for their tag
    for e in reversed(order):
        whole[e] = 0 if e.bad else whole[e] + e.chars
        if e.parent is not None:
            whole[e.parent] += whole[e]
    for e in order:
        if e.suspect and 2 * whole[e] <= whole[root]:
            e.bad = True
        if e.parent is not None and e.parent.bad:
            e.bad = True
        if e.bad:
            e.blocks, e.chars, e.link_chars = [], 0, 0
    for e in order:
        if e.bad or not e.chars:
            continue
        prose = sum(1 + texts[b].count(",") + min(len(texts[b]) / 100, 3) for b in e.blocks if len(texts[b]) >= 25)
        prose *= 1 - e.link_chars / e.chars
        # Text directly in a container counts for it; a paragraph's for those above.
        up, level = (e if e.tag in ("div", "article", "main", "section", "body", "td") else e.parent), 0
        while up is not None and level < 5:
            up.points += prose / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1
    for e in reversed(order):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.link_chars += e.link_chars
    return order


def _final(e: Element) -> float:
    return e.points * (1 - e.link_chars / e.chars) if e.chars and not e.bad else float("-inf")


def main_text(page: str | None) -> str:
    root, texts = parse(page or "")
    order = _score(root, texts)
    holders = [e for e in order if e.chars and not e.bad and e.tag not in ("p", "#", "li") and e.tag not in HEADINGS]
    if not holders:
        return "\n".join(texts[b] for b in sorted(_blocks([root])))
    best = max(holders, key=_final)
    limit = max(10.0, 0.2 * _final(best))
    top, e = best, best
    while e is not None:
        if e.tag in ("article", "main"):
            top = e
        e = e.parent
    found: set[int] = set()
    for centre in {best, top}:
        found.update(_blocks([e for e in centre.parent.children if e is centre or not e.bad and e.chars and (
            _final(e) >= limit or e.tag == "p" and e.chars > 80 and e.link_chars < 0.25 * e.chars)]))
    if top.tag not in ("article", "main"):
        article = chars = sum(len(texts[b]) for b in found)
        e = top
        while e.parent is not None:
            around = _blocks([c for c in e.parent.children if c is not e], prose_only=True)
            more = [b for b in e.parent.blocks + around if b not in found]
            chars += sum(len(texts[b]) for b in more)
            if chars >= 2 * article:
                break
            found.update(more)
            e = e.parent
    return "\n".join(texts[b] for b in sorted(found))


def _blocks(kept: list[Element], prose_only: bool = False) -> list[int]:
    """Blocks of the elements, without boilerplate and menus, or without
    anything that is mostly links but a heading."""
    found: list[int] = []
    stack = list(kept)
    while stack:
        e = stack.pop()
        links = prose_only and e.link_chars > 0.5 * e.chars and e.tag not in HEADINGS
        if not e.bad and not links and not _menu(e):
            found.extend(e.blocks)
            stack.extend(e.children)
    return found


def _menu(e: Element) -> bool:
    """A list of links is a menu wherever it stands."""
    return e.tag in ("ul", "ol", "dl") and e.chars > 0 and e.link_chars > 0.8 * e.chars


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.col("html").cast("string").alias("html"))

    def factory():
        def texts(page_list):
            return [pa.array([main_text(h) for h in page_list], pa.string())]
        return texts

    df, name = annotate(p, "html", [T.StructField("text", T.StringType())], factory, ["page_id", "url"])
    return df.select("page_id", "url", f"{name}.text").withColumn("n_chars", F.length("text").cast("long"))
