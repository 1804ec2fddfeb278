"""Main text of web pages by composite text density.

A page is parsed leniently into a tree. Parts that are never an article's text (scripts, styles,
menus, headers, footers, sidebars, notices, adverts, forms, reader comments) are left out by tag, role
or whole class name. Every other node has a density: its characters per tag, adjusted by the characters and
tags of links in it and by the share of link characters in the body. A node's density sum adds the
densities of its children (text of its own counts as a child). The node of the greatest sum is chosen;
the least density on its path to the body is the threshold: beside the path, a part of blocks is kept if it
reaches the threshold, a single block (a heading, a paragraph) if it is no list of links. An ``article`` or ``main`` element on the chosen
node's path bounds it: of what surrounds it only a title is kept. Within a ``main`` the same threshold decides; within an ``article``, and of the chosen
node's own children, a part of blocks goes only if it stays below the threshold, is links for the most part and has no heading; lists in
an article's own flow (references) stay.

Character references are decoded; white space inside a block becomes one space; blocks are joined by
one space in page order. Defined results: null or empty html, or a page without text, gives an empty
text; markup that is cut off ends where the page ends; equal pages have equal texts; of nodes with equal sums the first one is chosen; a
very long page is taken whole, by itself; page ids and urls that are null or repeat are passed on; further columns play no part.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*|[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# HTML's element names by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: For a start tag, the open elements that it ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ENDS |= {t: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
#: Blocks that hold no others, as a rule.
SINGLE_BLOCKS = frozenset("address blockquote br figcaption h1 h2 h3 h4 h5 h6 hr p pre summary".split())
P_SCOPE = frozenset("article aside blockquote body button caption dd div dt fieldset figure footer form header html li main nav object section table td th".split())
# Elements, roles and name parts of what surrounds an article.
OUTSIDE_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea title input iframe object embed svg canvas dialog menu audio video map noembed noframes".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_NAMES = frozenset(
    "ad ads adsense adbox adslot adunit advert adverts advertisement advertising sponsor sponsored promo promos promoted promotion outbrain taboola banner cookie cookies consent gdpr "
    "notice notices alert announcement disclaimer toast popup modal overlay newsletter subscribe subscription signup signin login register paywall sidebar sidenav rail aside menu menus nav navbar navigation topnav subnav dropdown sitemap breadcrumb "
    "breadcrumbs footer footnav masthead topbar toolbar share sharing shares social related recommended recommendations trending comment comments commentlist "
    "reply replies respond disqus discussion pagination pager widget widgets search skip toc copyright".split()
)
ADVERT_NAMES = frozenset("ad ads adsense adbox adslot adunit advert adverts advertisement advertising sponsor sponsored promo promos promoted outbrain taboola".split())
#: Names that put an ``article`` element outside, and those that a text block may have.
ARTICLE_OUTSIDE_NAMES = ADVERT_NAMES | frozenset("comment comments commentlist reply replies respond disqus related recommended recommendations share sharing social newsletter subscribe subscription signup cookie cookies consent teaser".split())
TEXT_OUTSIDE_NAMES = ADVERT_NAMES | frozenset("comment comments reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that hold parts of a page; lists and tables are no such parts.
PARTS = frozenset("div section details fieldset center dir".split())
#: Words that may stand beside such a name without making it another one.
PLAIN_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons card col column container content desktop first fixed form global group header icon icons inner item items js label last left link links list main message mobile "
    "module new outer page panel post posts primary reader readers region right row secondary section site slot space sticky stories story strip text title tools top unit user wrap wrapper zone".split()
)
NEVER_OUTSIDE = frozenset("html body article main".split())
#: Blocks of text, which a class name puts outside only as adverts or comments.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td th tr tbody dt dd figcaption caption".split())
HEADER_NAMES = frozenset({"header", "siteheader", "pageheader"})


def name_parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)]


def is_outside(tag: str, attrs: str, in_article: bool) -> bool:
    """Whether an element surrounds the article, by its tag, role, state or class and id names.

    A name counts as a whole: one of the known words, with nothing but plain words beside it. Ids of text blocks are anchors and do not count."""
    if tag in OUTSIDE_TAGS or tag == "header" and not in_article:
        return True
    if not attrs.strip() or tag in NEVER_OUTSIDE and tag != "article":
        return False
    names = TEXT_OUTSIDE_NAMES if tag in TEXT_BLOCKS else ARTICLE_OUTSIDE_NAMES if tag == "article" else OUTSIDE_NAMES
    for key, *values in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), unescape("".join(values))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if key == "role" and value.lower() in OUTSIDE_ROLES:
            return True
        if key == "class" or key == "id" and tag not in TEXT_BLOCKS:
            for name in value.split():
                parts = set(name_parts(name))
                if parts & names and parts <= names | PLAIN_WORDS or "".join(name_parts(name)) in HEADER_NAMES and not in_article and tag not in TEXT_BLOCKS:
                    return True
    return False


class Page:
    """A parsed page: for each node its tag, parent and children, and the texts in page order."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.children = ["#root"], [-1], [[]]
        self.outside, self.in_article = [False], [False]
        self.pieces: list[tuple[int, str]] = []
        self.stack = [0]
        at = 0
        while at < len(html):
            token = TOKEN.search(html, at)
            if token is None:
                self._text(html[at:])
                break
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            if token["cdata"]:
                self._text(token["cdata"])
            if token["tag"] is None:
                continue
            tag = token["tag"].lower()
            if token["end"]:
                self._close(tag)
                continue
            attrs = token["attrs"] or ""
            self._open(tag, attrs)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
                self._close(tag)
            elif tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
                self.stack.pop()

    def _text(self, raw: str) -> None:
        if not self.outside[self.stack[-1]]:
            self.pieces.append((self.stack[-1], unescape(raw) if "&" in raw else raw))

    def _break(self, tag: str) -> None:
        if tag in BLOCKS:
            self.pieces.append((self.stack[-1], " "))

    def _end(self, tags: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.tags[self.stack[depth]]
            if tag in tags:
                del self.stack[depth:]
                self.pieces.append((self.stack[-1], " "))
                return
            if tag in scope:
                return

    def _open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P:
            self._end({"p"}, P_SCOPE)
        if tag in ENDS:
            self._end(*ENDS[tag])
            if tag in ("tr", "tbody", "thead", "tfoot"):
                self._end(*ENDS[tag])
        if tag in ("html", "body") and tag in self.tags:
            self.stack.append(self.tags.index(tag)) if self.tags.index(tag) not in self.stack else None
            return
        self._break(tag)
        above = self.stack[-1]
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(above)
        self.children.append([])
        self.children[above].append(node)
        inside = self.in_article[above]
        self.outside.append(tag not in ("html", "body") and (self.outside[above] or is_outside(tag, attrs, inside)))
        self.in_article.append(inside or tag in ("article", "main"))
        self.stack.append(node)

    def _close(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == tag:
                if tag not in ("html", "body"):
                    del self.stack[depth:]
                self._break(tag)
                return
        if tag in ("p", "br"):
            self._break(tag)

    def text_of(self, wanted: list[bool]) -> str:
        """The texts of the wanted nodes in page order."""
        return " ".join("".join(t if wanted[n] else " " if t == " " else "" for n, t in self.pieces).split())


def _sizes(page: Page) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Of each node: characters, tags, characters in links, link tags of its subtree, and characters of its own."""
    count = len(page.tags)
    own = [0] * count
    for node, text in page.pieces:
        own[node] += sum(map(len, text.split()))
    chars, tags, link_chars, links = list(own), [0] * count, [0] * count, [0] * count
    for node in range(count - 1, 0, -1):
        if page.outside[node]:
            continue
        if page.tags[node] == "a":
            link_chars[node], links[node] = chars[node], links[node] + 1
        above = page.parents[node]
        for each, more in ((chars, 0), (tags, 1), (link_chars, 0), (links, 0)):
            each[above] += each[node] + more
    return chars, tags, link_chars, links, own


def density(chars: int, tags: int, link_chars: int, links: int, body_share: float) -> float:
    """Composite text density: characters per tag, by a logarithm that links lower."""
    if chars == 0:
        return 0.0
    tags, links, free, bound = max(tags, 1), max(links, 1), max(chars - link_chars, 1), max(link_chars, 1)
    base = math.log(chars / free * bound + body_share * chars + math.e)
    return chars / tags * math.log(max(chars / bound * tags / links, 1.0) + 1) / math.log(base + 1)


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = Page(html)
    chars, tags, link_chars, links, own = _sizes(page)
    body = page.tags.index("body") if "body" in page.tags else 0
    if chars[body] == 0:
        body = 0
    share = link_chars[body] / max(chars[body], 1)
    nodes = range(len(page.tags))
    dense = [0.0 if page.outside[n] else density(chars[n], tags[n], link_chars[n], links[n], share) for n in nodes]
    sums = [density(own[n], 1, 0, 0, share) + sum(dense[c] for c in page.children[n]) for n in nodes]
    candidates = [n for n in nodes if not page.outside[n] and chars[n]]
    if not candidates:
        return ""
    best = max(candidates, key=lambda n: (sums[n], -n))
    path = [best]
    while path[-1] != body and page.parents[path[-1]] >= 0:
        path.append(page.parents[path[-1]])
    threshold = min(dense[n] for n in path)
    marked = [n for n in path if page.tags[n] == "article"] or [n for n in path if page.tags[n] == "main"]
    bound = path.index(marked[-1]) if marked else len(path)
    place = {n: k for k, n in enumerate(path)}
    headed = [False] * len(page.tags)
    for n in reversed(nodes):
        if n and not page.outside[n] and (headed[n] or page.tags[n] in HEADINGS and link_chars[n] < chars[n]):
            headed[page.parents[n]] = True

    def beside(n: int) -> bool:
        """Whether a child of a node on the path, itself beside it, belongs to the text."""
        above = place[page.parents[n]]
        if marked and above > bound:
            return page.tags[n] == "h1"
        few_links = link_chars[n] <= chars[n] / 2
        if above == 0 or marked and page.tags[marked[-1]] == "article":
            return page.tags[n] not in PARTS or few_links or dense[n] >= threshold or headed[n]
        return page.tags[n] not in BLOCKS or few_links and (page.tags[n] in SINGLE_BLOCKS or dense[n] >= threshold)

    wanted = [False] * len(page.tags)
    for n in nodes:
        above = page.parents[n]
        if page.outside[n]:
            continue
        if n in place:
            wanted[n] = place[n] <= bound
        elif above in place:
            wanted[n] = beside(n)
        else:
            wanted[n] = above >= 0 and wanted[above]
    return page.text_of(wanted)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` and text and n_chars (code points); one narrow stage, a page at a time."""

    def work(html: pa.Array) -> list[pa.Array]:
        texts = [extract(h) for h in html.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_texts(pages, html_col, list(keep), [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], work)
