"""Operator 2: main text of HTML pages from flat text blocks and a decision tree.

A page is cut at block-level tags into flat text blocks.  Each block has its
word count and link density, those of its neighbours, and six marks: whether it is
a heading or a paragraph, stands in an article, stands outside on a page that has
one, reads like a notice, or stands in a container that names itself boilerplate
(menu, footer, advert, form, comments ...).  A decision tree trained on the small
labelled table below says which blocks are the article; they are joined by an empty
line.  The marks settle well-built pages; where they are absent or misleading (plain
pages, a form around everything, link lists inside an article) word counts and
link densities do.

A name counts by its place in a class: ``site-footer`` and ``footer-links`` are
footers, ``tag-search`` and ``category-social`` are topics, ``no-sidebar`` and
``search-enabled`` are states.  Names on html, body, main and article elements say
nothing of their text.  An article that opens inside a container of a layout name
(``sidebar``, ``top`` ...) is an article still.  A form, or a container whose name
speaks of layout or of content too, that holds most of a page's words is only half a
mark of boilerplate: the tree sees it as such and judges the blocks by their words.

The scanner goes over a page once: its patterns never try a place in two ways.
The tree is grown once on the driver (a few dozen splits over some hundred rows)
and travels with the task; pages are row-local: one scan, no shuffle.

Defined cases: null, empty and text-free pages give the empty string; a page cut
off inside a tag loses that tag only, one cut off inside a script or comment ends
there; a quote that is never closed ends with its tag; unknown character
references stay as they are; repeated rows are extracted alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._shared import map_arrow, spread

#: Elements by kind (HTML standard).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = frozenset(["br", "img", "input", "wbr"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: Containers whose text is no article text, unless noted.
BOILER_TAGS = frozenset("nav footer aside form button dialog menu label fieldset".split())
MAIN_TAGS = frozenset(["article", "main"])
BOILER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
BOILER_NAMES = frozenset(
    "ad ads adsense adv advert adverts alert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer discussion disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation "
    "newsletter notice notification overlay pager pagination popup promo promotion related reply replies respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar "
    "topbar warning widget feedback responses disclosure cta".split()
)
#: Boilerplate only outside an article.
OUTER_TAGS = frozenset(["header"])
OUTER_NAMES = frozenset(["header", "top", "bottom"])
#: Names of a place on the page: an article may open inside.
LAYOUT_NAMES = frozenset("banner bottom header menu nav navbar navigation search sidebar skip social tags toolbar top topbar".split())
#: Elements whose own names are not read, and names that speak of a state.
UNNAMED_TAGS = frozenset(["html", "body", "main", "article"])
#: What a class is about, if more follows than the word for a box.
TOPIC_FIRST = frozenset("cat category format section status tag tags topic type".split())
BOX_NAMES = frozenset("area bar block box buttons cloud col container group inner item items links list outer panel row wrap wrapper".split())
#: Names that speak of content, whatever else stands beside them.
CONTENT_NAMES = frozenset("article body content entry main page post story text".split())
STATE_FIRST = frozenset("disable enable has hide is no not show with without".split())
STATE_LAST = frozenset("closed disabled enabled layout off on open site".split())

#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style title textarea noscript iframe template svg select object math".split())
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in RAW_TAGS}
#: A comment, a tag with its attributes, a declaration, or a tag cut off by the end; possessive, so linear.
ATTRS = r"""(?>[^<>=]++|=\s*+(?>"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({ATTRS})>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^<>]*+\Z", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Short blocks that hold one of these read like notices.
NOTICE = re.compile(
    r"\b(?:subscribe (?:to|now)|sign up|newsletter|all rights reserved|accept (?:all )?cookies|we use cookies|privacy policy|terms of (?:use|service)"
    r"|share this|follow us|log ?in|advertisement|sponsored|read more|click here|leave a (?:reply|comment)|skip to content)\b",
    re.IGNORECASE,
)
NOTICE_WORDS = 15
#: What a container is: text, boilerplate by the name of its place, boilerplate.
TEXT, LAYOUT, BOILER = 0, 1, 2
#: Share of a page's words above which a soft container is half a mark.
MOST = 0.5


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_words: int
    main: bool
    boiler: float
    heading: bool
    paragraph: bool = False
    notice: bool = False


@dataclass(slots=True)
class Container:
    """An open or closed element that marks boilerplate; soft ones may turn out to wrap the page."""

    parent: int
    kind: int
    soft: bool
    words: int = 0
    main: bool = False


def _named(value: str, in_main: bool) -> tuple[int, bool]:
    """What the names of a class or id attribute say, and whether softly."""
    found, soft = TEXT, True
    for name in value.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if not parts or parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
            continue
        if parts[0] in TOPIC_FIRST and len(parts) > 1 and parts[-1] not in BOX_NAMES:
            continue
        while len(parts) > 1 and parts[-1] in BOX_NAMES:
            parts.pop()
        says = [p in BOILER_NAMES or (p in OUTER_NAMES and not in_main) for p in parts]
        for part, said in zip(parts, says):
            if said:
                found = max(found, LAYOUT if part in LAYOUT_NAMES else BOILER)
        if any(says):  # in the middle of a name, or beside a name of content, it says less
            soft &= not (says[0] or says[-1]) or any(p in CONTENT_NAMES for p in parts)
    return found, soft


def _container(tag: str, attrs: str, in_main: bool) -> tuple[int, bool]:
    """What an element's tag and attributes say of its text, and whether softly."""
    if tag in BOILER_TAGS or (tag in OUTER_TAGS and not in_main):
        return BOILER, tag == "form"
    found, soft = TEXT, True
    for name, value in ATTRIBUTE.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            if tag not in UNNAMED_TAGS:
                said, softly = _named(value, in_main)
                found = max(found, said)
                soft &= softly or said == TEXT
        elif name == "role":
            if value.lower() in BOILER_ROLES:
                return BOILER, False
        elif name == "style":
            if HIDDEN_STYLE.search(value):
                return BOILER, False
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return BOILER, False
    return found, soft or found == LAYOUT


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in order; blocks without a word are left out."""
    out: list[Block] = []
    inside: list[int] = []  # of each block its innermost container of boilerplate, -1 for none
    containers: list[Container] = []
    # open elements: name, in main, innermost container, in a link
    stack: list[tuple[str, bool, int, bool]] = [("", False, -1, False)]
    pieces: list[str] = []
    links: list[str] = []
    heading = False

    def flush() -> None:
        if pieces:
            words = html_lib.unescape("".join(pieces)).split()
            if words:
                name, main, own, _ = stack[-1]
                linked = len(html_lib.unescape("".join(links)).split()) if links else 0
                text = " ".join(words)
                notice = len(words) <= NOTICE_WORDS and NOTICE.search(text) is not None
                paragraph = name == "p" or (name == "a" and len(stack) > 1 and stack[-2][0] == "p")
                out.append(Block(text, len(words), linked, main, 0.0, heading, paragraph, notice))
                inside.append(own)
                if own >= 0:
                    containers[own].words += len(words)
            pieces.clear()
            links.clear()

    at, size = 0, len(page)
    search = TOKEN.search
    while at < size:
        m = search(page, at)
        begin = m.start() if m else size
        if begin > at:
            piece = page[at:begin]
            pieces.append(piece)
            if stack[-1][3]:
                links.append(piece)
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag, closing = m.group(2).lower(), m.group(1)
        if tag in RAW_TAGS:
            if not closing:  # what stands up to the element's own end tag goes
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else size
                if tag in ("textarea", "iframe", "title"):
                    flush()
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
            if tag in HEADINGS:
                heading = not closing
            elif heading:
                heading = False
        elif tag in SPACE_TAGS:
            pieces.append(" ")
        if tag in VOID_TAGS:
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if stack[k - 1][2] != stack[-1][2] or stack[k - 1][1] != stack[-1][1]:
                        flush()
                    del stack[k:]
                    break
            continue
        if block and stack[-1][0] == "p":
            stack.pop()
        if tag == "a":
            while stack[-1][0] == "a":
                stack.pop()
        _, main, own, link = stack[-1]
        kind, soft = _container(tag, m.group(3), main or tag in MAIN_TAGS)
        new = own
        if tag in MAIN_TAGS:
            if not main and _named(" ".join(_names(m.group(3))), True)[0] == TEXT:
                if own >= 0:
                    containers[own].main = True
                while new >= 0 and containers[new].kind == LAYOUT:
                    new = containers[new].parent
            main = True
        if kind != TEXT:
            containers.append(Container(new, kind, soft))
            new = len(containers) - 1
        if block or tag == "a" or new != own:
            if new != own:
                flush()
            stack.append((tag, main, new, link or tag == "a"))
    flush()
    marks = _marks(containers, sum(b.words for b in out))
    for b, own in zip(out, inside):
        b.boiler = marks[own] if own >= 0 else 0.0
    return out


def _marks(containers: list[Container], words: int) -> list[float]:
    """How much each container marks boilerplate, what holds it counted in: a half or a whole."""
    for c in reversed(containers):  # a container comes after the one that holds it
        if c.parent >= 0:
            containers[c.parent].words += c.words
            containers[c.parent].main |= c.main
    out: list[float] = []
    for c in containers:
        half = c.words > MOST * words and (c.soft or (c.main and c.kind == BOILER))
        out.append(max(0.5 if half else 1.0, out[c.parent] if c.parent >= 0 else 0.0))
    return out


def _names(attrs: str) -> list[str]:
    return [value.strip("\"'") for name, value in ATTRIBUTE.findall(attrs) if name.lower() in ("class", "id")]


FEATURES = (
    "words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density",
    "in_article", "outside_article", "in_boilerplate", "heading", "paragraph", "notice",
)


def features(page: list[Block]) -> list[tuple[float, ...]]:
    own = [(float(b.words), b.link_words / b.words) for b in page]
    padded = [(0.0, 0.0), *own, (0.0, 0.0)]
    has = any(b.main and b.boiler < 1 for b in page)
    return [
        (
            *padded[i + 1], *padded[i], *padded[i + 2], float(b.main), float(has and not b.main), b.boiler, float(b.heading),
            float(b.paragraph), float(b.notice),
        )
        for i, b in enumerate(page)
    ]


#: The labelled table: pages as rows (words, words in links, in an article, in a
#: boilerplate container (half: see above), heading, is article text[, paragraph, notice]),
#: labelled by hand.  Where the last two are not given, article text and other prose stand
#: in paragraphs, headings do not, and nothing reads like a notice.
LABELLED = (
    # news page with an article element
    ((1, 1, 0, 1, 0, 0), (1, 1, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (9, 0, 0, 1, 0, 0), (8, 0, 1, 0, 1, 1), (32, 0, 1, 0, 0, 1),
     (1, 0, 1, 0, 0, 1), (54, 3, 1, 0, 0, 1), (5, 0, 1, 0, 0, 1), (120, 0, 1, 0, 0, 1), (14, 0, 0, 1, 0, 0)),
    # article with an advert, a share bar and reader comments inside
    ((3, 3, 0, 1, 0, 0), (6, 0, 1, 0, 1, 1), (60, 0, 1, 0, 0, 1), (18, 0, 1, 1, 0, 0), (44, 2, 1, 0, 0, 1), (2, 0, 1, 0, 0, 1),
     (3, 3, 1, 1, 0, 0), (25, 0, 1, 1, 0, 0), (40, 0, 1, 1, 0, 0), (12, 1, 0, 1, 0, 0)),
    # short article, long footer and sidebar
    ((2, 2, 0, 1, 0, 0), (4, 0, 1, 0, 1, 1), (7, 0, 1, 0, 0, 1), (3, 0, 1, 0, 0, 1), (35, 4, 0, 1, 0, 0), (50, 0, 0, 1, 0, 0)),
    # article that links much, list items among its text
    ((5, 0, 1, 0, 1, 1), (20, 12, 1, 0, 0, 1), (4, 0, 1, 0, 0, 1), (3, 3, 1, 0, 0, 1), (36, 2, 1, 0, 0, 1), (30, 6, 1, 0, 0, 1),
     (2, 2, 0, 1, 0, 0)),
    # encyclopaedia article: long paragraphs full of links, a footer of long linked notices
    ((3, 0, 1, 0, 1, 1), (60, 12, 1, 0, 0, 1), (90, 25, 1, 0, 0, 1), (4, 0, 1, 0, 1, 1), (40, 14, 1, 0, 0, 1), (130, 30, 1, 0, 0, 1), (24, 9, 1, 0, 0, 1),
     (42, 12, 0, 1, 0, 0), (75, 20, 0, 1, 0, 0), (28, 14, 0, 1, 0, 0)),
    # the same as a plain page
    ((2, 2, 0, 0, 0, 0), (4, 0, 0, 0, 1, 1), (70, 16, 0, 0, 0, 1), (55, 9, 0, 0, 0, 1), (110, 34, 0, 0, 0, 1), (5, 5, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0)),
    # menus right before and after long paragraphs
    ((1, 1, 0, 1, 0, 0), (2, 2, 0, 1, 0, 0), (50, 0, 1, 0, 0, 1), (61, 4, 1, 0, 0, 1), (2, 2, 0, 1, 0, 0), (4, 4, 0, 1, 0, 0)),
    ((2, 2, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (45, 0, 0, 0, 0, 1), (72, 3, 0, 0, 0, 1), (3, 3, 0, 0, 0, 0), (90, 0, 0, 0, 0, 1)),
    ((1, 1, 0, 0, 0, 0), (10, 8, 0, 0, 0, 0), (64, 2, 1, 0, 0, 1), (3, 3, 1, 0, 0, 1), (57, 0, 1, 0, 0, 1), (14, 6, 0, 1, 0, 0), (80, 1, 1, 0, 0, 1)),
    # share bars and adverts of links between the paragraphs of an article
    ((5, 0, 1, 0, 1, 1), (4, 4, 1, 1, 0, 0), (70, 0, 1, 0, 0, 1), (2, 2, 1, 1, 0, 0), (9, 9, 1, 1, 0, 0), (41, 3, 1, 0, 0, 1), (20, 18, 1, 1, 0, 0),
     (55, 0, 1, 0, 0, 1)),
    ((6, 0, 1, 0, 1, 1), (58, 2, 1, 0, 0, 1), (3, 3, 1, 1, 0, 0), (64, 0, 1, 0, 0, 1), (1, 1, 1, 1, 0, 0), (37, 0, 1, 0, 0, 1), (12, 6, 1, 1, 0, 0),
     (47, 1, 1, 0, 0, 1), (16, 10, 1, 1, 0, 0), (30, 14, 1, 1, 0, 0), (52, 0, 1, 0, 0, 1), (2, 2, 1, 0, 0, 1), (39, 0, 1, 0, 0, 1)),
    # article with linked paragraphs beside an unnamed sidebar of linked texts
    ((1, 1, 0, 0, 0, 0), (6, 0, 1, 0, 1, 1), (45, 8, 1, 0, 0, 1), (38, 6, 1, 0, 0, 1), (30, 12, 0, 0, 0, 0), (41, 10, 0, 0, 0, 0), (22, 7, 0, 0, 0, 0)),
    # list of links to other pages at the end of an article, in no container that says so
    ((7, 0, 1, 0, 1, 1), (66, 1, 1, 0, 0, 1), (48, 0, 1, 0, 0, 1), (2, 2, 1, 0, 0, 0), (6, 6, 1, 0, 0, 0), (8, 8, 1, 0, 0, 0), (5, 5, 1, 0, 0, 0),
     (9, 9, 1, 0, 0, 0)),
    # the same after short paragraphs, and a row of tags before them
    ((6, 0, 1, 0, 1, 1), (1, 1, 1, 0, 0, 0), (1, 1, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0), (14, 0, 1, 0, 0, 1), (11, 0, 1, 0, 0, 1), (7, 7, 1, 0, 0, 0),
     (10, 10, 1, 0, 0, 0), (6, 6, 1, 0, 0, 0)),
    # article beside unnamed adverts and notices
    ((2, 2, 0, 0, 0, 0), (11, 0, 0, 0, 0, 0), (26, 0, 0, 0, 0, 0), (9, 0, 1, 0, 1, 1), (52, 0, 1, 0, 0, 1), (3, 0, 1, 0, 0, 1), (88, 2, 1, 0, 0, 1),
     (31, 0, 0, 0, 0, 0), (6, 2, 0, 0, 0, 0)),
    # unnamed texts beside a one-paragraph article
    ((60, 0, 0, 0, 0, 0), (4, 0, 0, 0, 1, 0), (18, 0, 1, 0, 0, 1), (45, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)),
    # blog of plain div elements: neither articles nor named containers
    ((1, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (1, 1, 0, 0, 0, 0), (7, 0, 0, 0, 1, 1), (45, 0, 0, 0, 0, 1), (80, 2, 0, 0, 0, 1),
     (12, 0, 0, 0, 0, 1), (38, 0, 0, 0, 0, 1), (4, 4, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (5, 2, 0, 0, 0, 0)),
    # plain page: menu, text, copyright line
    ((2, 2, 0, 0, 0, 0), (3, 3, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0), (28, 0, 0, 0, 0, 1), (33, 1, 0, 0, 0, 1), (9, 0, 0, 0, 0, 1),
     (41, 0, 0, 0, 0, 1), (6, 1, 0, 0, 0, 0), (2, 2, 0, 0, 0, 0)),
    # front page: links with short teasers only
    ((1, 1, 0, 0, 0, 0), (8, 8, 0, 0, 0, 0), (9, 9, 0, 0, 0, 0), (7, 7, 0, 0, 0, 0), (10, 9, 0, 0, 0, 0), (4, 4, 0, 0, 0, 0)),
    # named containers around a plain text
    ((12, 0, 0, 1, 0, 0), (22, 0, 0, 1, 0, 0), (6, 0, 0, 0, 1, 1), (24, 0, 0, 0, 0, 1), (70, 5, 0, 0, 0, 1), (16, 0, 0, 0, 0, 1),
     (30, 0, 0, 1, 0, 0), (65, 3, 0, 1, 0, 0)),
    # paragraphs of an article that are links as a whole, or nearly
    ((5, 0, 1, 0, 1, 1), (3, 2, 1, 0, 0, 1, 1), (3, 3, 1, 0, 0, 1, 1), (40, 2, 1, 0, 0, 1, 1), (8, 8, 1, 0, 0, 1, 1), (4, 4, 1, 0, 0, 1, 1), (22, 22, 1, 0, 0, 1, 1)),
    # short notices in an article, in no container and no paragraph, beside short text that is none
    ((6, 0, 1, 0, 1, 1), (50, 1, 1, 0, 0, 1, 1), (4, 0, 1, 0, 0, 0, 0, 1), (70, 0, 1, 0, 0, 1, 1), (6, 2, 1, 0, 0, 0, 0, 1), (5, 0, 1, 0, 0, 1, 0, 0), (9, 0, 1, 0, 0, 1, 1, 1),
     (12, 0, 1, 0, 0, 1, 1, 0), (7, 0, 1, 0, 0, 1, 0, 0), (3, 3, 0, 0, 0, 0, 0, 1)),
    # paragraphs of an article that only read like notices
    ((6, 0, 1, 0, 1, 1), (50, 1, 1, 0, 0, 1, 1), (3, 0, 1, 0, 0, 1, 1, 1), (70, 0, 1, 0, 0, 1, 1), (4, 0, 1, 0, 0, 1, 1, 1), (3, 0, 1, 0, 0, 1, 1, 1), (6, 1, 0, 1, 0, 0)),
    ((31, 0, 1, 0, 0, 1, 1), (3, 0, 1, 0, 0, 1, 1, 1), (9, 2, 0, 1, 0, 0, 0, 1)),
    # article text in plain div elements and lines of a list
    ((5, 0, 1, 0, 1, 1), (44, 0, 1, 0, 0, 1, 0), (61, 3, 1, 0, 0, 1, 0), (9, 0, 1, 0, 0, 1, 0), (6, 0, 1, 0, 0, 1, 0), (13, 1, 1, 0, 0, 1, 0), (30, 0, 1, 0, 0, 1, 0)),
    ((2, 2, 0, 0, 0, 0), (6, 0, 0, 0, 1, 1), (39, 0, 0, 0, 0, 1, 0), (75, 4, 0, 0, 0, 1, 0), (18, 0, 0, 0, 0, 1, 0), (4, 4, 0, 0, 0, 0), (5, 1, 0, 0, 0, 0, 0, 1)),
    # a form around the whole page, with an article inside
    ((2, 2, 0, .5, 0, 0), (1, 1, 0, .5, 0, 0), (6, 0, 1, .5, 1, 1), (48, 2, 1, .5, 0, 1), (7, 0, 1, .5, 0, 1), (66, 0, 1, .5, 0, 1), (3, 3, 1, .5, 0, 1, 1), (5, 0, 1, .5, 0, 0, 0, 1),
     (9, 2, 0, .5, 0, 0), (20, 1, 1, 1, 0, 0), (14, 3, 0, 1, 0, 0)),
    # the same without an article: menu, text, labels of fields, copyright line
    ((2, 2, 0, .5, 0, 0), (3, 3, 0, .5, 0, 0), (5, 0, 0, .5, 1, 1), (52, 0, 0, .5, 0, 1), (9, 0, 0, .5, 0, 1), (80, 5, 0, .5, 0, 1), (36, 1, 0, .5, 0, 1), (2, 0, 0, .5, 0, 0, 0),
     (1, 0, 0, .5, 0, 0, 0), (6, 1, 0, .5, 0, 0, 0, 1), (2, 2, 0, .5, 0, 0)),
    # a container of a layout name around a blog post in div elements
    ((1, 1, 0, .5, 0, 0), (7, 0, 0, .5, 1, 1), (58, 0, 0, .5, 0, 1, 0), (43, 2, 0, .5, 0, 1, 0), (11, 0, 0, .5, 0, 1, 0), (90, 3, 0, .5, 0, 1, 0), (4, 4, 0, .5, 0, 0), (3, 3, 0, .5, 0, 0),
     (30, 2, 0, 1, 0, 0), (45, 0, 0, 1, 0, 0)),
    # text of one paragraph
    ((26, 0, 0, 0, 0, 1),), ((150, 0, 0, 0, 0, 1),), ((5, 0, 0, 0, 0, 1),), ((9, 0, 1, 0, 0, 1),), ((9, 0, 0, 1, 0, 0),), ((3, 3, 0, 0, 0, 0),),
)
MAX_DEPTH = 9
#: Blocks of so many words, most of them in no link, are prose.
PROSE_WORDS = 8


def labelled_rows() -> list[tuple[tuple[float, ...], int]]:
    rows = []
    for page in LABELLED:
        own = []
        for w, l, m, b, h, kept, *more in page:
            usual = not h and (kept or (w >= PROSE_WORDS and 2 * l < w))
            paragraph, notice = (*more, *(bool(usual), False)[len(more) :])
            own.append(Block("", w, l, bool(m), float(b), bool(h), bool(paragraph), bool(notice)))
        rows += list(zip(features(own), (r[5] for r in page)))
    return rows


def grow(rows: list[tuple[tuple[float, ...], int]], depth: int = MAX_DEPTH):
    """A CART tree by Gini impurity: a label, or (feature, threshold, low, high).

    Of equal splits the first feature and lowest threshold win, so that growing
    is deterministic.
    """
    ones = sum(y for _, y in rows)
    label = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return label

    def impurity(part: list[int]) -> float:
        p = sum(part) / len(part)
        return len(part) * 2 * p * (1 - p)

    best = None
    for f in range(len(FEATURES)):
        values = sorted({x[f] for x, _ in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low = [y for x, y in rows if x[f] <= cut]
            high = [y for x, y in rows if x[f] > cut]
            score = impurity(low) + impurity(high)
            if best is None or score < best[0] - 1e-12:
                best = (score, f, cut)
    if best is None:
        return label
    _, f, cut = best
    low = grow([r for r in rows if r[0][f] <= cut], depth - 1)
    high = grow([r for r in rows if r[0][f] > cut], depth - 1)
    return low if low == high and isinstance(low, int) else (f, cut, low, high)


def predict(tree, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def main_text(page: str, tree) -> tuple[str, int, int]:
    """The article of a page, the number of its blocks, and of those kept."""
    found = blocks(page)
    kept = [b.text for b, x in zip(found, features(found)) if predict(tree, x)]
    return "\n\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: id, url, text, n_chars, n_blocks, n_kept."""
    tree = grow(labelled_rows())
    kind = pages.schema[id_col].dataType.simpleString()
    source = spread(
        pages.select(F.col(id_col).alias("k"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars, n, kept = [], [], [], []
            for value in batch.column(2):
                text, found, good = main_text(value.as_py() or "", tree)
                texts.append(text)
                chars.append(len(text))
                n.append(found)
                kept.append(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *[pa.array(x, pa.int64()) for x in (chars, n, kept)]],
                ["k", "u", "text", "n_chars", "n_blocks", "n_kept"],
            )

    out = map_arrow(source, run, f"k {kind}, u string, text string, n_chars long, n_blocks long, n_kept long")
    return out.withColumnsRenamed({"k": id_col, "u": url})
