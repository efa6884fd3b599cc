"""Pages whose marks mislead: what the tree decides by words and links, and a plain reimplementation on the given pages."""

from html.parser import HTMLParser

import pytest

from strandline.llm import html_blocks as hb

TREE = hb.grow(hb.labelled_rows())
LONG = "The committee met again on Tuesday and agreed, after some hours, that the old bridge over the river should be kept and mended."
MORE = "Work will begin in the spring, when the water is low, and the road will be closed to all but walkers until the end of summer."
LAST = "Nobody was hurt when the lower arch fell in the storm of last year, but the mill below it had to be left for some weeks."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>All news</a></li><li><a href=/a>About</a></li></ul>"

PAGES = [
    ("linked paragraphs of an article", "<article><p>No <a href=/1>link only</a></p><p><a href=/2>All linked para</a></p></article>", ["No link only", "All linked para"]),
    *[(f"topics: {c}", f"<div>{MENU}</div><div class='{c}'><p>{LONG}</p><p>{MORE}</p></div>", [LONG, MORE]) for c in ("post tags-news", "post category-social tag-search", "main-widget-area", "content-search-wrap")],
    ("a form around a page with an article", f"<form id=aspnetForm><div class=menu>{MENU}</div><article><h1>A bridge is kept</h1><p>{LONG}</p><p>{MORE}</p></article><div class=footer>Contact us</div></form>", ["A bridge is kept", LONG, MORE]),
    ("a form around a page without one", f"<form action=/>{MENU}<p>{LONG}</p><p>{MORE}</p><p>{LAST}</p><div class='newsletter'>Get our letter every week</div></form>", [LONG, MORE, LAST]),
    ("a form on a page", f"<article><p>{LONG}</p><p>{MORE}</p></article><form><p>Tell us what you think of the new site of the paper.</p></form>", [LONG, MORE]),
    ("notice in an article", f"<article><p>{LONG}</p><div>Subscribe to our newsletter</div><p>{MORE}</p></article>", [LONG, MORE]),
    ("short division that is no notice", f"<article><p>{LONG}</p><div>And so it was done.</div><p>{MORE}</p></article>", [LONG, "And so it was done.", MORE]),
    ("unnamed readers", f"<article><p>{LONG}</p><p>{MORE}</p></article><div class='reader-feedback'><p>{LAST}</p></div>", [LONG, MORE]),
    ("comments are more than half", f"<main><p>{LONG}</p></main><div class='comment-list'><p>{MORE}</p><p>{LAST}</p><p>{MORE}</p></div>", [LONG]),
    ("a sidebar of much text", f"<div class=sidebar><p>{MORE} {LAST} {MORE}</p></div><article><p>{LONG}</p></article>", [LONG]),
    ("footers by place", f"<article><p>{LONG}</p></article><div class='site-footer-wrap'><p>{MORE}</p></div><div class='footer-links'><p>{LAST}</p></div>", [LONG]),
]


@pytest.mark.parametrize("name, html, want", PAGES, ids=[p[0] for p in PAGES])
def test_pages(name, html, want):
    assert hb.main_text(html, TREE)[0] == "\n\n".join(want)


def test_words_and_links_change_verdicts():
    """In one and the same container, blocks of equal marks: which stay depends on their words and on those around them."""
    html = f"<form action=/>{MENU}<div>{LONG}</div><div>{MORE}</div><div>Name</div><div>{LAST}</div>{MENU}</form>"
    found = hb.blocks(html)
    marks = {(b.main, b.boiler, b.heading, b.paragraph, b.notice) for b in found}
    kept = hb.main_text(html, TREE)[0]
    assert len(marks) == 1 and LONG in kept and "Home" not in kept and kept.count("\n\n") == 2
    x = [hb.features([hb.Block("", w, l, False, 0.5, False) for w, l in page])[1] for page in (((60, 2), (9, 0), (70, 1)), ((1, 1), (9, 7), (2, 2)))]
    assert [hb.predict(TREE, v) for v in x] == [1, 0]


class Plain(HTMLParser):
    """Blocks by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [("", False, (), False)]  # name, in main, containers (kind, soft, [words, holds main]), in a link
        self.out, self.text, self.links, self.skip, self.heading = [], "", "", "", False

    def flush(self):
        words = self.text.split()
        if words:
            name, main, own, _ = self.stack[-1]
            notice = len(words) <= 15 and bool(hb.NOTICE.search(" ".join(words)))
            p = name == "p" or (name == "a" and self.stack[-2][0] == "p")
            self.out.append((hb.Block(" ".join(words), len(words), len(self.links.split()), main, 0.0, self.heading, p, notice), own))
            for c in own:
                c[2][0] += len(words)
        self.text = self.links = ""

    def handle_data(self, data):
        if not self.skip:
            self.text += data
            self.links += data if self.stack[-1][3] else ""

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in hb.RAW_TAGS:
            self.skip = tag
            return
        block = tag in hb.BLOCK_TAGS
        if block:
            self.flush()
            self.heading = tag in hb.HEADINGS
        elif tag in hb.SPACE_TAGS:
            self.text += " "
        if tag in hb.VOID_TAGS:
            return
        if block and self.stack[-1][0] == "p":
            self.stack.pop()
        while tag == "a" and self.stack[-1][0] == "a":
            self.stack.pop()
        _, main, own, link = self.stack[-1]
        said = " ".join(f'{k}="{v or ""}"' for k, v in attrs)
        kind, soft = hb._container(tag, said, main or tag in hb.MAIN_TAGS)
        new = own
        if tag in hb.MAIN_TAGS:
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id"))
            if not main and hb._named(names, True)[0] == hb.TEXT:
                for c in own:
                    c[2][1] = True
                while new and new[-1][0] == hb.LAYOUT:
                    new = new[:-1]
            main = True
        if kind:
            new = (*new, (kind, soft, [0, False]))
        if block or tag == "a" or new != own:
            if new != own:
                self.flush()
            self.stack.append((tag, main, new, link or tag == "a"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.skip = ""
                if tag in ("textarea", "iframe", "title"):
                    self.flush()
            return
        if tag in hb.BLOCK_TAGS:
            self.flush()
            self.heading = False
        if tag in hb.VOID_TAGS or tag in hb.SPACE_TAGS:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if self.stack[k - 1][1:3] != self.stack[-1][1:3]:
                    self.flush()
                del self.stack[k:]
                break


def plain(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    parser.flush()
    whole = sum(b.words for b, _ in parser.out)
    for b, own in parser.out:
        b.boiler = max((0.5 if c[2][0] > whole / 2 and (c[1] or (c[2][1] and c[0] == hb.BOILER)) else 1.0 for c in own), default=0.0)
    page = [b for b, _ in parser.out]
    has = any(b.main and b.boiler < 1 for b in page)
    kept = []
    for i, b in enumerate(page):
        x = []
        for j in (i, i - 1, i + 1):
            near = page[j] if 0 <= j < len(page) else None
            x += [near.words, near.link_words / near.words] if near else [0.0, 0.0]
        x += [b.main, has and not b.main, b.boiler, b.heading, b.paragraph, b.notice]
        if hb.predict(TREE, tuple(map(float, x))):
            kept.append(b.text)
    return "\n\n".join(kept)


def test_given_pages_by_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in hb.extract(pages).collect()}
    want = {r.page_id: plain(r.html or "") for r in pages.collect()}
    different = [k for k in want if got[k] != want[k]]
    assert not different, (len(different), len(want), different[:5])
    for name, html, text in PAGES:
        assert plain(html) == "\n\n".join(text), name
