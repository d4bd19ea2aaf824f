"""Main text of HTML pages: flat text blocks, their word count and link density and those of their neighbours, classified
by a decision tree that is trained on a small labelled table.

A page is read as a flat sequence of text blocks; any block-level tag ends one. A block is described by numbers: its words
and share of linked words, those of the blocks before and after it, the words of its container, whether it ends a
sentence or is a heading, and whether HTML's own elements (article, main; nav, aside, footer ...) enclose it. Names in
class, id and role are one weak feature among these. The tree is grown by Gini impurity from LABELLED, where the attribute
data-main marks what is main text, and from pages that labelled_pages() composes, some without any names or enclosing
elements, some with misleading ones.

Null html and pages without main text give the empty text. Unclosed and stray tags are tolerated; no byte of a page is
looked at more than a fixed number of times, so text of any length is read whole in linear time. Repeated rows are extracted
row by row. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Fixed values of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article aside body button details dialog div dl fieldset figure footer form head header main menu nav ol section select table td title ul".split())
RAW_TAGS = frozenset("iframe noembed noframes noscript object script style svg template textarea xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Elements, roles and parts of class or id names that stand for furniture.
FURNITURE_TAGS = frozenset("aside button dialog fieldset footer form head menu nav select title".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer header "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted recommended related replies reply respond "
    "share sharing sidebar sidenav signup skip social sponsor sponsored subscribe teaser toc toolbar topbar widget".split()
)

_attribute = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_special = re.compile(r"""[>"']""")
_tag_name = re.compile(r"/?[A-Za-z][^\s/>]*+")
_name_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_hidden_style = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    landmark: bool
    named: bool
    hidden: bool
    heading: bool
    box: int
    marked: bool = False


@dataclass
class _Open:
    tag: str
    main: bool
    landmark: bool
    named: bool
    hidden: bool
    marked: bool
    box: int


@dataclass
class _Page:
    """What has been read so far: finished blocks, the open containers and the pending text."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, False, False, False, False, 0)])
    open_tags: Counter = field(default_factory=Counter)
    boxes: int = 0
    parts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    in_link: bool = False
    heading: bool = False
    #: what a paragraph, heading or list item says of itself
    own: _Open | None = None

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            self.parts.append(text)
            if self.in_link:
                self.links.append(text)

    def end_block(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                at = self.own or self.stack[-1]
                self.blocks.append(Block(" ".join(words), len(words), len("".join(self.links).split()), at.main, at.landmark, at.named, at.hidden, self.heading, self.stack[-1].box, at.marked))
        self.parts, self.links = [], []

    def enter(self, tag: str, attributes: str) -> None:
        self.boxes += 1
        self.stack.append(_kind(tag, attributes, self.stack[-1], self.boxes))
        self.open_tags[tag] += 1

    def leave(self, tag: str) -> None:
        """Closes the innermost container of that tag with all that is open in it; a stray end tag does nothing."""
        while self.open_tags[tag]:
            last = self.stack.pop().tag
            self.open_tags[last] -= 1
            if last == tag:
                break


def _kind(tag: str, attributes: str, above: _Open, box: int) -> _Open:
    """The container that a tag opens. What is furniture stays so within; a page header isn't, inside the main text."""
    main, landmark = tag in ("article", "main"), tag in FURNITURE_TAGS or (tag == "header" and not above.main)
    named = hidden = marked = False
    if attributes.strip():
        for m in _attribute.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                parts = {p.lower() for p in _name_part.findall(value)}
                if tag not in ("body", "html"):
                    named |= not parts.isdisjoint(FURNITURE_NAMES) and not (above.main and parts <= {"header", "article", "entry", "post"})
            elif key == "role":
                landmark |= value.lower() in FURNITURE_ROLES
                main |= value.lower() in ("main", "article")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _hidden_style.search(value)):
                hidden = True
            elif key == "data-main":
                marked = True
    return _Open(tag, above.main or main, above.landmark or landmark, above.named or named, above.hidden or hidden, above.marked or marked, box)


class _Scanner:
    """Finds the ends of tags. Where a search failed it is never repeated, so that all searches together are linear."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.none_from: dict[str, int] = {}
        self.dead: set[int] = set()  # quotes from which no end of a tag is reached

    def find(self, what: str, at: int) -> int:
        if at >= self.none_from.get(what, self.n + 1):
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.none_from[what] = at
        return i

    def tag_end(self, at: int) -> int:
        """The > that ends a tag whose name ends at `at`: outside of quotes if there is such, else the next one; or -1."""
        seen, p = [], at
        while self.find(">", p) >= 0:
            m = _special.search(self.page, p)
            if m[0] == ">":
                return m.start()
            if m.start() in self.dead:
                break
            seen.append(m.start())
            p = self.find(m[0], m.end()) + 1
            if not p:
                break
        self.dead.update(seen)
        return self.find(">", at)


def _next_tag(scan: _Scanner, at: int) -> tuple[int, int, str, str] | None:
    """(start, end, name, attributes) of the next tag, declaration or comment; the latter two have no name."""
    page = scan.page
    while (start := scan.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = scan.find("-->", start + 4)
            return start, scan.n if end < 0 else end + 3, "", ""
        end = scan.find(">", start)
        if end < 0:
            rest = scan.find("<!--", start)
            return None if rest < 0 else (rest, scan.n, "", "")
        if page[start + 1 : start + 2] in ("!", "?"):
            return start, end + 1, "", ""
        m = _tag_name.match(page, start + 1)
        if m:
            end = scan.tag_end(m.end())
            if end >= 0:
                return start, end + 1, m[0], page[m.end() : end]
        at = start + 1
    return None


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in page order."""
    state, at, scan = _Page(), 0, _Scanner(page)
    text_from = 0
    while (found := _next_tag(scan, at)) is not None:
        start, at, name, attributes = found
        state.add(page[text_from:start])
        text_from = at
        if not name:
            continue
        closing, tag = name[0] == "/", name.lstrip("/").lower()
        if tag in RAW_TAGS:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                at = text_from = end.end() if end else scan.n
            continue
        if tag == "a":
            state.in_link = not closing
        elif tag == "br":
            state.add(" ")
        if tag not in BLOCK_TAGS:
            continue
        state.end_block()
        state.in_link, state.own = False, None
        if tag[0] == "h" and tag[1:].isdigit():
            state.heading = not closing
        elif tag != "hr":
            state.heading = False
        if tag in CONTAINERS:
            if closing:
                state.leave(tag)
            elif tag not in VOID_TAGS:
                state.enter(tag, attributes)
        elif not closing and attributes.strip():
            state.own = _kind(tag, attributes, state.stack[-1], state.stack[-1].box)
    state.add(page[text_from:])
    state.end_block()
    return [b for b in state.blocks if not b.hidden]


#: The columns of the table that the tree is grown from.
FEATURES = (
    *("words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "most_near_words"),
    *("box_words", "box_link_density", "ends_sentence", "heading", "in_main", "in_landmark", "named", "page_has_main"),
)
_sentence_end = re.compile(r"[.!?…。！？:][\"'”’»)]*$")


def features(page: list[Block]) -> np.ndarray:
    n = len(page)
    words = np.array([b.words for b in page], float)
    linked = np.array([b.linked for b in page], float)
    density = linked / np.maximum(words, 1)
    before, after = np.r_[0.0, words[:-1]], np.r_[words[1:], 0.0]
    d_before, d_after = np.r_[0.0, density[:-1]], np.r_[density[1:], 0.0]
    near = np.max([np.r_[np.zeros(k), words * (density < 0.3)][:n] if k >= 0 else np.r_[words * (density < 0.3), np.zeros(-k)][-k:][:n] for k in (-3, -2, -1, 1, 2, 3)], axis=0)
    _, box = np.unique([b.box for b in page], return_inverse=True)
    in_box, linked_in_box = np.bincount(box, words)[box], np.bincount(box, linked)[box]
    ends = np.array([_sentence_end.search(b.text[-8:]) is not None for b in page], float)
    flags = np.array([(b.heading, b.main, b.landmark, b.named) for b in page], float).reshape(n, 4)
    has_main = np.full(n, float(any(b.main and not b.landmark for b in page)))
    return np.column_stack([words, density, before, d_before, after, d_after, near, in_box, linked_in_box / np.maximum(in_box, 1), ends, flags, has_main])


# The small labelled table, as pages: blocks under data-main are main text, the others are not.
LABELLED = (
    """<html><head><title>Harbour news</title></head><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav>
    <div class=ad>Buy two lamps today and get the third one free of charge.</div><article data-main><h1>Old harbour opens again</h1>
    <p>The old harbour was opened again on Sunday after three years of work on its walls, and many people came to see it.</p><p>It rained.</p>
    <p>Boats may enter from <a href=/m>next Monday</a> on, said the town, which paid for most of the work itself this time.</p></article>
    <footer>Copyright by the harbour paper, all rights reserved. <a href=/i>Imprint</a></footer></body></html>""",
    """<body><header><h1><a href=/>Garden site</a></h1><p>All about plants and how they grow in small gardens near you</p></header>
    <main data-main><h2>Roses</h2><p>Cut them in spring.</p><p>Roses want sun and a deep soil, and they thank you for compost in early summer and for water.</p>
    <ul><li>Water twice a week</li><li>Cut in March</li></ul></main>
    <aside><h3>Related</h3><p>Tulips need a cold winter before they show flowers, as you can read in last year's long article.</p></aside>
    <section class=comments><p>Anna: I cut mine in autumn and they were fine, thank you for the article, it was very helpful to me.</p></section></body>""",
    """<body><div id=menu><a href=/a>One</a> <a href=/b>Two</a> <a href=/c>Three</a></div><div>
    <p data-main>There is no marked article on this old page, but its long paragraphs tell quite well where the text stands, as here.</p>
    <p data-main>A second long paragraph follows the first one, with one <a href=/x>link</a> among its many words, and it goes on for a while.</p>
    <p data-main>A third paragraph ends the text of this page with some more words than are usual in a menu or in a footer line.</p></div>
    <p><a href=/1>Back</a> | <a href=/2>Top</a> | <a href=/3>Print</a></p><p>Last change 2001</p></body>""",
    """<body><div class=cookie-notice><p>We use cookies to make this page work and to count how often it is read by people like you.</p><button>Agree</button></div>
    <form><p>Write your address to get our letter every week without any cost for you and your friends.</p><input></form>
    <article data-main><header><h1>Night trains</h1></header><p>Night trains are back.</p><p>Ok.</p><blockquote>They never left us.</blockquote>
    <p>More lines than ten years ago are planned for the coming year, and tickets are sold out long before the summer.</p></article>
    <div class=sidebar><p>Most read: how we crossed the country by bus in nine days with two children and a dog.</p></div></body>""",
    """<body><ul><li><a href=/a>First thing to read</a></li><li><a href=/b>Second thing to read</a></li><li><a href=/c>Third one</a></li></ul>
    <p data-main>Words of a page that has lists of links before and after its text and nothing else to tell one from the other by name.</p>
    <p data-main>The text has a second paragraph, because texts mostly do, and this one is as long as the first one was before it.</p>
    <ul><li><a href=/d>See this too</a></li><li><a href=/e>And this</a></li></ul><p>Page 3 of 7</p></body>""",
    """<body><div class=content><div class=promo>Only now: a year of reading for the price of a month, cancel at any time you like.</div>
    <h1 data-main>Bread</h1><p data-main>Flour, water, salt.</p><p data-main>Let the dough rest for a night in a cool place, then bake it hot and long until it sounds hollow.</p>
    <div class=share><a href=/s>Share</a> <a href=/t>Send</a></div></div><footer><p>Bread pages since 1999, made by people who like to eat and bake.</p></footer></body>""",
    """<body><nav><a href=/>Home</a></nav><article data-main><h1>Short notes</h1><p>A note.</p><p><a href=/w>See the whole list of notes here</a></p>
    <p>Another one that ends the page.</p></article></body>""",
    """<body><p>Log in</p><article data-main><p>Fog.</p><h2>Later</h2><p>Sun</p></article></body>""",
    """<body><p data-main>A page may be nothing but one long paragraph without any container, which then of course is its text.</p></body>""",
    """<html><head><title>A very long title that repeats what the page says and then goes on with the name of the site, the section, the day and the place</title></head>
    <body><div class=banner><p>This long banner tells all readers at great length that the shop is closed on the coming holiday and opens again on the day after it.</p></div>
    <main data-main><h1>On long banners</h1><p>They hide.</p><p>Nobody reads long banners to the end, as many studies have shown by following the eyes of people who look at pages on a screen.</p></main>
    <footer><p>This footer is longer than most because the law of some countries wants the full name, the address and the tax number of who runs a page.</p></footer></body></html>""",
    """<body><article><div data-main><h1>Lakes</h1><p>Lakes freeze from above.</p><p>Fish live on below the ice, where the water stays at four degrees all winter long in lakes that are deep enough.</p></div>
    <div class=ad>Ice skates for the whole family, sharpened for free in the first year, at all our shops near the lakes of the north.</div>
    <p data-main>In spring the ice breaks with a noise that can be heard from far away.</p><div class=newsletter><p>Get more about lakes by mail.</p></div>
    <section id=comments><h3>Comments</h3><p>Ben: I have heard it once, it is like thunder under the ground, and I will never in my life forget it, I was ten years old.</p><p>Nice</p></section>
    <div class=related><ul><li><a href=/1>Rivers</a></li><li><a href=/2>Seas</a></li></ul></div></article></body>""",
    """<body><div class=sidebar><p>Our authors write about water in all its forms, and have done so for twenty years in this place, with the help of many readers.</p></div>
    <div><p data-main>Water boils sooner on mountains, since the air is thinner there, and so potatoes take a longer time to get soft up there.</p>
    <p data-main>With a lid under pressure the water gets hotter than at the sea, and the same potatoes are done in a third of the time.</p></div>
    <div class="cookie consent"><p>By reading on you accept that we store small files on your machine, which is needed for the working of this page, as we say.</p></div></body>""",
)


_SYLLABLES = "ba de fi go lu ma ne pi ro su ta ve wi zo ka len mor tis und rel".split()


def _prose(rng: random.Random, words: int) -> str:
    """Invented words in sentences; only their number and marks matter."""
    out = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 3))) for _ in range(max(words, 1))]
    for i in range(rng.randint(5, 14), words - 1, 12):
        out[i] += rng.choice((".", ",", "."))
    return " ".join(out).capitalize() + "."


def _links(rng: random.Random, n: int) -> str:
    one = lambda: f"<a href=/x>{_prose(rng, rng.randint(1, 4))[:-1]}</a>"
    if rng.random() < 0.5:
        return "<ul>" + "".join(f"<li>{one()}</li>" for _ in range(n)) + "</ul>"
    return f"<p>{' | '.join(one() for _ in range(n))}</p>"


def labelled_pages(n: int = 720, seed: int = 11) -> list[str]:
    """Pages composed by a rule, with data-main on their main text: with HTML's own elements, with named containers, with
    plain ones, and with names that mislead."""
    rng, out = random.Random(seed), []
    out += [f"<body><p>{_prose(rng, rng.randint(1, 4))[:-1]}</p></body>" for _ in range(n // 48)]  # "Loading" and the like
    for i in range(n):
        style = ("elements", "names", "plain", "misleading")[i % 4]
        box = {"elements": "nav aside footer aside section".split(), "names": 5 * ["div"], "plain": 5 * ["div"], "misleading": 5 * ["div"]}[style]
        name = lambda k: f" class={rng.choice(k.split())}" if style == "names" else ""
        title = f"<h1>{_prose(rng, rng.randint(2, 8))[:-1]}</h1>" if rng.random() < 0.8 else ""
        body = []
        top = rng.choice((9, 35, 120)) if style == "elements" else 120
        short = top < 120  # then only what encloses the text tells
        for j in range(rng.randint(1 if short else 2, 7)):
            length = rng.randint(1, top) if short else rng.randint(1, 7) if (j and rng.random() < 0.3) else rng.randint(18, top)
            text = _prose(rng, length).replace(" ", " <a href=/y>", 1).replace(" ", "</a> ", 2) if rng.random() < 0.1 and length > 30 else _prose(rng, length)
            body.append(f"<{'p' if rng.random() < 0.9 else 'blockquote'}>{text}</p>")
            if rng.random() < 0.15:
                body.append(f"<h2>{_prose(rng, rng.randint(1, 5))[:-1]}</h2>")
                body.append(f"<p>{_prose(rng, rng.randint(1, top) if short else rng.randint(20, 60))}</p>")
        advert = lambda: f"<div{' class=ad' if style in ('names', 'elements') else ''}>{_prose(rng, rng.randint(4, 30))}</div>"
        if rng.random() < 0.3:
            body.insert(rng.randint(1, len(body)), f"</SPLIT>{advert()}<SPLIT>")
        inner = "".join([title, *body])
        open_main, close_main = {"elements": ("<article data-main>", "</article>"), "names": ("<div class=story data-main>", "</div>"), "plain": ("<div data-main>", "</div>"), "misleading": ("<div class='has-sidebar promo-theme' data-main>", "</div>")}[style]
        if "SPLIT" in inner:  # an advert between paragraphs: the enclosing element stays, the parts are marked
            shell = open_main.replace(" data-main", "")
            inner = inner.replace("</SPLIT>", "</div>").replace("<SPLIT>", "<div data-main>")
            main = f"{shell}<div data-main>{inner}</div>{close_main}"
        else:
            main = open_main + inner + close_main
        parts = [f"<{box[0]}{name('menu nav topbar')}>{_links(rng, rng.randint(3, 8))}</{box[0]}>"]
        if rng.random() < 0.6:
            parts.append(advert())
        if rng.random() < 0.3 and style != "misleading":
            parts.append(f"<{box[3]}{name('cookie notice')}><p>{_prose(rng, rng.randint(8, 25))}</p><button>{_prose(rng, 1)}</button></{box[3]}>")
        parts.append(main)
        if rng.random() < 0.4:
            parts.append(f"<{box[1]}{name('sidebar related')}><h3>{_prose(rng, 2)[:-1]}</h3>{_links(rng, rng.randint(3, 6))}</{box[1]}>")
        if rng.random() < 0.4 and style == "elements":
            other = rng.choice(("aside", "form", "footer"))
            parts.insert(rng.randint(0, len(parts)), f"<{other}>{''.join(f'<p>{_prose(rng, rng.randint(2, 70))}</p>' for _ in range(rng.randint(1, 3)))}</{other}>")
        if rng.random() < 0.3 and style in ("elements", "names"):
            parts.append(f"<section class=comments><p>{_prose(rng, rng.randint(3, 40))}</p><p>{_prose(rng, rng.randint(3, 40))}</p></section>")
        parts.append(f"<{box[2]}{name('footer copyright')}>&copy; {_prose(rng, rng.randint(3, 40 if style == "elements" else 22))}{' <a href=/i>Imprint</a>' if rng.random() < 0.5 else ''}</{box[2]}>")
        head = f"<head><title>{_prose(rng, rng.randint(2, 20))}</title></head>" if rng.random() < 0.7 else ""
        out.append(f"<html>{head}<body>{''.join(parts)}</body></html>")
    return out


@dataclass(frozen=True)
class Tree:
    """An inner node asks whether feature <= bound; a leaf has feature -1 and the share of main blocks in `share`."""

    feature: int
    bound: float
    share: float
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.share)
        left = x[:, self.feature] <= self.bound
        out = np.empty(len(x))
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 2) -> Tree:
    """A binary decision tree by Gini impurity; of equal splits the first feature and the lowest bound."""
    n, share = len(y), float(y.mean())
    best: tuple[float, int, float] | None = None
    if depth and 0 < share < 1 and n >= 2 * least:
        left = np.arange(1, n)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            a, b = hits[:-1], hits[-1] - hits[:-1]
            impurity = a * (1 - a / left) + b * (1 - b / (n - left))
            ok = (v[1:] > v[:-1]) & (left >= least) & (n - left >= least)
            if ok.any():
                i = int(np.where(ok, impurity, np.inf).argmin())
                if best is None or impurity[i] < best[0] - 1e-9:
                    best = (float(impurity[i]), f, float((v[i] + v[i + 1]) / 2))
    if best is None:
        return Tree(-1, 0.0, share)
    low = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], share, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def grow_from(pages: list[str]) -> Tree:
    read = [blocks(p) for p in pages]
    return grow(np.vstack([features(p) for p in read]), np.array([float(b.marked) for p in read for b in p]))


@functools.cache
def default_tree() -> Tree:
    return grow_from([*LABELLED, *labelled_pages()])


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every row of pages, without a shuffle."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x, tree) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").toDF(id_col, url_col, "text", "n_chars")
