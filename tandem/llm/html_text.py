"""Operator 2: main text of web pages.

A page becomes a flat list of text blocks: tags that separate blocks end one, all
other markup only changes the block it is in. Each block has its number of words
and the share of them inside links, and those of the block before and after. A
decision tree, grown on the labelled blocks below, tells the blocks of the article
from menus, notices, forms, comments and the like. Its first `LEADING` questions
are about words and links of a block and its neighbours; only below them it may
ask what encloses the block.

Results: a null, empty or textless page gives the empty text, and an empty table
no rows; broken markup is read as far as it goes: an unclosed comment, script or
tag ends with the page, closing tags without an opening one are skipped, and a
quote opens a value only after an equals sign; repeated rows give repeated
results; other columns than those kept are left out. A very long page needs memory
and time in proportion to its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tandem.llm.shared import arrow_columns

#: Elements whose content is never text of the page, and elements that end a block.
SILENT = frozenset("script style noscript template svg math head title iframe object canvas select option textarea button audio video map".split())
BREAKING = frozenset("address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Enclosing elements, and words of their class, id or role, that speak for or against the article.
OUTSIDE = frozenset("nav aside footer form menu dialog fieldset search".split())
INSIDE = frozenset("article main".split())
AGAINST = frozenset("ad ads adv advert advertisement advertising advertorial alert alerts banner banners branding breadcrumb breadcrumbs byline comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus discussion feedback footer gdpr imprint login logo masthead menu modal nav navbar navigation newsletter notice notices overlay paywall popup promo promotion promoted rail rating ratings recommended related replies reply responses review reviews search share sharing shares sidebar signup skip social sponsor sponsored strip subscribe subscription tags teaser thread toolbar topbar widget widgets".split())
FOR = frozenset("article articlebody body content entry main maincontent post story text".split())
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*+|(?=>)|\Z))*+)(?:>|\Z)", re.S)
#: Pieces of a name by which it tells of something elsewhere or of a state: no-sidebar, has-comments, menu-open.
STATES = frozenset("closed disabled enabled has no open with without".split())
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
#: The end tags of elements whose content holds no other markup.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style")}
_PIECES = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: The first features of a block: words and links of it and its neighbours. So many questions of the tree are about them alone.
TEXTUAL, LEADING = 6, 3


@dataclass(slots=True)
class Block:
    text: str
    at: int
    words: int
    linked: float
    outside: int
    against: int
    inside: int
    headed: int
    heading: int
    item: int


def _attributes(markup: str) -> dict[str, str]:
    """The attributes of a start tag by name, of equal names the first; one without a value has the empty text."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(markup):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _named(attributes: dict[str, str]) -> tuple[int, int, int]:
    """Whether class, id or role speak against the article, for it, and of a header."""
    names = " ".join(attributes[k] for k in ("class", "id", "role") if k in attributes).lower().split()
    if not names:
        return 0, 0, 0
    pieces = {x: {x, *_PIECES.findall(x)} for x in names}
    words = set().union(*pieces.values())
    against = any(not x.isdisjoint(AGAINST) and x.isdisjoint(STATES) for x in pieces.values())
    return int(against), int(not words.isdisjoint(FOR)), int("header" in words)


class Marks:
    """Marks against the article, each with the mark around it; a mark made void takes all around it along."""

    def __init__(self):
        self.around: list[int] = []
        self.void: list[bool] = []

    def add(self, around: int) -> int:
        self.around.append(around)
        self.void.append(False)
        return len(self.around) - 1

    def forgive(self, mark: int) -> None:
        while mark >= 0 and not self.void[mark]:  # what stands around a void mark is void already
            self.void[mark] = True
            mark = self.around[mark]

    def standing(self) -> list[int]:
        """Of each mark, and at the end of none, whether it or one around it stands."""
        out: list[int] = []
        for around, void in zip(self.around, self.void):
            out.append(int(not void or around >= 0 and out[around]))
        return [*out, 0]


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order.

    Names don't speak against the page's own article: those of `html`, `body`, a `main` and all that holds one are void,
    and so are those of an outermost `article` with more than half of the page's words and of all that holds it.
    """
    out: list[Block] = []
    marks, mark_of, articles, words_of = Marks(), [], {}, {}
    pieces: list[tuple[str, bool]] = []
    # Open elements: name, silent, outside, mark, inside, header, heading, item, article; each holds what it adds to those around it.
    stack: list[tuple] = [("", 0, 0, -1, 0, 0, 0, 0, -1)]
    opened: Counter[str] = Counter()
    links, began = 0, 0

    def flush(at: int) -> None:
        nonlocal began
        if pieces:
            text = _SPACE.sub(" ", "".join(html.unescape(x) for x, _ in pieces)).strip()
            if text:
                linked = sum(len(x.split()) for x, link in pieces if link)
                n = len(text.split())
                _, _, outside, mark, inside, headed, heading, item, article = stack[-1]
                out.append(Block(text, began, n, min(1.0, linked / n), outside, 0, inside, headed, heading, item))
                mark_of.append(mark)
                words_of[article] = words_of.get(article, 0) + n
            pieces.clear()
        began = at

    def say(text: str, at: int) -> None:
        nonlocal began
        if text and not stack[-1][1]:
            if not pieces:
                began = at
            pieces.append((text, links > 0))

    def close() -> str:
        nonlocal links
        name = stack.pop()[0]
        opened[name] -= 1
        if name == "a":
            links = max(0, links - 1)
        return name

    position = 0
    while m := _TOKEN.search(page, position):
        name = (m[2] or "").lower()
        say(page[position : m.start()], position)
        position = m.end()
        if not name:
            continue
        if name in BREAKING:
            flush(m.end())
        if m[1]:
            while opened[name] and close() != name:
                pass
            continue
        if name in VOID or m[3].endswith("/") and name not in BREAKING | SILENT:
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack[-1][0] == name:
            close()
        if name == "p":  # a block inside an unclosed paragraph ends it and the marks opened in it
            while opened["p"] and stack[-1][0] not in BREAKING - {"p"}:
                close()
        _, silent, outside, mark, inside, headed, heading, item, article = stack[-1]
        if name in _RAW_END:  # read on at its end tag, if any: what stands before is no markup
            end = _RAW_END[name].search(page, position)
            position = end.start() if end else len(page)
        attributes = _attributes(m[3]) if m[3] else {}
        against_now, for_now, header_now = _named(attributes)
        silent |= int(name in SILENT or "hidden" in attributes or bool(_UNSEEN.search(attributes.get("style", ""))))
        if against_now and name not in ("html", "body"):
            mark = marks.add(mark)
        if name == "main" or attributes.get("role", "").lower() == "main":
            marks.forgive(mark)
        elif name == "article" and article < 0:
            article = m.start()
            articles[article] = mark
        if name in INSIDE or for_now and not against_now and not header_now:
            inside = max(inside, 2 if name == "article" else 1)
        header_now |= int(name == "header")
        stack.append((name, silent, outside | int(name in OUTSIDE or header_now and not inside), mark, inside, headed | header_now, heading | int(len(name) == 2 and name[0] == "h" and name[1].isdigit()), item | int(name in ("li", "td", "th", "dd", "dt")), article))
        opened[name] += 1
        links += name == "a"
    say(page[position:], position)
    flush(len(page))
    for article, mark in articles.items():
        if 2 * words_of.get(article, 0) > sum(words_of.values()):
            marks.forgive(mark)
    standing = marks.standing()
    for block, mark in zip(out, mark_of):
        block.against = standing[mark]
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row a block: words and link density of it, of the one before and the one after, and what encloses it.

    Of the last five the second says how it stands to the innermost kind of container that the page has for its
    article: 0 outside it, 2 inside it, 1 if the page has none.
    """
    own = np.array([[b.words, b.linked] for b in found], np.float64).reshape(-1, 2)
    edge = np.array([[0.0, 1.0]])
    deepest = max((b.inside for b in found if not b.outside | b.against), default=0)
    standing = [1 if not deepest else 2 if b.inside >= deepest else 0 for b in found]
    around = np.array([[b.outside | b.against, k, b.headed * (1 - b.heading), b.heading, b.item] for b, k in zip(found, standing)], np.float64).reshape(-1, 5)
    return np.hstack([own, np.vstack([edge, own[:-1]]) if len(own) else own, np.vstack([own[1:], edge]) if len(own) else own, around])


_LONG = "It was a long walk down to the harbour, and by the time they came to the water the boats had gone out. "
_MID = "Nobody had expected rain that day."
#: Parts of labelled pages: what stands before an article, what stands after it, what is put into it, and what holds it
#: (with pieces that lie beside the article and have no telling name).
BEFORE = [
    "",
    "",
    "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul></nav>",
    f"<header><h1><a href=/>The Gazette</a></h1><p>{_MID}</p></header><div class=ad>{_LONG}</div>",
    "<div><a href=/>Start</a> | <a href=/a>About us</a></div><p>Today is Monday</p>",
    f"<div id=header><div class=logo>Daily Post</div></div><div class=breadcrumb><a href=/>Home</a> &gt; News</div><div class=notice>{_LONG}</div>",
    f"<dialog><p>{_LONG}</p></dialog><div class='cookie-banner'><p>{_LONG}</p></div><ul class=menu><li>One</li><li>Two</li></ul>",
    f"<div class='site-header'><h1>Blog</h1><p>{_LONG}</p></div><form><label>Search</label><p>{_LONG}</p></form>",
    "<span>Menu</span>",
    f"<div class=banner>{_LONG * 2}</div><div id=header>{_MID}</div>",
    f"<div id=top><a href=/1>One</a></div><nav>{_LONG * 3}</nav>",
]
AFTER = [
    "",
    "",
    f"<footer>&copy; The Gazette. {_MID}</footer>",
    f"<section id=comments><h3>3 comments</h3><p>{_LONG * 2}</p><p>{_MID}</p></section><footer><p>{_LONG}</p></footer>",
    "<div>Copyright 2003 by its writer. <a href=/m>Mail</a></div>",
    f"<aside><h2>More</h2><p>{_LONG}</p><a href=/x>On boats</a></aside><div class=footer>{_LONG}</div>",
    "<p><a href=/prev>Older</a> <a href=/next>Newer</a></p><p>All rights reserved</p>",
    f"<div class=related><a href=/r>Read this too</a><p>{_LONG}</p></div><div class=comments><article class=comment><p>{_LONG}</p></article></div>",
    "<div><small>Last change: May</small></div><p><a href=/up>Up</a></p>",
    f"<div class=sidebar><h4>Popular</h4><p>{_LONG * 2}</p><ul><li>Most read</li></ul></div><div id=footer><p>{_MID}</p></div>",
    f"<nav><a href=/1>Next page</a></nav><form><p>{_LONG}</p></form>",
    f"<footer><p>{_LONG}</p><p>{_LONG * 2}</p></footer>",
    f"<aside><p>{_LONG * 3}</p></aside><form><p>{_MID}</p></form>",
    "<div><a href=/t>Terms</a> <a href=/p>Privacy</a></div>",
    f"<article><div class='post-header'><p>Posted on 3 May</p></div></article><div class='respond'><p>{_LONG}</p></div>",
]
INTO = [
    "",
    f"<div class=ad><p>{_LONG}</p></div>",
    f"<aside><p>{_LONG}</p></aside>",
    f"<div class='share'><a href=/s>Share</a></div><div class=newsletter><p>{_MID}</p><p>{_LONG}</p></div>",
    f"<div class='sponsored'>{_LONG}</div><nav><p>{_MID}</p></nav>",
]
HELD = [
    ("", "<article><h1>Rain at the harbour</h1>", "</article>", ""),
    ("", "<main><h1>A day out</h1>", "</main>", ""),
    ("<div>Call us now</div>", "<div id=content><h1>Short title</h1>", "</div>", f"<div><h5>Offers</h5><p>{_LONG}</p></div>"),
    (f"<div><p>{_LONG}</p></div>", "<div class='entry-content'>", "</div>", ""),
    ("<main>", "<article><header><h1>Night train</h1></header>", "</article>", f"<section><h2>What others say</h2><p>{_LONG * 2}</p><p>{_MID}</p></section></main>"),
    ("", "<article><div class='entry-header'><h1>A storm</h1></div><div class='post-body'>", "</div></article>", f"<div><p>{_LONG}</p><p>{_LONG * 3}</p></div>"),
    ("", "<section class='story'><h2>On foot</h2>", "</section>", "<div>Filed at noon</div>"),
]
#: First and second half of an article; those of LOOSE make sense without anything that holds them.
HALVES = [
    (f"<p>{_LONG * 3}</p><p>{_MID}</p><p>Yes.</p>", f"<p>{_LONG}</p>"),
    (f"<p>{_MID}</p>", f"<p>{_LONG * 2}</p><ul><li>Bread</li><li>Two apples and a knife</li></ul><p>No.</p>"),
    (f"<div>{_LONG}</div><div>{_MID}</div>", f"<blockquote>{_MID}</blockquote><p>{_LONG * 2} <a href=/y>the old map</a> {_MID}</p>"),
    (f"<p>{_LONG}</p><p>See <a href=/m>the map of the old harbour and its three bridges</a></p>", f"<h2>Home again</h2><p>{_MID}</p>"),
    ("<p>Hm.</p>", ""),
    (f"<p>{_LONG * 3}</p><p>Yes.</p>", f"<p>{_LONG * 4}</p><p>So.</p><p>It ended.</p>"),
    (f"<p>{_LONG * 6}</p><p>Be it so.</p><p>No.</p>", f"<p>{_LONG * 3}</p><p>And that was it.</p>"),
    ("<p>Four short words here.</p><p>And three more.</p><p>Again five words in it.</p>", "<p>Three short words.</p><p>Four short words here.</p><p>Four more words here.</p>"),
    (f"<table><tr><td>Oslo</td><td>9</td></tr></table><p>{_LONG * 4}</p>", "<p><a href=/only>A linked line</a></p><p>So it went.</p>"),
]
LOOSE = [
    (f"<h1>Plain page</h1><p>{_LONG * 3}</p><p>{_LONG * 2}</p>", f"<p>{_MID} {_LONG}</p>"),
    (f"<h1>A page of old</h1><p>{_LONG * 2}</p><p>{_LONG}</p>", f"<p>{_MID}</p><p>{_LONG * 2}</p>"),
    (f"<font size=5>Letters home</font><br>{_LONG * 2}<br><br>{_LONG}<br>{_MID}<br>So it went.<br>", f"{_LONG * 3}<br>"),
    (f"<h2>On foot</h2><p>{_LONG}</p><p>{_MID}</p><p>{_LONG * 5}</p>", f"<h3>On a bicycle</h3><p>{_MID} {_MID}</p><p>{_LONG * 2}</p>"),
    (f"<p>{_LONG}</p><p>{_LONG * 2}</p>", f"<p>{_LONG}</p>"),
]


def _of(n: int) -> str:
    """A passage of `n` words."""
    return " ".join((_LONG * (n // 20 + 1)).split()[:n]) + "."


def _links(*words: int) -> str:
    return " ".join(f"<a href=/{i}>{_of(n)}</a>" for i, n in enumerate(words))


def plain_pages(n: int) -> list[list[tuple[int, str]]]:
    """Labelled pages of kinds whose names tell nothing, or the wrong thing; `n` sets how long their passages are."""
    items = lambda k, size: "".join(f"<li><a href=/{i}>{_of(size)}</a></li>" for i in range(k))
    teasers = "".join(f"<div class=c{i}><h3><a href=/{i}>{_of(6)}</a></h3><p>{_of(9)} <a href=/{i}>Read on</a></p></div>" for i in range(3))
    body = f"<p>{_of(n)}</p><p>{_of(2 * n)}</p><p>{_of(n // 2)}</p>"
    legal = f"<p>{_links(1, 2, 1, 2)}</p><p>{_of(7)}</p>"
    return [
        [(0, f"<div class=c1><ul>{items(9, 2)}</ul></div>"), (1, f"<div class=c2><h1>{_of(3)}</h1>{body}<pre>{_of(8)}</pre><p>{_of(n)}</p></div>"), (0, f"<div class=c3>{_links(2, 3)}</div>")],
        [(0, f"<div>{_links(1, 1, 1)}</div>"), (1, f"<h1>{_of(2)}</h1><p>{_of(n)} {_links(2, 2)} {_of(n)}</p><p>{_of(n)} {_links(3)} {_of(4)}</p><ul><li>{_of(5)} {_links(2)}</li><li>{_of(7)}</li></ul><p>{_of(n)}</p>"), (0, f"<div>{_links(2, 1, 2, 1)}</div><div>{_of(8)}</div>")],
        [(0, f"<table><tr><td>{_links(1)}</td><td>{_links(1)}</td><td>{_links(2)}</td></tr></table>"), (1, f"<div><h2>{_of(6)}</h2>{body}{body}</div>"), (0, f"<div>{teasers}</div>{legal}")],
        [(0, teasers), (1, f"<div class=c9><h1>{_of(5)}</h1>{body}<h2>{_of(2)}</h2>{body}</div>"), (0, f"<ul>{items(6, 5)}</ul>{legal}")],
        [(0, f"<span>{_of(2)}</span><ul>{items(5, 1)}</ul>"), (1, f"<div class='post review'><h1>{_of(4)}</h1>{body}</div>"), (0, f"<ul>{items(7, 6)}</ul>")],
        [(0, f"<ul>{items(7, 1)}</ul>"), (1, f"<div class='share-story'>{body}<p>{_of(n)}</p></div>"), (0, legal)],
        [(0, f"<p>{_links(1)} &gt; {_links(1)}</p>"), (1, f"<div class=c4><h1>{_of(7)}</h1>{body}</div>"), (0, f"<div class=comments><h3>{_of(2)}</h3><div class=c5><p>{_of(n)}</p></div><div class=c5><p>{_of(2 * n)}</p></div></div>{legal}")],
        [(0, f"<div>{_links(2)}</div>"), (1, f"{body}<p>{_of(3)}</p>{body}"), (0, f"<hr>{_links(1, 1)}<p>{_of(5)}</p>")],
    ]


def labelled_pages() -> list[list[tuple[int, str]]]:
    """The labelled table: pages as pieces of markup, each with 1 if its blocks are of the article; parts meet in turn."""
    pages = []
    for i in range(200):
        beside, start, end, after = HELD[i % 7]
        first, second = HALVES[(i // 7 + i) % 9]
        pages.append([(0, BEFORE[i % 11]), (0, beside), (1, start + first), (0, INTO[i % 5]), (1, second + end), (0, after), (0, AFTER[i * 4 % 15])])
    for i in range(80):
        first, second = LOOSE[i % 5]
        pages.append([(0, BEFORE[i % 11]), (1, f"<div>{first}"), (0, INTO[i % 3]), (1, f"{second}</div>"), (0, AFTER[i * 4 % 15])])
    for n in range(12, 84, 6):
        pages += plain_pages(n)
    return pages


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rows, labels = [], []
    for page in labelled_pages():
        ends = np.cumsum([len(x) for _, x in page])
        found = blocks("".join(x for _, x in page))
        rows.append(features(found))
        labels += [page[int(np.searchsorted(ends, b.at, "right"))][0] for b in found]
    return np.vstack(rows), np.array(labels, np.int64)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 8, leading: int = LEADING) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, tree up to it, tree above it), or the share of ones in a leaf of `least` rows or more.

    The first `leading` questions on each path are about the words and links of the block and its neighbours.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(TEXTUAL if leading > 0 else x.shape[1]):
        values = np.unique(x[:, f])
        for cut in ((values[:-1] + values[1:]) / 2).tolist():
            low = x[:, f] <= cut
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return grow(x, y, depth, least, 0) if leading > 0 else share
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1, least, leading - 1), grow(x[~low], y[~low], depth - 1, least, leading - 1)


def chance(tree: tuple | float, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str, tree: tuple | float) -> str:
    """The blocks of the article, one a line."""
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found).tolist()) if chance(tree, row) >= 0.5)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text: str = "text") -> DataFrame:
    """The columns `keep` of `pages` and the main text of each."""
    tree = grow(*labelled_table())

    def start(_: str) -> Callable:
        return lambda texts: [pa.array([main_text(x, tree) for x in texts], pa.string())]

    return arrow_columns(pages, column, keep, [T.StructField(text, T.StringType())], start, "")
