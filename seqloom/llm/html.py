"""Main text of web pages: flat blocks, described by their and their neighbours' words and links, judged by a decision tree."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML elements are.
CONTAINERS = frozenset(
    "address article aside blockquote body center dd details dialog div dl fieldset figure footer form header hgroup html main menu nav ol section summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt pre hr figcaption caption legend option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("script style noscript template svg iframe object select textarea button canvas title head audio video annotation annotation-xml".split())
RAW = frozenset("script style textarea title".split())  # no markup in them
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript object script style template title".split())
ONCE = frozenset("button select noscript iframe".split())  # not within themselves: the next one's start shows that one was left open
FOREIGN = frozenset("svg annotation".split())  # HTML's own blocks end these, but for those in a guest
GUESTS = frozenset("foreignobject desc".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer header form menu dialog fieldset".split())
MAIN = frozenset("article main".split())

# Words in class, id and role that name page furniture and reader comments; some name it less surely, and not beside a word for content.
FURNITURE_WORDS = frozenset(
    """ad ads advert adverts advertise advertisement advertising breadcrumb breadcrumbs comment comments commentlist consent cookie
    cookies copyright disqus footer masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup
    promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription
    toolbar widget widgets complementary contentinfo gdpr teaser""".split()
)
PERHAPS_WORDS = frozenset("alert banner header login search".split())
CONTENT_WORDS = frozenset("article body content entry main post results story text".split())
LAYOUT_WORDS = frozenset("has is no with without".split())  # what follows them lies elsewhere
_COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
_ADVERT_WORDS = frozenset("ad ads advert adverts advertise advertisement advertising promo promotion sponsor sponsored".split())
# Words that beside one of furniture only name its part or kind.
_LAYOUT_PARTS = frozenset(
    """area articles bar block body bottom box button buttons card cards col column container content cta field fields form group header heading
    icon icons inline inner item items label left link links list media menu module more msg outer panel post posts read reading right row section sections slot
    small stories story text thread title top tray unit up wrap wrapper""".split()
)
_PARTS_OF_FURNITURE = FURNITURE_WORDS | PERHAPS_WORDS | _LAYOUT_PARTS

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*')*+)(?:>|\Z|["'][^>]*(?:>|\Z))""",
    re.DOTALL,
)
_PAGE_BEGINS = re.compile(r"</head\b|<(?:body|main|article)\b", re.IGNORECASE)
_BLOCK_OR_END = re.compile(rf"</[a-z]|<(?:body|{'|'.join(sorted((CONTAINERS | LEAVES) - {'option', 'legend'}))})\b", re.IGNORECASE)
_CLOSING = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}
_HINT = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?i)(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""")
_WORDS = re.compile(r"[a-z]+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    hint: int  # 0 no page furniture, 1 perhaps, 2 surely, by the ancestor that says most
    inside: bool  # within an article or main element


class Open(NamedTuple):
    """An open container: what it and those around it say of their text; ``frames`` are numbers of elements that condemn it unless they hold the page."""

    tag: str
    hint: int
    inside: bool
    frames: tuple[int, ...]


class Flattener:
    """Blocks of a page in its order; inline elements and line breaks do not end a block."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Open] = [Open("", 0, False, ())]
        self.opened: Counter[str] = Counter()
        self.leaf: tuple[str, int] = ("", 0)
        self.text: list[str] = []
        self.linked: list[str] = []
        self.anchor: tuple[int, bool] | None = None  # the depth where a link begins, and whether within a leaf
        self.of: list[tuple[int, ...]] = []  # frames of each block
        self.frame_words: list[int] = []
        self.is_form: list[bool] = []
        self.holds_page: list[bool] = []  # whether a frame has a main element or a heading of the first level in it

    def flush(self) -> None:
        text = " ".join(unescape("".join(self.text)).split()) if self.text else ""
        if text:
            _, hint, inside, frames = self.stack[-1]
            linked = len(unescape("".join(self.linked)).split())
            words = len(text.split())
            self.blocks.append(Block(text, words, min(linked, words), self.leaf[0] in HEADINGS, max(hint, self.leaf[1]), inside))
            self.of.append(frames)
            for frame in frames:
                self.frame_words[frame] += words
        self.text, self.linked = [], []

    def run(self, html: str) -> list[Block]:
        at, end = 0, len(html)
        ends = Ends(html)
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self._words(html[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag in DROPPED:
                if not m[1] and not m[3].rstrip().endswith("/"):
                    if tag in RAW:
                        at = ends.raw(tag, at)
                    elif tag == "head":
                        at = ends.head(at)
                    else:
                        at = ends.dropped(m.start(), at)
                self.text.append(" ")
            elif m[1]:
                self._close(tag)
            else:
                self._open(tag, m[3])
        if at < end:
            self._words(html[at:])
        self.flush()
        whole = sum(b.words for b in self.blocks)
        frames = [2 * words > whole and page for words, page in zip(self.frame_words, self.holds_page, strict=True)]
        self.blocks = [b if all(frames[i] for i in of) else b._replace(hint=2) for b, of in zip(self.blocks, self.of, strict=True)]
        return self.blocks

    def _words(self, text: str) -> None:
        self.text.append(text)
        if self.anchor:
            self.linked.append(text)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.anchor = (len(self.stack), bool(self.leaf[0]))
        elif tag == "br":
            self.text.append(" ")
            self.linked.append(" ")
        elif tag in CONTAINERS:
            self._end_leaf()
            _, hint, inside, frames = self.stack[-1]
            said = NOTHING if tag in ("html", "body") else _said(tag, attributes, inside)
            if tag == "main":
                for frame in frames:
                    self.holds_page[frame] = True
                frames = ()
            if tag in MAIN and said == NOTHING:
                hint, inside = hint if hint == 2 else 0, True
                frames = tuple(frame for frame in frames if not self.is_form[frame])
            elif said == FRAME and len(frames) < MOST_FRAMES:
                frames = (*frames, len(self.frame_words))
                self.frame_words.append(0)
                self.is_form.append(tag == "form")
                self.holds_page.append(False)
            else:
                hint = max(hint, min(said, 2))
            self.stack.append(Open(tag, hint, inside, frames))
            self.opened[tag] += 1
        elif tag in LEAVES:
            self._end_leaf()
            self.leaf = (tag, min(_said(tag, attributes, self.stack[-1].inside), 2))
            if tag == "h1" and not self.leaf[1]:
                for frame in self.stack[-1].frames:
                    self.holds_page[frame] = True

    def _close(self, tag: str) -> None:
        if tag == "a":
            self.anchor = None
        elif tag in CONTAINERS:
            if self.opened[tag]:
                self._end_leaf()
                while True:
                    last = self.stack.pop().tag
                    self.opened[last] -= 1
                    if last == tag:
                        break
                if self.anchor and self.anchor[0] > len(self.stack):
                    self.anchor = None
        elif tag in LEAVES:
            self._end_leaf()

    def _end_leaf(self) -> None:
        """A link that began within a leaf ends with it; one around blocks goes on in them."""
        self.flush()
        self.leaf = ("", 0)
        if self.anchor and self.anchor[1]:
            self.anchor = None


class Ends:
    """Where elements without text end, each page being searched a bounded number of times however its markup is."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.next: dict[str, int] = {}
        self.table: dict[int, int] | None = None

    def _next(self, what: str, pattern: re.Pattern[str], at: int) -> int:
        """Where the pattern is found next, or the end of the page and one; looked for once for all places before it."""
        if self.next.get(what, -1) < at:
            found = pattern.search(self.html, at)
            self.next[what] = found.start() if found else len(self.html) + 1
        return self.next[what]

    def raw(self, tag: str, at: int) -> int:
        """Where an element without markup ends: at its closing tag, a title also where the page begins, an unclosed text field at the next block or end of an element."""
        end = len(self.html)
        close = self._next(tag, _CLOSING[tag], at)
        if tag == "title":
            close = min(close, self._next("page", _PAGE_BEGINS, at))
        elif tag == "textarea" and close > end:
            close = self._next("block", _BLOCK_OR_END, at)
        return min(close, end)

    def head(self, at: int) -> int:
        """Where the head ends: at its closing tag, or before a text or an element that cannot stand in it."""
        while m := _TOKEN.search(self.html, at):
            tag = (m[2] or "").lower()
            if self.html[at : m.start()].strip(" \t\n\r\f\ufeff"):
                return at
            if m[1] and tag in ("head", "body", "html"):
                return m.end() if tag == "head" else m.start()
            if tag and not m[1] and tag not in IN_HEAD:
                return m.start()
            at = m.end()
            if tag and not m[1] and not m[3].rstrip().endswith("/"):
                if tag in RAW:
                    at = self.raw(tag, at)
                elif tag in DROPPED:
                    at = self.dropped(m.start(), at)
        return at

    def dropped(self, begin: int, at: int) -> int:
        """Where an element without text that begins at ``begin`` ends: after its closing tag, or, if it was left open, before the first block in it.

        It was left open if what stands around it is closed before it, or if a
        tag comes that cannot stand in it. Without a block it ends there.
        """
        if self.table is None:
            self.table = self._all_dropped()
        return max(self.table.get(begin, at), at)

    def _all_dropped(self) -> dict[int, int]:
        """Ends of all such elements by one pass with a stack of what is open."""
        html, at = self.html, 0
        ends: dict[int, int] = {}
        stack: list[tuple[str, int]] = []  # name, and where it begins if it is dropped, else -1
        count: Counter[str] = Counter()
        unseen = 0  # dropped elements in the stack
        blocks: dict[int, int] = {}  # first block of a dropped element
        waiting: list[int] = []
        foreign: list[int] = []
        guests: list[int] = []

        def pop(end: int) -> str:
            nonlocal unseen
            name, begin = stack.pop()
            count[name] -= 1
            for places in (foreign, guests):
                if places and places[-1] == len(stack):
                    places.pop()
            if begin >= 0:
                unseen -= 1
                ends.setdefault(begin, blocks.get(begin, end))
            return name

        def push(name: str, begin: int) -> None:
            if name in FOREIGN:
                foreign.append(len(stack))
            elif name in GUESTS:
                guests.append(len(stack))
            stack.append((name, begin))
            count[name] += 1

        while m := _TOKEN.search(html, at):
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            alone = m[3].rstrip().endswith("/")
            is_block = (tag in CONTAINERS or tag in LEAVES) and tag not in ("option", "legend", "hr")
            if m[1]:
                if count[tag]:
                    while stack[-1][0] != tag:
                        pop(m.start())
                    if stack[-1][1] >= 0:
                        ends[stack[-1][1]] = m.end()
                    pop(m.end())
                elif tag in ("body", "html"):
                    while unseen:
                        pop(m.start())
                continue
            if count["head"] and tag not in IN_HEAD and not unseen:
                while pop(m.start()) != "head":
                    pass
            if tag == "body" or (tag in ONCE and count[tag]):
                while unseen if tag == "body" else count[tag]:
                    pop(m.start())
            if is_block:
                while foreign and (not guests or guests[-1] < foreign[-1]):
                    while len(stack) > foreign[-1] + 1:
                        pop(m.start())
                    pop(m.start())
                for begin in waiting:
                    blocks[begin] = m.start()
                waiting = []
                if not unseen and stack and stack[-1][0] in LEAVES:
                    pop(m.start())
                push(tag, -1)
            elif tag in RAW:
                if not alone:
                    at = self.raw(tag, at)
            elif tag == "head" or (tag in GUESTS and not alone):
                push(tag, -1)
            elif tag in DROPPED and not alone:
                push(tag, m.start())
                unseen += 1
                waiting.append(m.start())
        while stack:
            pop(len(html))
        return ends


#: What an element says of its text: nothing, perhaps or surely furniture, or furniture unless it holds the page.
NOTHING, PERHAPS, SURELY, FRAME = 0, 1, 2, 3

#: Elements within each other that may hold the page; further ones are furniture.
MOST_FRAMES = 4


def _said(tag: str, attributes: str, inside: bool) -> int:
    """What an element says of its text by its name, class, id or role, or by being hidden.

    A form, or an element that a class word condemns, may still be the frame of
    the whole page. Within an article a name of several words condemns only if
    all of them are of furniture or of layout, but for comments and adverts.
    """
    said = FRAME if tag == "form" else SURELY if tag in FURNITURE else NOTHING
    if tag == "header" and inside:
        said = PERHAPS  # of an article: its title stays
    if attributes and said != SURELY:
        if _HIDDEN.search(attributes):
            return SURELY
        words: set[str] = set()
        condemned = False
        for m in _HINT.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").lower().split():
                parts = set(_WORDS.findall(name))
                if parts and _WORDS.findall(name)[0] not in LAYOUT_WORDS:
                    words |= parts
                    condemned |= bool(parts & FURNITURE_WORDS) and (not inside or parts <= _PARTS_OF_FURNITURE)
        if words & _COMMENT_WORDS:
            return SURELY
        if tag not in MAIN:
            if condemned or words & _ADVERT_WORDS:
                return SURELY if inside else FRAME
            if words & PERHAPS_WORDS and not words & CONTENT_WORDS:
                return max(said, PERHAPS)
    return said


def blocks_of(html: str) -> list[Block]:
    return Flattener().run(html)


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "place")


def place(block: Block, has_article: bool) -> int:
    """What elements say: 4 within an article, 3 there but perhaps furniture, 2 nothing, 1 perhaps furniture, 0 surely or beside the page's article."""
    if block.hint == 2 or has_article and not block.inside:
        return 0
    return (4 if block.inside else 2) - block.hint


def describe(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; a missing neighbour has no words and no links."""
    words = np.array([0, *(b.words for b in blocks), 0], float)
    density = np.array([0, *(b.linked / b.words for b in blocks), 0], float)
    heading = np.array([b.heading for b in blocks], float)
    has_article = any(b.inside and b.hint < 2 for b in blocks)
    places = np.array([place(b, has_article) for b in blocks], float)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], heading, places])


#: The labelled table: blocks by FEATURES and, last, whether they are main text. Blocks of usual sizes were drawn at random and
#: labelled so: all of an article, and nothing beside it, is main text; elsewhere prose of 25 words is, shorter text and headings,
#: linked or not, where a neighbour is prose, other links never; what may be furniture must be long, and outside of articles beside prose.
LABELLED = """
1 1.0 5 1.0 0 0.0 0 0 0
2 0.0 30 0.0 0 0.0 0 0 0
2 0.0 150 0.0 12 0.8 0 0 0
2 1.0 6 0.0 25 0.2 0 0 0
2 1.0 20 1.0 0 0.0 0 0 0
2 1.0 30 0.0 150 0.1 0 0 0
3 0.2 30 0.2 30 1.0 0 0 0
3 0.4 0 0.0 20 0.0 0 0 0
3 0.7 5 0.0 10 0.9 0 0 0
4 0.0 60 0.0 2 1.0 0 0 0
4 1.0 0 0.0 20 0.0 0 0 0
4 1.0 20 0.2 0 0.0 0 0 0
4 1.0 60 0.0 45 0.0 0 0 0
5 0.0 90 0.0 0 0.0 0 0 0
5 1.0 3 1.0 11 0.0 0 0 0
5 1.0 45 1.0 20 0.0 1 0 0
7 1.0 0 0.0 8 0.0 0 0 0
7 1.0 2 1.0 30 1.0 0 0 0
7 1.0 25 0.2 0 0.0 0 0 0
8 0.0 30 0.0 1 0.0 1 0 0
9 0.0 3 0.0 60 0.0 0 0 0
9 0.0 3 1.0 30 0.2 0 0 0
11 0.0 1 1.0 20 1.0 0 0 0
12 0.0 45 0.1 25 0.0 1 0 0
12 0.7 3 1.0 45 1.0 0 0 0
13 0.9 0 0.0 9 0.8 0 0 0
14 0.4 0 0.0 45 0.1 0 0 0
14 0.9 45 0.0 60 0.0 0 0 0
17 0.0 0 0.0 20 0.0 1 0 0
17 0.0 4 0.0 2 1.0 1 0 0
18 0.0 90 0.0 30 0.0 0 0 0
19 0.7 5 1.0 20 0.2 0 0 0
23 0.4 0 0.0 30 0.0 0 0 0
25 0.1 45 1.0 20 1.0 0 0 0
25 0.3 0 0.0 45 0.1 0 0 0
25 0.8 90 0.1 150 0.2 0 0 0
30 0.0 20 1.0 0 0.0 0 0 0
30 0.0 45 0.2 90 0.0 0 0 0
30 0.1 3 1.0 20 0.2 0 0 0
40 0.0 0 0.0 45 0.1 0 0 0
60 0.0 0 0.0 1 0.9 1 0 0
60 0.8 30 0.2 12 0.9 1 0 0
200 0.1 20 1.0 20 1.0 0 0 0
1 1.0 0 0.0 0 0.0 0 1 0
1 1.0 60 0.2 5 0.0 1 1 0
2 0.0 150 0.0 0 0.0 0 1 0
5 0.2 0 0.0 20 0.1 0 1 0
5 0.9 25 0.0 0 0.0 0 1 0
5 1.0 0 0.0 0 0.0 0 1 0
6 0.2 25 0.0 5 1.0 0 1 0
6 0.7 5 0.8 0 0.0 1 1 0
6 1.0 20 0.2 0 0.0 1 1 0
6 1.0 150 0.0 0 0.0 0 1 0
8 0.0 45 0.1 20 0.1 1 1 0
9 0.2 90 0.2 90 0.2 0 1 0
9 1.0 1 1.0 2 0.9 0 1 0
9 1.0 6 0.0 0 0.0 0 1 0
9 1.0 8 0.9 2 0.0 0 1 0
9 1.0 45 1.0 1 0.9 1 1 0
10 0.0 20 0.1 30 1.0 0 1 0
10 0.2 12 0.0 90 0.0 0 1 0
18 0.0 0 0.0 45 0.1 1 1 0
18 0.0 150 0.0 0 0.0 0 1 0
25 0.0 30 1.0 30 1.0 0 1 0
25 0.1 1 1.0 45 0.2 0 1 0
30 0.0 30 0.0 90 0.1 0 1 1
30 0.8 30 0.2 0 0.0 1 1 0
60 0.0 150 0.1 0 0.0 0 1 1
100 0.0 0 0.0 0 0.0 0 1 0
200 0.0 0 0.0 2 0.0 0 1 0
200 0.0 0 0.0 45 0.0 0 1 1
200 0.0 20 0.0 3 1.0 0 1 1
200 0.8 12 0.0 20 0.0 0 1 0
1 0.0 20 0.1 3 1.0 0 2 1
1 0.0 25 0.0 0 0.0 0 2 1
1 0.0 90 0.0 0 0.0 0 2 1
1 1.0 10 0.9 60 0.1 1 2 1
1 1.0 11 0.8 150 0.1 0 2 0
1 1.0 90 0.2 0 0.0 0 2 0
2 0.0 20 0.0 12 0.0 0 2 1
2 0.0 90 0.2 150 0.1 1 2 1
2 1.0 0 0.0 25 0.0 0 2 0
2 1.0 3 0.9 1 1.0 0 2 0
3 0.0 150 0.2 45 0.2 0 2 1
3 1.0 0 0.0 8 0.8 0 2 0
3 1.0 60 0.0 1 0.8 0 2 0
4 0.0 30 0.2 90 0.0 1 2 1
4 0.0 45 0.1 30 1.0 0 2 1
5 1.0 10 0.9 0 0.0 0 2 0
5 1.0 25 0.0 0 0.0 0 2 0
5 1.0 90 0.1 25 0.0 0 2 0
5 1.0 90 0.2 90 0.0 0 2 0
6 0.4 1 1.0 0 0.0 0 2 0
6 1.0 9 0.0 20 1.0 1 2 0
7 0.2 8 0.0 45 0.1 0 2 1
7 0.9 4 0.0 0 0.0 0 2 0
7 1.0 5 1.0 60 0.2 0 2 0
7 1.0 20 0.0 3 1.0 0 2 0
8 0.0 11 0.0 45 0.1 0 2 1
8 0.0 150 0.0 0 0.0 1 2 1
8 0.7 0 0.0 150 0.0 0 2 0
9 0.0 12 0.0 25 0.1 0 2 1
9 0.0 20 0.0 45 0.2 1 2 1
9 0.0 45 1.0 0 0.0 0 2 0
9 1.0 30 1.0 0 0.0 0 2 0
10 0.0 60 0.2 3 1.0 1 2 1
10 0.4 0 0.0 3 1.0 1 2 0
11 0.0 4 0.0 30 0.0 0 2 1
11 0.7 60 0.1 90 0.1 0 2 0
12 0.0 7 0.9 0 0.0 0 2 0
12 0.0 20 0.1 3 0.0 0 2 1
13 0.0 1 1.0 8 0.0 1 2 0
13 0.0 3 0.9 25 0.0 0 2 1
14 0.0 150 0.1 30 0.0 0 2 1
15 0.2 6 0.8 9 0.0 0 2 0
17 0.0 30 0.1 9 0.9 0 2 1
17 0.0 45 0.1 3 1.0 0 2 1
18 0.0 20 1.0 3 1.0 0 2 0
18 0.2 150 0.0 5 0.9 0 2 1
22 0.4 0 0.0 1 0.0 0 2 0
30 0.1 20 1.0 90 0.1 0 2 1
30 0.3 30 0.1 0 0.0 1 2 1
30 0.3 90 0.1 20 0.2 0 2 1
30 0.8 4 0.0 9 0.8 1 2 0
40 0.1 0 0.0 25 0.0 0 2 1
40 0.3 12 0.0 150 0.0 1 2 1
40 0.8 20 1.0 5 1.0 1 2 0
40 0.8 30 0.0 150 0.1 0 2 0
60 0.0 2 1.0 20 0.0 0 2 1
60 0.0 12 0.9 3 1.0 0 2 1
100 0.0 150 0.2 60 0.2 0 2 1
100 0.8 3 1.0 90 0.2 1 2 1
200 0.0 45 1.0 20 1.0 1 2 1
2 1.0 0 0.0 150 0.1 0 3 0
3 0.0 2 1.0 25 0.2 0 3 0
3 0.7 45 0.1 0 0.0 1 3 1
3 1.0 0 0.0 150 0.2 0 3 0
6 0.0 25 0.0 25 0.0 1 3 1
6 0.4 7 0.0 0 0.0 0 3 0
6 1.0 0 0.0 12 0.9 1 3 1
6 1.0 1 1.0 20 0.1 1 3 1
7 1.0 30 0.2 60 0.0 1 3 1
7 1.0 45 0.2 150 0.2 1 3 1
8 1.0 30 0.0 30 1.0 0 3 0
9 1.0 9 0.0 45 0.2 1 3 1
10 0.0 0 0.0 10 0.0 0 3 0
11 0.0 30 1.0 2 1.0 1 3 1
13 0.0 2 1.0 1 1.0 0 3 0
13 0.4 30 0.1 45 1.0 1 3 1
14 0.0 25 0.0 9 0.9 0 3 0
16 0.0 0 0.0 0 0.0 0 3 0
16 0.0 30 1.0 0 0.0 0 3 0
16 0.0 45 0.0 0 0.0 1 3 1
18 0.0 30 0.0 5 0.0 0 3 0
22 0.0 150 0.0 20 0.0 0 3 0
30 0.8 90 0.0 0 0.0 1 3 1
60 0.0 0 0.0 0 0.0 0 3 1
1 1.0 7 0.0 4 0.0 0 4 1
3 0.0 45 0.2 60 0.0 0 4 1
3 0.9 0 0.0 90 0.0 0 4 1
4 0.0 12 0.0 12 0.0 0 4 1
5 0.0 1 0.8 0 0.0 0 4 1
5 1.0 4 0.0 45 1.0 0 4 1
6 0.0 2 1.0 20 0.1 1 4 1
6 0.7 45 0.0 3 1.0 0 4 1
7 0.0 90 0.0 150 0.2 0 4 1
8 0.0 2 1.0 0 0.0 0 4 1
8 0.7 0 0.0 25 0.2 1 4 1
8 1.0 1 1.0 20 0.0 1 4 1
9 0.0 0 0.0 30 0.1 0 4 1
9 0.0 10 0.8 45 0.0 0 4 1
9 0.0 25 0.1 12 0.8 0 4 1
9 0.4 1 0.0 30 0.1 0 4 1
9 1.0 25 0.2 1 0.0 1 4 1
10 0.0 1 0.0 90 0.0 0 4 1
11 0.0 30 0.2 45 1.0 0 4 1
11 0.9 150 0.0 150 0.0 0 4 1
14 0.0 0 0.0 5 1.0 0 4 1
16 0.0 9 0.0 7 0.9 0 4 1
18 0.2 0 0.0 30 1.0 0 4 1
19 0.0 3 1.0 60 0.1 0 4 1
20 0.0 30 0.0 2 1.0 0 4 1
21 0.2 11 0.0 45 1.0 0 4 1
25 0.0 0 0.0 45 0.2 0 4 1
25 0.1 45 0.1 10 0.8 0 4 1
30 0.3 4 0.9 20 0.0 0 4 1
40 0.3 8 0.0 45 1.0 1 4 1
40 0.8 0 0.0 90 0.1 1 4 1
60 0.0 2 0.9 8 0.8 0 4 1
60 0.8 0 0.0 25 0.1 0 4 1
100 0.0 0 0.0 0 0.0 0 4 1
100 0.0 1 0.8 150 0.0 1 4 1
100 0.0 3 0.9 0 0.0 1 4 1
100 0.0 30 1.0 3 0.0 0 4 1
200 0.1 150 0.0 150 0.1 0 4 1
"""


class Tree(NamedTuple):
    """A split at feature > cut, or a leaf."""

    feature: int
    cut: float
    low: Tree | bool
    high: Tree | bool

    def judge(self, rows: np.ndarray) -> np.ndarray:
        above = rows[:, self.feature] > self.cut
        out = np.empty(len(rows), bool)
        for part, branch in ((~above, self.low), (above, self.high)):
            out[part] = branch if isinstance(branch, bool) else branch.judge(rows[part])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> Tree | bool:
    """A tree by the largest fall in Gini impurity; ties go to the first feature and the lowest cut."""
    if depth == 0 or y.all() or not y.any():
        return bool(2 * y.sum() > len(y))
    best = (1e-12, None)
    whole = 2 * y.mean() * (1 - y.mean())
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[:-1] + values[1:]) / 2:
            above = x[:, feature] > cut
            p, a, b = above.mean(), y[above].mean(), y[~above].mean()
            gain = whole - p * 2 * a * (1 - a) - (1 - p) * 2 * b * (1 - b)
            if gain > best[0] + 1e-12:
                best = (gain, (feature, float(cut)))
    if best[1] is None:
        return bool(2 * y.sum() > len(y))
    feature, cut = best[1]
    above = x[:, feature] > cut
    return Tree(feature, cut, grow(x[~above], y[~above], depth - 1), grow(x[above], y[above], depth - 1))


@lru_cache(1)
def trained() -> Tree:
    table = np.array([[float(v) for v in line.split()] for line in LABELLED.split("\n") if line])
    return grow(table[:, :-1], table[:, -1] > 0)


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return "\n".join(b.text for b, good in zip(blocks, trained().judge(describe(blocks)), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page, from its whole html.

    The page is cut into flat blocks at block elements; scripts, styles,
    comments in markup and other unseen elements have none. Character
    references are decoded, white space in a block becomes one space, empty
    blocks vanish. A decision tree grown on the table LABELLED tells main text
    by a block's word count and link density, those of the blocks before and
    after it, and by what its elements say of it: all of an article stays,
    where a page names none, words and neighbours decide. Formulas are text.
    Blocks of main text are joined by line feeds in page order. Markup may be cut off or unclosed: a head ends where
    the page begins, another unseen element that is left open before its first block.

    Null and empty html give an empty text; repeated rows repeat. Nothing is
    shuffled: rows are independent of each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
