"""Leaf blocks of a web page: its text between block borders, with the elements around it.

Time and memory grow with the page only, whatever its markup: signs without an end are
known from the last ``>`` of the page, open elements are found by their tags' places, and a
block holds its innermost element, which knows what it adds to those around it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![\w:-])([a-zA-Z][\w:-]*+)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_WORD = re.compile(r"[a-z]+")

#: Elements whose content is no text of the page, up to their end tag.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "svg", "select", "annotation", "annotation-xml"}
#: Those that take all the rest of the page if they have no end tag; others without one are left open like any element.
_TO_THE_END = {"script", "style", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand in a line of text; all others are borders of blocks.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup mover munder munderover mstyle mpadded mfenced".split()
)
#: Open elements that a start tag closes: itself or its like, up to the nearest element that holds them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTROLS = {"input", "button", "select", "textarea"}


@dataclass(eq=False)
class Element:
    """An open element; ``fresh`` are the features that no element around it has."""

    tag: str
    words: frozenset[str] = frozenset()
    label: str | None = None
    parent: Element | None = None
    fresh: list[str] = field(default_factory=list)
    #: Sums over the features of this element and those around it, by whoever reads the blocks.
    sums: tuple[float, ...] | None = None

    def outwards(self) -> Iterator[Element]:
        at: Element | None = self
        while at is not None:
            yield at
            at = at.parent


@dataclass
class Block:
    """Text of one block, its innermost element, and what it holds."""

    text: str
    inside: Element | None
    linked: int = 0
    controls: int = 0


@dataclass
class _State:
    stack: list[Element] = field(default_factory=list)
    places: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    open_features: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    filled: bool = False
    inside: Element | None = None
    linked: int = 0
    links: int = 0
    controls: int = 0
    blocks: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        if not raw:
            return
        if "&" in raw:
            raw = entities.unescape(raw)
        if not self.pieces or self.inside is None:
            self.inside = self.stack[-1] if self.stack else None
        if raw.strip():
            if not self.filled:
                self.inside = self.stack[-1] if self.stack else None
                self.filled = True
            if self.links:
                self.linked += len(raw)
        self.pieces.append(raw)

    def border(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(text, self.inside, self.linked, self.controls))
        if text or not self.pieces:
            self.controls = 0
        self.pieces, self.linked, self.inside, self.filled = [], 0, None, False

    def open(self, element: Element) -> None:
        element.parent = self.stack[-1] if self.stack else None
        for f in (f"in={element.tag}", *(f"name={w}" for w in element.words)):
            if not self.open_features[f]:
                element.fresh.append(f)
            self.open_features[f] += 1
        self.places[element.tag].append(len(self.stack))
        self.stack.append(element)
        self.links += element.tag == "a"

    def _nearest(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _cut(self, place: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > place:
            e = self.stack.pop()
            self.places[e.tag].pop()
            self.links -= e.tag == "a"
            for f in (f"in={e.tag}", *(f"name={w}" for w in e.words)):
                self.open_features[f] -= 1

    def close(self, tag: str) -> None:
        place = self._nearest((tag,))
        if place >= 0:
            self._cut(place)

    def close_like(self, own: set[str], holders: set[str]) -> None:
        place = self._nearest(own)
        if place > self._nearest(holders - own):
            self._cut(place)


def _element(tag: str, attributes: str) -> Element:
    words: list[str] = []
    label = None
    if "=" in attributes:
        for name, one, two, three in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), one or two or three
            if name in ("class", "id", "role", "itemprop"):
                words += _NAME_WORD.findall(value.lower())
            elif name == "data-main":
                label = value
    return Element(tag, frozenset(words), label)


def blocks_of(page: str | None) -> list[Block]:
    """All leaf blocks with text, in page order."""
    if not page:
        return []
    state, at, n = _State(), 0, len(page)
    last = page.rfind(">") + 1  # markup ends before; behind it only a comment can begin
    endless: set[str] = set()
    while at < n:
        m = _MARKUP.search(page, at, last)
        if not m:
            state.text(page[at:].partition("<!--")[0])
            break
        state.text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            break  # a comment without an end
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = (m[1] or m[4]) == "/"
        empty = (m[3] or m[6] or "").endswith("/")
        if tag == "svg" and empty and not closing:
            continue
        if tag in RAW and not closing and tag not in endless:
            end = re.compile(f"</{tag}(?![a-zA-Z0-9-])[^>]*>", re.IGNORECASE).search(page, at)
            if end or tag in _TO_THE_END:
                state.controls += tag in _CONTROLS
                at = end.end() if end else n
                continue
            endless.add(tag)
        if tag not in INLINE:
            state.border()
        elif tag == "br" or tag == "img":
            state.text(" ")
        if closing and tag in _HEADINGS:
            state.close_like(_HEADINGS, {"div", "article", "section", "body", "table"})
        elif closing:
            state.close(tag)
        else:
            if tag in _CONTROLS:
                state.controls += 1
            if tag not in INLINE:
                state.close_like({"p"}, {"button", "td", "th", "li", "div", "article", "section", "body", "blockquote"})
            if tag in _CLOSES:
                state.close_like(*_CLOSES[tag])
            if tag not in VOID and not empty:
                state.open(_element(tag, m[3] or m[6] or ""))
    state.border()
    return state.blocks
