"""A small DOM of block elements: inline markup is text, its share counts for the block around it."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var br wbr".split()
)
HIDDEN = frozenset("script style template head title textarea select button iframe".split())
RAW = frozenset("script style title textarea iframe xmp".split())
P_ENDS = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS_SIBLING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table body html article section div main".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_HEAD = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[\"'>]")
_NAMES = re.compile(r"""\s(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PART = re.compile(r"[A-Za-z]+")


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """Lower-cased words of class, id, role and itemprop."""
    if "=" not in raw:
        return ()
    return tuple(t.lower() for v in _NAMES.findall(raw) for t in _PART.findall(v))


@dataclass
class Node:
    tag: str
    parent: int
    tokens: tuple[str, ...] = ()
    attributes: str = ""
    hidden: bool = False
    children: list[int] = field(default_factory=list)
    #: (place on the page, text) of each run of own text between blocks
    runs: list[tuple[int, str]] = field(default_factory=list)
    links: int = 0
    link_chars: int = 0
    inline: int = 0


class _Tags:
    """Tags and comments of a page from left to right, in time that grows with the page.

    A tag ends at the first > outside quotes. A < without such an end is text; after the first of these all ends are
    looked up in a table made once from right to left, so no stretch is read again and again."""

    def __init__(self, text: str) -> None:
        self.text, self.last = text, text.rfind(">")
        self.places: list[int] | None = None
        self.ends: list[int] = []

    def _end(self, at: int) -> int:
        if self.places is None:
            found = [(m.start(), m.group()) for m in _SPECIAL.finditer(self.text)]
            self.places = [p for p, _ in found]
            self.ends = [-1] * (len(found) + 1)
            following: dict[str, int] = {}
            for i in range(len(found) - 1, -1, -1):
                place, c = found[i]
                if c == ">":
                    self.ends[i] = place
                else:
                    if c in following:
                        self.ends[i] = self.ends[following[c] + 1]
                    following[c] = i
        return self.ends[bisect_left(self.places, at)]

    def after(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """``(start, end, name, closing, attributes)`` of the next one; the name is None for comments and the like."""
        text = self.text
        while (lt := text.find("<", at)) >= 0:
            if text.startswith("<!--", lt):
                end = text.find("-->", lt + 4)
                return lt, len(text) if end < 0 else end + 3, None, False, ""
            if lt > self.last:  # only an open comment can follow
                at = text.find("<!--", lt)
                if at < 0:
                    return None
                continue
            if text[lt + 1] in "!?":
                return lt, text.find(">", lt) + 1, None, False, ""
            m = _HEAD.match(text, lt)
            if m is not None:
                if self.places is None and (whole := _TAG.match(text, lt)):
                    return lt, whole.end(), whole[2].lower(), bool(whole[1]), whole[3]
                end = self._end(m.end())
                if end >= 0:
                    return lt, end + 1, m[2].lower(), bool(m[1]), text[m.end() : end]
            at = lt + 1
        return None


def parse(page: str | None) -> list[Node]:
    """Blocks of a page in page order; node 0 is the root. Unclosed and stray tags are tolerated."""
    text = page or ""
    nodes = [Node("#root", -1)]
    stack = [0]
    open_: Counter[str] = Counter()
    buffer: list[str] = []
    place = 0
    in_link = 0
    tags = _Tags(text)

    def flush() -> None:
        nonlocal place
        if buffer:
            joined = "".join(buffer)
            buffer.clear()
            words = html.unescape(joined).split() if "&" in joined else joined.split()
            if words:
                place += 1
                nodes[stack[-1]].runs.append((place, " ".join(words)))

    def close(upto: int) -> None:
        flush()
        open_.subtract(nodes[k].tag for k in stack[upto:])
        del stack[upto:]

    at = 0
    while True:
        found = tags.after(at)
        if found is None:
            buffer.append(text[at:])
            break
        start, stop, tag, end, attributes = found
        if start > at:
            buffer.append(text[at:start])
            if in_link:
                nodes[stack[-1]].link_chars += start - at
        at = stop
        if tag is None:
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                buffer.append(" ")
            elif not end:
                nodes[stack[-1]].inline += 1
            if tag == "a":
                in_link = 0 if end else 1
                nodes[stack[-1]].links += not end
            continue
        if end:
            if open_[tag] > 0:
                close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
                in_link = 0
            else:
                flush()
            continue
        if tag in P_ENDS and nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        elif any(open_[t] > 0 for t in ENDS_SIBLING.get(tag, ())):
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag in ENDS_SIBLING[tag]:
                    close(k)
                    break
                if nodes[stack[k]].tag in SCOPES:
                    break
        flush()
        if tag in VOID:
            continue
        top = stack[-1]
        node = Node(tag, top, attribute_tokens(attributes), attributes, nodes[top].hidden or tag in HIDDEN)
        nodes[top].children.append(len(nodes))
        nodes.append(node)
        if tag in RAW:
            over = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at) if at <= tags.last else None
            at = over.end() if over else len(text)
            continue
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
            stack.append(len(nodes) - 1)
            open_[tag] += 1
    flush()
    return nodes
