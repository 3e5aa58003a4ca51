"""A small tree for untidy HTML, with the few selectors the parsers need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag that ends these open ones (fixed values).
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Descendants in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            else:
                stack += reversed(x.children)

    def text(self, sep: str = "") -> str:
        return sep.join(s for s in (x.strip() for x in self.strings()) if s)

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def up(self, *tags: str, cls: str | None = None) -> Node | None:
        x = self.parent
        while x is not None and not (x.tag in tags and (cls is None or cls in x.attrs.get("class", "").split())):
            x = x.parent
        return x

    def drop(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def matching(self, selector: str) -> Iterator[Node]:
        """Comma-separated alternatives of compound selectors, blanks for descent."""
        alternatives = _alternatives(selector)
        return (x for x in self.walk() if any(_fits(x, a, self) for a in alternatives))

    def select(self, selector: str) -> list[Node]:
        return list(self.matching(selector))

    def one(self, selector: str) -> Node | None:
        return next(self.matching(selector), None)


def _commas(selector: str) -> list[str]:
    return [s.strip() for s in selector.split(",")]


_PART = re.compile(r"([a-zA-Z][\w-]*)|\.([\w-]+)|\[([\w-]+)(?:([*^]?)=\"?([^\]\"]*)\"?)?\]")


def _compound(s: str) -> list[tuple]:
    return [m.groups() for m in _PART.finditer(s)]


@lru_cache(1024)
def _alternatives(selector: str) -> list[list[list[tuple]]]:
    return [[_compound(c) for c in s.split()] for s in _commas(selector)]


def _is(x: Node, compound: list[tuple]) -> bool:
    for tag, cls, attr, op, value in compound:
        if tag and x.tag != tag or cls and cls not in x.attrs.get("class", "").split():
            return False
        if attr:
            has = x.attrs.get(attr)
            if has is None or value and not (value in has if op == "*" else has.startswith(value) if op == "^" else has == value):
                return False
    return True


def _fits(x: Node, chain: list[list[tuple]], root: Node) -> bool:
    if not _is(x, chain[-1]):
        return False
    rest, up = len(chain) - 2, x.parent
    while rest >= 0 and up is not None and up is not root.parent:
        if _is(up, chain[rest]):
            rest -= 1
        up = up.parent
    return rest < 0


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        ended = CLOSES.get(tag)
        while ended and self.at.tag in ended:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    """The tree of any text; null and broken input give what can be read."""
    b = _Builder()
    try:
        b.feed((html or "").replace("\x00", ""))
        b.close()
    except (AssertionError, ValueError):
        pass
    return b.root
