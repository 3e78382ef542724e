"""A small HTML tree on the standard library, with the selectors that source settings use."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a new one of the same kind closes, up to the containers named; and elements that close a paragraph.
SELF_CLOSING = {"li": {"ul", "ol"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}


class Node:
    """An element: name, attributes, parent and children (nodes and texts)."""

    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """The elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def parents(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node is self or node.name not in ("script", "style"):
                stack.extend(reversed(node.children))

    def text(self) -> str:
        """Its stripped strings, joined by blanks."""
        return " ".join(s.strip() for s in self.strings() if s.strip())

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")

    def all(self, selector: str) -> list[Node]:
        tests = [_chain(part) for part in _split(selector)]
        return [n for n in self.walk() if any(_meets(n, t) for t in tests)]

    def first(self, selector: str) -> Node | None:
        tests = [_chain(part) for part in _split(selector)]
        return next((n for n in self.walk() if any(_meets(n, t) for t in tests)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in SELF_CLOSING:
            self._close(tag, SELF_CLOSING[tag])
        elif tag in BLOCKS:
            self._close("p", BLOCKS - {"p"} | {"li", "td", "th", "body"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _close(self, name, containers):
        node = self.at
        while node.parent is not None and node.name not in containers:
            if node.name == name:
                self.at = node.parent
                return
            node = node.parent

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.name == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    """The tree of any markup; broken markup gives what can be made of it."""
    b = _Builder()
    b.feed(markup or "")
    b.close()
    return b.root


def plain_text(markup: str | None) -> str:
    """The text of a fragment: entities resolved, tags dropped, strings stripped and joined by blanks."""
    if not markup:
        return ""
    text = entities.unescape(markup)
    return parse(text).text() if "<" in text else text.strip()


_ATTRIBUTE = re.compile(r"\[\s*([\w:-]+)\s*(?:([~*^$|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*(i)?)?\s*\]")
_SIMPLE = re.compile(r"([\w-]+|\*)?((?:#[\w-]+|\.[\w-]+|\[[^\]]*\])*)$")


def _split(selector: str) -> list[str]:
    return [s.strip() for s in re.split(r",(?![^\[]*\])", selector) if s.strip()]


def _chain(selector: str) -> list[tuple[str, str]]:
    """(combinator, simple selector) from left to right; combinators are blank and >."""
    parts = re.findall(r"\s*(>)?\s*((?:[^\s>\[]|\[[^\]]*\])+)", selector)
    return [(c or " ", s) for c, s in parts]


def _simple(node: Node, selector: str) -> bool:
    m = _SIMPLE.match(selector)
    if not m:
        return False
    if m[1] and m[1] not in ("*", node.name):
        return False
    for part in re.findall(r"#[\w-]+|\.[\w-]+|\[[^\]]*\]", m[2]):
        if part[0] == "#":
            ok = node.get("id") == part[1:]
        elif part[0] == ".":
            ok = part[1:] in node.get("class").split()
        else:
            a = _ATTRIBUTE.match(part)
            if not a:
                return False
            value, want = node.attrs.get(a[1]), a[3] or a[4] or a[5] or ""
            if value is None:
                return False
            if a[6]:
                value, want = value.casefold(), want.casefold()
            ok = {None: True, "": True, "=": value == want, "*=": want in value, "^=": value.startswith(want), "$=": value.endswith(want), "~=": want in value.split(), "|=": value == want or value.startswith(f"{want}-")}[a[2]]
        if not ok:
            return False
    return True


def _meets(node: Node, chain: list[tuple[str, str]]) -> bool:
    if not chain or not _simple(node, chain[-1][1]):
        return False
    rest, way = chain[:-1], chain[-1][0]
    if not rest:
        return True
    if way == ">":
        return node.parent is not None and _meets(node.parent, rest)
    return any(_meets(p, rest) for p in node.parents())
