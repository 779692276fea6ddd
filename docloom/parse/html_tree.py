"""HTML to a flat tree in document order (no Spark imports).

A document is a few parallel lists, one entry a node: the subtree of node
``i`` is ``i .. end[i] - 1``.  Nothing here recurses, so nesting depth does not
matter.  Malformed markup is repaired, never rejected.
"""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

ELEMENT, TEXT, RAW = "element", "text", "raw"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_TEXT = frozenset(("script", "style"))
_KEEP_SPACE = frozenset(("pre", "code"))
_NO_BLANKS = frozenset("ul ol body div blockquote tr table document".split())

_BLOCKS = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
#: open element -> start tags that close it
_CLOSED_BY: dict[str, frozenset[str]] = {
    "p": frozenset(_BLOCKS + "li dd dt td th tr tbody thead tfoot caption body".split()),
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "td": frozenset("td th tr tbody thead tfoot".split()),
    "th": frozenset("td th tr tbody thead tfoot".split()),
    "tr": frozenset("tr tbody thead tfoot".split()),
    "thead": frozenset("tbody tfoot thead".split()),
    "tbody": frozenset("tbody tfoot thead".split()),
    "tfoot": frozenset("tbody tfoot thead".split()),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(["body", *_BLOCKS]),
    **{f"h{i}": frozenset(f"h{j}" for j in range(1, 7)) for i in range(1, 7)},
}
#: a start tag looks for the element it closes no further up than to these
_SCOPE = frozenset("table td th ul ol dl div body html blockquote section article button select".split())
#: an end tag does not close elements that weigh more than its own
_WEIGHT = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


class Tree:
    """Parallel lists; node 0 is the synthetic ``document``."""

    __slots__ = ("attrs", "depth", "end", "kind", "parent", "tag", "text")

    def __init__(self):
        self.kind, self.tag, self.text = [ELEMENT], ["document"], [None]
        self.attrs, self.parent, self.end, self.depth = [{}], [-1], [1], [0]

    def __len__(self) -> int:
        return len(self.kind)

    def add(self, kind: str, tag: str, text: str | None, attrs: dict, parent: int) -> int:
        at = len(self.kind)
        self.kind.append(kind)
        self.tag.append(tag)
        self.text.append(text)
        self.attrs.append(attrs)
        self.parent.append(parent)
        self.end.append(at + 1)
        self.depth.append(self.depth[parent] + 1)
        return at

    def children(self, i: int):
        j = i + 1
        while j < self.end[i]:
            yield j
            j = self.end[j]

    def find(self, tag: str, below: int = 0) -> int | None:
        """The first element ``tag`` in the subtree of ``below``."""
        for i in range(below, self.end[below]):
            if self.kind[i] == ELEMENT and self.tag[i] == tag:
                return i
        return None

    def transparent(self, i: int) -> bool:
        """A wrapper that carries presentation only."""
        return self.tag[i] in ("div", "p", "span", "font", "center") and all(k in ("style", "class", "lang") for k in self.attrs[i])


#: a named reference, whole or without its end
_NAMED = re.compile(r"&([A-Za-z][A-Za-z0-9]*;?)")


class _Builder(HTMLParser):
    """Named references stand for characters only if they are whole; the others, as ``&amp`` at a cut, are text."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.tree, self.open, self.base, self.mark = Tree(), [0], base, "&"

    def feed(self, data):
        # the library decodes names without a semicolon too: a character that the text lacks stands for their ampersand
        self.mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in data)
        super().feed(_NAMED.sub(lambda m: m[0] if m[1][-1] == ";" and m[1] in html5 else self.mark + m[1], data))

    def _plain(self, text: str) -> str:
        return text.replace(self.mark, "&")

    def _close(self, position: int) -> None:
        for i in self.open[position:]:
            self.tree.end[i] = len(self.tree)
        del self.open[position:]

    def handle_starttag(self, tag, attrs):
        tree, tag = self.tree, self._plain(tag)
        for position in range(len(self.open) - 1, 0, -1):
            name = tree.tag[self.open[position]]
            if tag in _CLOSED_BY.get(name, ()):
                self._close(position)
                break
            if name in _SCOPE and name not in _CLOSED_BY:
                break
        if tag in ("html", "body") and any(tree.tag[i] == tag for i in self.open):
            return
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(self._plain(k), self._plain(v) if v is not None else "")
        if tag == "a" and "href" in values:
            if values["href"].startswith("javascript:"):
                del values["href"]
            elif self.base:
                values["href"] = _join(self.base, values["href"])
        node = tree.add(ELEMENT, tag, None, values, self.open[-1])
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        tag = self._plain(tag)
        if tag not in VOID and self.tree.tag[self.open[-1]] == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        tag = self._plain(tag)
        weight = _WEIGHT.get(tag, 100)
        for position in range(len(self.open) - 1, 0, -1):
            name = self.tree.tag[self.open[position]]
            if name == tag:
                self._close(position)
                return
            if _WEIGHT.get(name, 100) > weight:
                return

    def handle_data(self, data):
        tree, parent, data = self.tree, self.open[-1], self._plain(data)
        tag = tree.tag[parent]
        if tag in _RAW_TEXT:
            last = len(tree) - 1
            if last > parent and tree.kind[last] == RAW and tree.parent[last] == parent:
                tree.text[last] += data
            else:
                tree.add(RAW, "#raw", data, {}, parent)
        elif tag in _KEEP_SPACE or data.strip() or tag not in _NO_BLANKS:
            tree.add(TEXT, "#text", data, {}, parent)


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def parse(html: str | None, base: str | None = None) -> Tree:
    """The tree of a whole HTML text; null and empty give a tree without children."""
    builder = _Builder(base)
    builder.feed(html or "")
    builder.close()
    builder._close(1)
    builder.tree.end[0] = len(builder.tree)
    return builder.tree


def root(tree: Tree) -> int:
    """The ``html`` element if there is one (what trails it is ignored), else the document."""
    for i in tree.children(0):
        if tree.kind[i] == ELEMENT and tree.tag[i] == "html":
            return i
    return 0
