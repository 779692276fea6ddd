"""Markdown of an HTML subtree: nodes become blocks, blocks become lines."""

from __future__ import annotations

import re
from statistics import pstdev

from docloom.parse import html_text
from docloom.parse.html_tree import ELEMENT, RAW, TEXT, Tree

# Tags that are dropped, and tags that begin a block.
SKIP = html_text.SKIP | {"head"}
BLOCK = frozenset("html body main article section header aside div p figure figcaption h1 h2 h3 h4 h5 h6 ul ol li dl dd dt blockquote pre table hr".split())
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~", "s": "~", "strike": "~"}
HARD_BREAK = "  \n"
_NUMBER = re.compile(r"^[\[(]?\s*(\d+)\s*[\])]?[.:)]?$")
_NOTE_PLACES = ("footnote", "endnote", "doc-endnotes", "doc-footnote")


class Blocks(list):
    """Blocks: ("p", text), ("h", level, text), ("ul" | "ol", [Blocks]), ("quote", Blocks), ("code", text), ("hr",), ("table", rows), ("note", label, Blocks)."""


class Notes:
    """Footnote references and definitions that an HTML document seems to have."""

    def __init__(self, tree: Tree, top: int):
        self.label: dict[int, str] = {}
        self.definitions: list[tuple[str, int]] = []
        self.back: set[str] = set()
        self.skip: set[int] = set()
        ids = {}
        for i in range(top, tree.end[top]):
            if tree.kind[i] == ELEMENT and (name := tree.attrs[i].get("id")):
                ids.setdefault(name, i)
        found: dict[int, str] = {}
        for i in range(top, tree.end[top]):
            if tree.kind[i] != ELEMENT or tree.tag[i] != "a":
                continue
            target = tree.attrs[i].get("href", "").rpartition("#")
            node = ids.get(target[2]) if target[1] else None
            number = _NUMBER.match(html_text.text(tree, i).strip())
            if node is None or not number or not self._is_note(tree, i, node, number[1]):
                continue
            self.label[i] = number[1]
            self.back.update(filter(None, (tree.attrs[i].get("id"), tree.attrs[tree.parent[i]].get("id"))))
            found.setdefault(node, number[1])
        if not found:
            return
        self.definitions = [(label, node) for node, label in sorted(found.items())]
        places = {p for node in found for p in self._places(tree, node, found)}
        self.skip = places
        for p in list(places):
            siblings = [j for j in tree.children(tree.parent[p]) if tree.kind[j] == ELEMENT]
            at = siblings.index(p)
            if at and tree.tag[siblings[at - 1]] == "hr":
                self.skip.add(siblings[at - 1])

    @staticmethod
    def _holder(tree: Tree, node: int) -> int | None:
        while node > 0:
            a = tree.attrs[node]
            names = f"{a.get('class', '')} {a.get('role', '')} {a.get('id', '')}".lower()
            if "data-footnotes" in a or any(x in names for x in _NOTE_PLACES):
                return node
            node = tree.parent[node]
        return None

    def _is_note(self, tree: Tree, ref: int, node: int, number: str) -> bool:
        a = tree.attrs[ref]
        if "data-footnote-ref" in a or a.get("role") == "doc-noteref" or "footnote-ref" in a.get("class", "").split():
            return True
        if self._holder(tree, node) is not None:
            return True
        own = {x for x in (a.get("id"), tree.attrs[tree.parent[ref]].get("id")) if x}
        for i in range(node, tree.end[node]):
            if tree.tag[i] == "a" and tree.attrs[i].get("href", "").rpartition("#")[2] in own:
                return True
        if tree.tag[node] == "li":
            items = [j for j in tree.children(tree.parent[node]) if tree.tag[j] == "li"]
            if items.index(node) + 1 == int(number):
                return True
        return html_text.text(tree, node).strip().startswith((f"[{number}]", f"{number}.", f"{number}:", f"{number})"))

    def _places(self, tree: Tree, node: int, found: dict[int, str]) -> set[int]:
        """What to leave out of the body: the section, else a list of nothing but notes, else the node."""
        holder = self._holder(tree, tree.parent[node])
        if holder is not None:
            return {holder}
        up = tree.parent[node]
        if tree.tag[node] == "li" and all(j in found for j in tree.children(up) if tree.kind[j] == ELEMENT):
            return {up}
        return {node}


class Converter:
    """One document's conversion; ``images`` maps image sources to other places."""

    def __init__(self, tree: Tree, top: int, gone: set[int] | frozenset[int] = frozenset(), images: dict[str, str] | None = None):
        self.tree, self.top, self.gone, self.images = tree, top, gone, images or {}
        self.notes = Notes(tree, top)

    def blocks(self) -> Blocks:
        out = self.inside(self.top)
        for label, node in self.notes.definitions:
            body = self.inside(node, note=True)
            if body and body[0][0] == "p":
                # the definition may repeat its own number
                text = re.sub(rf"^(?:\*\*)?(?:\[{label}\]:?|{label}[.:)])(?:\*\*)?(?:\s+|$)", "", body[0][1])
                body[:1] = [("p", text)] if text else []
            out.append(("note", label, body))
        return out

    def inside(self, i: int, note: bool = False) -> Blocks:
        """Blocks of the children; loose inline content gathers in paragraphs."""
        out, loose = Blocks(), []

        def flush():
            text = _tidy(loose)
            loose.clear()
            if text:
                out.append(("p", text))

        for j in self.tree.children(i):
            if j in self.gone or j in self.notes.skip and not note:
                continue
            if self.tree.kind[j] == ELEMENT and self.tree.tag[j] in BLOCK:
                flush()
                out += self.block(j)
            else:
                loose.append(self.inline(j))
        flush()
        return out

    def block(self, i: int) -> Blocks:
        tree = self.tree
        while tree.transparent(i):  # towers of wrappers
            inner = list(tree.children(i))
            if len(inner) != 1 or tree.kind[inner[0]] != ELEMENT or not tree.transparent(inner[0]):
                break
            i = inner[0]
        name = tree.tag[i]
        if name[0] == "h" and name[1:].isdigit():
            text = _tidy(self.inline(j) for j in tree.children(i))
            return Blocks([("h", int(name[1]), text)] if text else [])
        if name in ("ul", "ol"):
            items = [b for j in tree.children(i) if tree.tag[j] == "li" and j not in self.gone and (b := self.inside(j))]
            return Blocks([(name, items)] if items else [])
        if name == "blockquote":
            inner = self.inside(i)
            return Blocks([("quote", inner)] if inner else [])
        if name == "pre":
            return Blocks([("code", self.code(i))])
        if name == "hr":
            return Blocks([("hr",)])
        if name == "table":
            return self.table(i)
        return self.inside(i)

    def code(self, i: int) -> str:
        inner = [j for j in self.tree.children(i) if self.tree.kind[j] == ELEMENT or self.tree.text[j].strip()]
        if len(inner) == 1 and self.tree.tag[inner[0]] == "code":
            i = inner[0]
        parts = [self.tree.text[j] if self.tree.kind[j] == TEXT else "\n" if self.tree.tag[j] == "br" else "" for j in range(i + 1, self.tree.end[i]) if self.tree.kind[j] != RAW]
        return "".join(parts).strip("\n")

    def _only_child(self, i: int) -> int | None:
        """The child of a plain element that holds nothing else; deep wrappers are walked, not recursed into."""
        tree = self.tree
        special = tree.kind[i] != ELEMENT or i in self.gone or i in self.notes.label or tree.tag[i] in SKIP or tree.tag[i] in MARKS or tree.tag[i] in ("br", "img", "code", "a")
        return i + 1 if not special and i + 1 < tree.end[i] == tree.end[i + 1] else None

    def inline(self, i: int) -> str:
        tree = self.tree
        while (inner := self._only_child(i)) is not None:
            i = inner
        if tree.kind[i] == RAW or i in self.gone:
            return ""
        if tree.kind[i] == TEXT:
            return re.sub(r"\s+", " ", tree.text[i])
        name, attrs = tree.tag[i], tree.attrs[i]
        if name in SKIP:
            return ""
        if name == "br":
            return HARD_BREAK
        if name == "img":
            return self.image(attrs)
        if i in self.notes.label:
            return f"[^{self.notes.label[i]}]"
        if name == "code":
            body = "".join(tree.text[j] for j in range(i, tree.end[i]) if tree.kind[j] == TEXT)
            return f"`{body}`" if body else ""
        inner = _glue(self.inline(j) for j in tree.children(i))
        if name == "a":
            return self.link(attrs.get("href", ""), inner)
        if name in MARKS:
            return wrap(inner, MARKS[name])
        return inner

    def link(self, href: str, inner: str) -> str:
        body = inner.strip()
        fragment = href.rpartition("#")[2] if "#" in href else ""
        if fragment and fragment in self.notes.back:
            return ""
        if not href or not body or href.startswith("#"):
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
        return f"{' ' if lead else ''}[{body}]({href}){' ' if tail else ''}"

    def image(self, attrs: dict) -> str:
        source = attrs.get("src", "")
        if not source or source.startswith("data:"):
            return ""
        return f"![{attrs.get('alt') or 'Image'}]({self.images.get(source, source)})"

    def cells(self, row: int) -> list[int]:
        return [j for j in self.tree.children(row) if self.tree.tag[j] in ("td", "th") and j not in self.gone]

    def table(self, i: int) -> Blocks:
        rows = [r for r in html_text.rows(self.tree, i) if r not in self.gone]
        if is_layout(self.tree, i):
            out = Blocks()
            for r in rows:
                line = []
                for c in self.cells(r):
                    blocks = self.inside(c)
                    if len(blocks) == 1 and blocks[0][0] == "p":
                        line.append(blocks[0][1])
                        continue
                    if line:
                        out.append(("p", " ".join(line)))
                        line = []
                    out += blocks
                if line:
                    out.append(("p", " ".join(line)))
            return out
        grid = [[" ".join(_tidy([self.inline(j) for j in self.tree.children(c)]).split()) or " ".join(flat(self.inside(c))) for c in self.cells(r)] for r in rows]
        width = max((len(r) for r in grid), default=0)
        return Blocks([("table", [r + [""] * (width - len(r)) for r in grid])] if width else [])


def flat(blocks: Blocks) -> list[str]:
    """The texts of blocks in order."""
    out = []
    for b in blocks:
        if b[0] in ("p", "code"):
            out.append(" ".join(b[1].split()))
        elif b[0] == "h":
            out.append(b[2])
        elif b[0] in ("ul", "ol"):
            out += [t for item in b[1] for t in flat(item)]
        elif b[0] == "quote":
            out += flat(b[1])
    return out


# The children that make a cell a block of content.
CELL_BLOCKS = frozenset(("p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"))


def is_layout(tree: Tree, i: int) -> bool:
    """A table that only arranges: seven tests in order."""
    rows = html_text.rows(tree, i)
    cells = [[c for c in tree.children(r) if tree.tag[c] in ("td", "th")] for r in rows]
    if any(_nested(tree, c) for r in cells for c in r) or len(rows) <= 1 or len(cells[0]) <= 1:
        return True
    every = [c for r in cells for c in r]
    inside = {c: [tree.tag[j] for j in tree.children(c) if tree.kind[j] == ELEMENT] for c in every}
    only_image = [c for c in every if inside[c] == ["img"]]
    if len(only_image) > 0.5 * len(every):
        return True
    if sum(sum(t in CELL_BLOCKS for t in inside[c]) >= 3 for c in every) > 0.3 * len(every):
        return True
    return pstdev(len(r) for r in cells) > 1.0


def _nested(tree: Tree, cell: int) -> bool:
    stack = [cell]
    while stack:
        for j in tree.children(stack.pop()):
            if tree.tag[j] == "table":
                return True
            if tree.tag[j] in ("tr", "td", "th", "thead", "tbody", "tfoot"):
                stack.append(j)
    return False


def wrap(inner: str, mark: str) -> str:
    """Emphasis with its outer white space outside the marks."""
    body = inner.strip()
    if not body:
        return inner
    return ("" if inner[0] == body[0] else " ") + mark + body + mark + ("" if inner[-1] == body[-1] else " ")


def _glue(parts) -> str:
    out = ""
    for p in parts:
        if p.startswith(" ") and p != HARD_BREAK and (out.endswith(" ") or out.endswith("\n")):
            p = p[1:]
        out += p
    return out


def _tidy(parts) -> str:
    text = _glue(parts)
    while text.startswith(HARD_BREAK) or text[:1].isspace():
        text = text.lstrip()
    return re.sub(r" +(  \n)", r"\1", text).strip()


def lines(blocks: Blocks, kind: str | None = None) -> list[str]:
    """Markdown lines.  Nested lists are indented only below a list of their own kind, as the format fixes it."""
    out: list[str] = []
    for b in blocks:
        block = _lines(b, kind)
        tight = kind in ("ul", "ol") and b[0] in ("ul", "ol") or kind == "quote" and b[0] == "quote" and out
        if out and not tight:
            out.append("")
        out += block
    return out


def _lines(b: tuple, outer: str | None) -> list[str]:
    kind = b[0]
    if kind == "p":
        return b[1].split("\n")
    if kind == "h":
        return ["#" * b[1] + " " + b[2].replace("  \n", " ")]
    if kind == "hr":
        return ["-----"]
    if kind == "code":
        fence = "```"
        while fence in b[1]:
            fence += "`"
        return [fence, *b[1].split("\n"), fence]
    if kind == "quote":
        return ["> " + x for x in lines(b[1], "quote")]
    if kind == "table":
        row = lambda cells: "|" + "|".join(c.replace("|", "\\|") for c in cells) + "|"
        widths = [max(2, *(len(r[i]) for r in b[1])) for i in range(len(b[1][0]))]
        return [row(b[1][0]), "|" + "|".join("-" * w for w in widths) + "|", *map(row, b[1][1:])]
    if kind == "note":
        body = lines(b[2])
        return [f"[^{b[1]}]: {body[0] if body else ''}".rstrip(), *("    " + x if x else "" for x in body[1:])]
    out = []
    for number, item in enumerate(b[1], 1):
        mark = "- " if kind == "ul" else f"{number}. "
        for block in item:
            other = block[0] in ("ul", "ol") and block[0] != kind
            inner = lines(Blocks([block]), kind)
            pad = "" if other else " " * len(mark)
            if block is item[0]:
                out += [mark + inner[0], *(pad + x if x else x for x in inner[1:])]
            else:
                if block[0] not in ("ul", "ol"):
                    out.append("")
                out += [pad + x if x else x for x in inner]
    return out


def markdown(tree: Tree, top: int = 0, gone: set[int] | frozenset[int] = frozenset(), images: dict[str, str] | None = None) -> str:
    return "\n".join(lines(Converter(tree, top, gone, images).blocks())).strip("\n")
