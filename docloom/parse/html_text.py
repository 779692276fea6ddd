"""Plain text of an HTML subtree."""

from __future__ import annotations

import re

from docloom.parse.html_tree import ELEMENT, RAW, TEXT, Tree

# Tags without text, and block tags that end in an empty line.
SKIP = frozenset("script style iframe nav meta link title select input button noscript footer".split())
BLOCK = frozenset("p div ul ol h1 h2 h3 h4 h5 h6 blockquote pre figure table noscript".split())
_SPACE = re.compile(r"\s+")


def collapse(text: str) -> str:
    """White space runs to one space; a leading or trailing blank stays as one."""
    body = _SPACE.sub(" ", text.strip())
    return (" " if text.startswith(" ") else "") + body + (" " if text.endswith(" ") else "")


def end_paragraph(text: str) -> str:
    """At least two newlines at the end of a text that is not empty."""
    if not text:
        return text
    return text + "\n" * max(0, 2 - (len(text) - len(text.rstrip("\n"))))


def leaf(tree: Tree, i: int) -> str:
    return tree.text[i] if tree.tag[tree.parent[i]] in ("pre", "code") else collapse(tree.text[i])


def rows(tree: Tree, i: int) -> list[int]:
    """The rows of a table, also those in its sections."""
    found = []
    for j in tree.children(i):
        if tree.tag[j] == "tr":
            found.append(j)
        elif tree.tag[j] in ("thead", "tbody", "tfoot"):
            found += [k for k in tree.children(j) if tree.tag[k] == "tr"]
    return found


def text(tree: Tree, top: int = 0, gone: frozenset[int] | set[int] = frozenset()) -> str:
    """Text of the subtree ``top`` less the subtrees ``gone``, from the leaves up."""
    done: dict[int, str] = {}
    i = tree.end[top] - 1
    hidden = set()
    for g in gone:
        hidden.update(range(g, tree.end[g]))
    while i >= top:
        if i in hidden or tree.kind[i] == RAW:
            done[i] = ""
        elif tree.kind[i] == TEXT:
            done[i] = leaf(tree, i)
        else:
            done[i] = _element(tree, i, done)
        i -= 1
    return done[top]


def _element(tree: Tree, i: int, done: dict[int, str]) -> str:
    name = tree.tag[i]
    if name in SKIP:
        return ""
    parts = [done[j] for j in tree.children(i)]
    if name == "br":
        out = "\n"
    elif name in ("ul", "ol"):
        out = "".join(end_paragraph(p.strip()) for p in parts)
    elif name == "li":
        out = "".join(parts).strip()
    elif name == "table":
        out = "".join(done[r].strip() + "\n" for r in rows(tree, i) if done[r].strip())
    elif name == "tr":
        out = " | ".join(p.strip() for p in parts if p.strip())
    else:
        out = "".join(parts)
    return end_paragraph(out) if name in BLOCK else out


__all__ = ["BLOCK", "ELEMENT", "SKIP", "collapse", "end_paragraph", "leaf", "rows", "text"]
