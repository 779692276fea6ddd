"""The main content of an HTML document: pruned, semantic or scored."""

from __future__ import annotations

from itertools import accumulate

from docloom.parse.html_tree import ELEMENT, TEXT, Tree

# What counts as page furniture and what as content.
FURNITURE_TAGS = frozenset("nav footer aside form dialog template script style noscript iframe svg canvas button select input textarea".split())
FURNITURE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog menu menubar toolbar".split())
FURNITURE_NAMES = (
    "cookie", "consent", "gdpr", "banner", "sidebar", "share", "social", "related", "comment", "footer", "masthead",
    "breadcrumb", "newsletter", "subscribe", "advert", "sponsor", "promo", "popup", "modal", "pagination", "navigation",
    "navbar", "menu", "widget", "toolbar", "skip-link", "back-to-top", "disqus", "paywall", "signup", "login",
)
CONTENT_NAMES = ("article", "entry", "post", "content", "main", "story", "blog", "hentry", "page-body", "text-body", "markdown")
TEXT_BLOCKS = frozenset("p pre blockquote td dd figcaption".split())
INNER_BLOCKS = frozenset("p div section article main aside header footer nav ul ol dl table blockquote pre figure h1 h2 h3 h4 h5 h6 form".split())
MIN_BLOCK, CONTENT_BONUS, CLIMB = 25, 25.0, 1.35


def _names(tree: Tree, i: int) -> str:
    return f"{tree.attrs[i].get('class', '')} {tree.attrs[i].get('id', '')}".lower()


class Measures:
    """Sums over subtrees as differences of running sums in document order."""

    def __init__(self, tree: Tree, gone: set[int]):
        n = len(tree)
        size, links, commas = [0] * n, [0] * n, [0] * n
        link_end = hidden_end = 0
        for i in range(n):
            if i in gone:
                hidden_end = max(hidden_end, tree.end[i])
            if tree.kind[i] == ELEMENT and tree.tag[i] == "a":
                link_end = max(link_end, tree.end[i])
            if tree.kind[i] == TEXT and i >= hidden_end:
                t = tree.text[i].strip()
                size[i] = len(t)
                links[i] = len(t) if i < link_end else 0
                commas[i] = t.count(",") + t.count("，")
        self.end = tree.end
        self._size, self._links, self._commas = ([0, *accumulate(x)] for x in (size, links, commas))

    def size(self, i: int) -> int:
        return self._size[self.end[i]] - self._size[i]

    def commas(self, i: int) -> int:
        return self._commas[self.end[i]] - self._commas[i]

    def link_density(self, i: int) -> float:
        size = self.size(i)
        return min(1.0, (self._links[self.end[i]] - self._links[i]) / size) if size else 0.0


def furniture(tree: Tree, i: int, size: int, total: int) -> bool:
    """Page furniture, unless the element holds more than half of the text."""
    if total > 0 and 2 * size > total:
        return False
    attrs = tree.attrs[i]
    return tree.tag[i] in FURNITURE_TAGS or "hidden" in attrs or attrs.get("role", "").lower() in FURNITURE_ROLES or any(x in _names(tree, i) for x in FURNITURE_NAMES)


def prune(tree: Tree, top: int) -> set[int]:
    """Roots of the subtrees below ``top`` that are furniture."""
    raw, gone = Measures(tree, set()), set()
    total, i = raw.size(top), top + 1
    while i < tree.end[top]:
        if tree.kind[i] == ELEMENT and furniture(tree, i, raw.size(i), total):
            gone.add(i)
            i = tree.end[i]
        else:
            i += 1
    return gone


def select(tree: Tree) -> tuple[int, set[int], str]:
    """(node, roots of pruned subtrees, tier) of the main content.

    Tiers: ``semantic``, ``scored``, ``pruned``, or ``whole`` when pruning
    leaves nothing.  Equal scores go to the first node in document order.
    """
    body = tree.find("body")
    top = body if body is not None else 0
    gone = prune(tree, top)
    m = Measures(tree, gone)
    available = m.size(top)
    if not available:
        return top, set(), "whole"
    hidden: set[int] = set()
    for g in gone:
        hidden.update(range(g, tree.end[g]))
    live = [i for i in range(top, tree.end[top]) if tree.kind[i] == ELEMENT and i not in hidden]
    for wanted in (lambda i: tree.tag[i] == "article", lambda i: tree.tag[i] == "main", lambda i: tree.attrs[i].get("role", "").lower() == "main"):
        found = [i for i in live if wanted(i)]
        if len(found) == 1 and m.size(found[0]) > 0 and 4 * m.size(found[0]) >= available:
            return found[0], gone, "semantic"
    best = _scored(tree, top, live, m)
    return (best, gone, "scored") if best is not None else (top, gone, "pruned")


def _scored(tree: Tree, top: int, live: list[int], m: Measures) -> int | None:
    scores: dict[int, float] = {}
    inner = {tree.parent[i] for i in live if tree.tag[i] in INNER_BLOCKS}
    for i in live:
        block = tree.tag[i] in TEXT_BLOCKS or (tree.tag[i] in ("div", "section") and i not in inner)
        if not block or m.size(i) < MIN_BLOCK:
            continue
        score, node = 1 + m.commas(i) + min(m.size(i) / 100, 3.0), i
        for level in (1, 2, 3):
            node = tree.parent[node]
            if node <= top:
                break
            scores[node] = scores.get(node, 0.0) + score / level
    bonus = lambda i: CONTENT_BONUS if any(x in _names(tree, i) for x in CONTENT_NAMES) else 0.0
    ranked = [((s + bonus(i)) * (1 - m.link_density(i)), -i) for i, s in scores.items()]
    if not ranked or max(ranked)[0] <= 0:
        return None
    node = -max(ranked)[1]
    base = max(1, m.size(node))
    while (up := tree.parent[node]) > top and tree.tag[up] not in ("body", "html") and bonus(up) and m.size(up) / base <= CLIMB:
        node = up
    return node
