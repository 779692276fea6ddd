"""Style sheets: declarations, selectors and what applies to the nodes of a flat HTML tree."""

from __future__ import annotations

import re
from functools import lru_cache

from docloom.parse.html_tree import ELEMENT, Tree

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]|:(?P<pseudo>first-child|last-child|only-child|empty|root)""")
# Properties that children take over, and the sides of box shorthands.
INHERITED = frozenset("color font-family font-size font-style font-weight line-height list-style-type text-align text-indent text-transform visibility white-space direction quotes".split())
SIDES = ("top", "right", "bottom", "left")
# What the parts of border shorthands may be, and the standard's colour names.
BORDER_STYLES = frozenset("none hidden solid dashed dotted double groove ridge inset outset".split())
BORDER_WIDTHS = frozenset("thin medium thick".split())
COLORS = frozenset(
    """
    transparent currentcolor aliceblue antiquewhite aqua aquamarine azure beige bisque black blanchedalmond blue blueviolet brown burlywood cadetblue chartreuse
    chocolate coral cornflowerblue cornsilk crimson cyan darkblue darkcyan darkgoldenrod darkgray darkgreen darkgrey darkkhaki darkmagenta darkolivegreen darkorange
    darkorchid darkred darksalmon darkseagreen darkslateblue darkslategray darkslategrey darkturquoise darkviolet deeppink deepskyblue dimgray dimgrey dodgerblue
    firebrick floralwhite forestgreen fuchsia gainsboro ghostwhite gold goldenrod gray green greenyellow grey honeydew hotpink indianred indigo ivory khaki lavender
    lavenderblush lawngreen lemonchiffon lightblue lightcoral lightcyan lightgoldenrodyellow lightgray lightgreen lightgrey lightpink lightsalmon lightseagreen
    lightskyblue lightslategray lightslategrey lightsteelblue lightyellow lime limegreen linen magenta maroon mediumaquamarine mediumblue mediumorchid mediumpurple
    mediumseagreen mediumslateblue mediumspringgreen mediumturquoise mediumvioletred midnightblue mintcream mistyrose moccasin navajowhite navy oldlace olive olivedrab
    orange orangered orchid palegoldenrod palegreen paleturquoise palevioletred papayawhip peachpuff peru pink plum powderblue purple rebeccapurple red rosybrown
    royalblue saddlebrown salmon sandybrown seagreen seashell sienna silver skyblue slateblue slategray slategrey snow springgreen steelblue tan teal thistle tomato
    turquoise violet wheat white whitesmoke yellow yellowgreen
    """.split()
)
_VALUE = re.compile(r"""\"[^\"]*\"|'[^']*'|[^\s(]*\((?:[^()]|\([^()]*\))*\)|[^\s(]+""")
_LENGTH = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[a-z]+)?", re.I)
_N, _PCT = r"\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*", r"\s*[+-]?(?:\d+\.?\d*|\.\d+)%\s*"
_RGB = rf"(?:\s*[+-]?\d+\s*(?:,\s*[+-]?\d+\s*){{2}}|{_PCT},{_PCT},{_PCT})"
_HSL = rf"{_N},{_PCT},{_PCT}"
_COLOR_CALL = re.compile(rf"rgb\({_RGB}\)|rgba\({_RGB},{_N}\)|hsl\({_HSL}\)|hsla\({_HSL},{_N}\)", re.I)
_HEX = re.compile(r"#(?:[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", re.I)


def is_color(token: str) -> bool:
    return token.lower() in COLORS or bool(_HEX.fullmatch(token) or _COLOR_CALL.fullmatch(token))


def longhands(name: str, value: str) -> list[tuple[str, str]]:
    """(property, value) of what a shorthand sets; none for a box of no or over four values, and for a background without a colour."""
    parts = _VALUE.findall(value)
    head, _, tail = name.partition("-")
    if name in ("margin", "padding") or (head == "border" and tail in ("width", "style", "color")):
        if not 1 <= len(parts) <= 4:
            return []
        right = parts[min(1, len(parts) - 1)]
        given = (parts[0], right, parts[2] if len(parts) > 2 else parts[0], parts[3] if len(parts) > 3 else right)
        return [(f"{head}-{s}" + (f"-{tail}" if tail else ""), v) for s, v in zip(SIDES, given, strict=True)]
    if name == "border" or (head == "border" and tail in SIDES):
        # what is left out goes back to its first value
        own = {"width": "medium", "style": "none", "color": "currentcolor"}
        for part in parts:
            if part.lower() in BORDER_STYLES:
                own["style"] = part
            elif part.lower() in BORDER_WIDTHS or _LENGTH.fullmatch(part):
                own["width"] = part
            elif is_color(part):
                own["color"] = part
        return [(f"border-{s}-{kind}", v) for s in ([tail] if tail else SIDES) for kind, v in own.items()]
    if name in ("page-break-before", "page-break-after", "page-break-inside"):
        return [(tail, value)]
    if name == "background":
        return [("background-color", part) for part in parts if is_color(part)][:1]
    return [(name, value)]


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of a declaration list, shorthands as what they set."""
    out = []
    for part in re.split(r";(?=(?:[^\"']|\"[^\"]*\"|'[^']*')*$)", _COMMENT.sub("", text)):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon or not name or not value:
            continue
        important = bool(re.search(r"!\s*important$", value, re.I))
        value = re.sub(r"\s*!\s*important$", "", value, flags=re.I)
        out += [(prop, v, important) for prop, v in longhands(name, value)]
    return out


def rules(css: str) -> list[dict]:
    """Rows (ord, selector, a, b, c, prop, value, important) of a style sheet; at-rules other than ``@media`` for all or print are left out."""
    out: list[dict] = []

    def walk(text: str) -> None:
        at = 0
        while (brace := text.find("{", at)) >= 0:
            head, depth, end = text[at:brace].strip().rpartition(";")[2].strip(), 1, brace + 1
            while end < len(text) and depth:
                depth += {"{": 1, "}": -1}.get(text[end], 0)
                end += 1
            body = text[brace + 1 : end - 1 if not depth else end]
            at = end
            if head.startswith("@"):
                if re.match(r"@media\s+(all|print)\b", head):
                    walk(body)
                continue
            for selector in filter(None, (s.strip() for s in head.split(","))):
                weight = specificity(selector)
                for prop, value, important in declarations(body):
                    out.append({"ord": len(out), "selector": selector, "a": weight[0], "b": weight[1], "c": weight[2], "prop": prop, "value": value, "important": important})

    walk(_COMMENT.sub("", css))
    return out


@lru_cache(maxsize=4096)
def _compounds(selector: str) -> list[tuple[str, list[re.Match]]]:
    """(combinator before it, simple selectors) from left to right."""
    tokens = re.findall(r"\s*[>+~]\s*|\s+|(?:\[[^\]]*\]|[^\s>+~\[])+", selector.strip())
    out, joint = [], ""
    for t in tokens:
        if t.strip() in (">", "+", "~", ""):
            joint = t.strip() or " "
        else:
            out.append((joint, list(_PART.finditer(t))))
            joint = " "
    return out


def specificity(selector: str) -> tuple[int, int, int]:
    a = b = c = 0
    for _, parts in _compounds(selector):
        for m in parts:
            a += m["id"] is not None
            b += any(m[g] is not None for g in ("cls", "attr", "pseudo"))
            c += m["tag"] not in (None, "*")
    return a, b, c


def _siblings(tree: Tree, i: int) -> list[int]:
    return [j for j in tree.children(tree.parent[i]) if tree.kind[j] == ELEMENT]


def _simple(tree: Tree, i: int, m: re.Match) -> bool:
    attrs = tree.attrs[i]
    if m["tag"]:
        return m["tag"] in ("*", tree.tag[i]) or m["tag"].lower() == tree.tag[i]
    if m["id"]:
        return attrs.get("id") == m["id"]
    if m["cls"]:
        return m["cls"] in attrs.get("class", "").split()
    if m["attr"]:
        have, want = attrs.get(m["attr"].lower()), m["dq"] if m["dq"] is not None else m["sq"] if m["sq"] is not None else m["bare"]
        if have is None or m["op"] is None:
            return have is not None
        return {"=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"), "^=": have.startswith(want), "$=": have.endswith(want), "*=": want in have}[m["op"]]
    if m["pseudo"] == "root":
        return tree.parent[i] == 0
    if m["pseudo"] == "empty":
        return tree.end[i] == i + 1
    around = _siblings(tree, i)
    return {"first-child": around[0] == i, "last-child": around[-1] == i, "only-child": around == [i]}[m["pseudo"]]


def matches(tree: Tree, i: int, selector: str) -> bool:
    """Whether a selector (descendant, child, adjacent and general sibling) applies to a node."""
    parts = _compounds(selector)

    def fits(node: int, k: int) -> bool:
        if node <= 0 or not all(_simple(tree, node, m) for m in parts[k][1]):
            return False
        if k == 0:
            return True
        joint = parts[k][0]
        if joint == ">":
            return fits(tree.parent[node], k - 1)
        if joint in ("+", "~"):
            before = [j for j in _siblings(tree, node) if j < node]
            return any(fits(j, k - 1) for j in (before[-1:] if joint == "+" else before))
        up = tree.parent[node]
        while up > 0:
            if fits(up, k - 1):
                return True
            up = tree.parent[up]
        return False

    return bool(parts) and fits(i, len(parts) - 1)


def _anchor(selector: str) -> str | None:
    """An id, class or tag without which a node cannot match; ``*`` if there is none, None for a selector that matches nothing."""
    parts = _compounds(selector)
    if not parts:
        return None
    simple = parts[-1][1]
    for group, mark in (("id", "#"), ("cls", "."), ("tag", "")):
        for m in simple:
            if m[group] and m[group] != "*":
                return mark + (m[group] if mark else m[group].lower())
    return "*"


def styles(tree: Tree, css: str) -> list[dict]:
    """Rows (node_id, prop, value, inherited): cascade by importance, inline style, specificity and order, then inheritance."""
    anchored: dict[str | None, dict[str, list[dict]]] = {}
    for r in rules(css):
        anchored.setdefault(_anchor(r["selector"]), {}).setdefault(r["selector"], []).append(r)
    computed: dict[int, dict[str, str]] = {0: {}}
    out = []
    for i in range(1, len(tree)):
        if tree.kind[i] != ELEMENT:
            continue
        best: dict[str, tuple] = {}
        attrs = tree.attrs[i]
        places = dict.fromkeys(["*", tree.tag[i].lower(), f"#{attrs.get('id', '')}", *(f".{c}" for c in attrs.get("class", "").split())])
        met = [held for place in places for selector, held in anchored.get(place, {}).items() if matches(tree, i, selector)]
        for held in met:
            for r in held:
                key = (r["important"], 0, r["a"], r["b"], r["c"], r["ord"])
                if r["prop"] not in best or key > best[r["prop"]][0]:
                    best[r["prop"]] = (key, r["value"])
        for n, (prop, value, important) in enumerate(declarations(attrs.get("style", ""))):
            key = (important, 1, 0, 0, 0, n)
            if prop not in best or key > best[prop][0]:
                best[prop] = (key, value)
        above = computed[tree.parent[i]]
        own = {p: v for p, (_, v) in best.items()}
        own = {p: above.get(p, "initial") if v == "inherit" else v for p, v in own.items()}
        taken = {p: v for p, v in above.items() if p in INHERITED and p not in own}
        computed[i] = own | taken
        out += [{"node_id": i, "prop": p, "value": v, "inherited": p in taken} for p, v in computed[i].items()]
    return out
