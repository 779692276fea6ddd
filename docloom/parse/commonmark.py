"""Markdown (CommonMark with tables, task items, strikethrough, footnotes) to a tree of tuples.

Blocks: ("heading", level, inlines), ("para", inlines), ("quote", blocks),
("list", ordered, start, tight, [(checked | None, blocks)]), ("code", info, text),
("html", text), ("hr",), ("table", aligns, [rows of cells of inlines]).
Inlines: ("text", s), ("code", s), ("em" | "strong" | "del", inlines),
("link", href, title, inlines), ("image", src, title, inlines), ("html", s),
("soft",), ("hard",), ("note", id).
"""

from __future__ import annotations

import html
import re

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"^( {0,3})(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_REFERENCE = re.compile(r"^ {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^()]*)\)))?[ \t]*$")
_HTML_BLOCK = re.compile(r"^ {0,3}<(?:!--|\?|![A-Za-z]|/?(?:address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul|script|pre|style|textarea)(?:[ \t/>]|$))", re.I)
_HTML_ALONE = re.compile(r"^ {0,3}(?:<[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>|</[A-Za-z][\w-]*\s*>)[ \t]*$")
_DELIMITER_ROW = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_NOTE = re.compile(r"^ {0,3}\[\^([^\s\]]+)\]:[ \t]?(.*)$")
_PUNCTUATION = r"!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~"
_INLINE = re.compile(
    r"(?P<esc>\\[" + _PUNCTUATION + r"])|(?P<hard>(?: {2,}|\\)\n[ \t]*)|(?P<soft>[ \t]*\n[ \t]*)|(?P<code>`+)"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>"
    r"|(?P<html><(?:[A-Za-z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?|/[A-Za-z][\w-]*\s*|!--(?:(?!--)[\s\S])*--)>)"
    r"|(?P<entity>&(?:#[xX][0-9a-fA-F]{1,6}|#\d{1,7}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<note>\[\^[^\s\]]+\])|(?P<bang>!\[)|(?P<open>\[)|(?P<close>\])|(?P<mark>\*+|_+|~+)"
)


class Parser:
    """Parses with the link references and footnotes of one document."""

    def __init__(self, notes: dict[str, str] | None = None):
        self.references: dict[str, tuple[str, str]] = {}
        self.notes = notes or {}

    # ---- blocks ----

    def blocks(self, lines: list[str]) -> list[tuple]:
        out: list[tuple] = []
        i, n = 0, len(lines)
        para: list[str] = []

        def flush():
            while para and (m := _REFERENCE.match(para[0])):
                self.references.setdefault(_key(m[1]), (_unescape(m[2] if m[2] is not None else m[3]), _unescape(m[4] or m[5] or m[6] or "")))
                para.pop(0)
            if para:
                out.append(("para", "\n".join(x.strip(" \t") if k == len(para) - 1 else x.lstrip(" \t") for k, x in enumerate(para))))
            para.clear()

        while i < n:
            line = lines[i]
            if not line.strip():
                flush()
                i += 1
                continue
            if not para and line.startswith(("    ", "\t")):
                block = []
                while i < n and (lines[i].startswith(("    ", "\t")) or not lines[i].strip()):
                    block.append(lines[i][1:] if lines[i].startswith("\t") else lines[i][4:])
                    i += 1
                while block and not block[-1].strip():
                    block.pop()
                out.append(("code", "", "\n".join(block)))
                continue
            if m := _FENCE.match(line):
                flush()
                mark, pad, block = m[2], len(m[1]), []
                i += 1
                closing = re.compile(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
                while i < n and not closing.match(lines[i]):
                    body = lines[i]
                    block.append(body[min(pad, len(body) - len(body.lstrip(" "))) :])
                    i += 1
                i += 1
                out.append(("code", _unescape(m[3]), "\n".join(block)))
                continue
            if m := _ATX.match(line):
                flush()
                out.append(("heading", len(m[1]), (m[2] or "").strip(" \t#") if not (m[2] or "").strip("#") else (m[2] or "").strip()))
                i += 1
                continue
            if para and (m := _SETEXT.match(line)):
                text = "\n".join(x.strip() for x in para)
                para.clear()
                out.append(("heading", 1 if m[1][0] == "=" else 2, text))
                i += 1
                continue
            if _RULE.match(line):
                flush()
                out.append(("hr",))
                i += 1
                continue
            if _QUOTE.match(line):
                flush()
                inner = []
                while i < n and lines[i].strip():
                    if m := _QUOTE.match(lines[i]):
                        inner.append(lines[i][m.end() :])
                    elif inner and inner[-1].strip() and not self._interrupts(lines[i]):
                        inner.append(lines[i])
                    else:
                        break
                    i += 1
                out.append(("quote", self.blocks(inner)))
                continue
            m = _ITEM.match(line)
            if m and not (para and ((m[4] or "") == "" or m[2][0].isdigit() and m[2][:-1] != "1")):
                flush()
                block, i = self._list(lines, i)
                out.append(block)
                continue
            if _HTML_BLOCK.match(line) or not para and _HTML_ALONE.match(line):
                flush()
                block = []
                ends = _html_end(line)
                while i < n:
                    if ends is None and not lines[i].strip():
                        break
                    block.append(lines[i])
                    i += 1
                    if ends is not None and ends in block[-1].lower():
                        break
                out.append(("html", "\n".join(block)))
                continue
            if "|" in line and i + 1 < n and _DELIMITER_ROW.match(lines[i + 1]) and len(_cells(line)) == len(_cells(lines[i + 1])):
                flush()
                block, i = self._table(lines, i)
                out.append(block)
                continue
            para.append(line)
            i += 1
        flush()
        return out

    @staticmethod
    def _interrupts(line: str) -> bool:
        return bool(_FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _ITEM.match(line) or _HTML_BLOCK.match(line))

    def _list(self, lines: list[str], i: int) -> tuple[tuple, int]:
        first = _ITEM.match(lines[i])
        kind = first[2][-1]
        ordered = kind in ".)"
        start = int(first[2][:-1]) if ordered else 1
        items, loose, n = [], False, len(lines)
        while i < n:
            m = _ITEM.match(lines[i])
            if not m or m[2][-1] != kind or _RULE.match(lines[i]):
                break
            gap = len((m[3] or " ").expandtabs(4))
            width = len(m[1]) + len(m[2]) + (gap if m[4] and gap <= 4 else 1)
            body = [" " * (gap - 1 if m[4] and gap > 4 else 0) + (m[4] or "")]
            i += 1
            blank = False
            while i < n:
                line = lines[i].expandtabs(4) if lines[i].startswith("\t") else lines[i]
                if not line.strip():
                    blank = True
                    body.append("")
                elif len(line) - len(line.lstrip(" ")) >= width:
                    body.append(line[width:])
                    blank = False
                elif blank or _ITEM.match(line) or self._interrupts(line) or _QUOTE.match(line):
                    break
                else:
                    body.append(line.lstrip(" "))
                i += 1
            trailing = 0
            while body and not body[-1]:
                body.pop()
                trailing += 1
            more = i < n and (nxt := _ITEM.match(lines[i])) and nxt[2][-1] == kind
            checked = None
            if body and (task := re.match(r"^\[([ xX])\][ \t]+(?=\S)", body[0])):
                checked, body[0] = task[1] != " ", body[0][task.end() :]
            blocks = self.blocks(body)
            loose |= bool(trailing and more) or _gaps(body, blocks)
            items.append((checked, blocks))
        return ("list", ordered, start, not loose, items), i

    def _table(self, lines: list[str], i: int) -> tuple[tuple, int]:
        head, aligns = _cells(lines[i]), []
        for c in _cells(lines[i + 1]):
            aligns.append("center" if c.startswith(":") and c.endswith(":") else "right" if c.endswith(":") else "left" if c.startswith(":") else None)
        rows, i = [head], i + 2
        while i < len(lines) and lines[i].strip() and not self._interrupts(lines[i]) and not _QUOTE.match(lines[i]):
            cells = _cells(lines[i])
            rows.append((cells + [""] * len(head))[: len(head)])
            i += 1
        return ("table", aligns, rows), i

    # ---- inlines ----

    def resolved(self, blocks: list[tuple]) -> list[tuple]:
        """Blocks with their raw texts parsed to inlines; runs when all references are known."""
        out = []
        for b in blocks:
            if b[0] == "para":
                out.append(("para", self.inlines(b[1])))
            elif b[0] == "heading":
                out.append(("heading", b[1], self.inlines(b[2])))
            elif b[0] == "quote":
                out.append(("quote", self.resolved(b[1])))
            elif b[0] == "list":
                out.append((*b[:4], [(c, self.resolved(x)) for c, x in b[4]]))
            elif b[0] == "table":
                out.append(("table", b[1], [[self.inlines(c.replace("\\|", "|")) for c in r] for r in b[2]]))
            else:
                out.append(b)
        return out

    def inlines(self, text: str) -> list[tuple]:
        nodes: list = []  # tuples, and lists [mark, count, can_open, can_close] for delimiter runs
        brackets: list[tuple[int, bool, int]] = []
        at = 0

        def plain(s: str):
            if s:
                nodes.append(("text", s))

        while at < len(text):
            m = _INLINE.search(text, at)
            if not m:
                break
            plain(text[at : m.start()])
            at, kind = m.end(), m.lastgroup
            if kind == "esc":
                plain(m[0][1])
            elif kind == "hard":
                nodes.append(("hard",))
            elif kind == "soft":
                nodes.append(("soft",))
            elif kind == "code":
                close = re.compile(rf"(?<!`){m[0]}(?!`)").search(text, at)
                if close:
                    body = text[at : close.start()].replace("\n", " ")
                    if body.strip(" ") and body[0] == " " == body[-1]:
                        body = body[1:-1]
                    nodes.append(("code", body))
                    at = close.end()
                else:
                    plain(m[0])
            elif kind == "auto":
                href = m["auto"] if ":" in m["auto"] else "mailto:" + m["auto"]
                nodes.append(("link", href, "", [("text", m["auto"])]))
            elif kind == "html":
                nodes.append(("html", m[0]))
            elif kind == "entity":
                plain(html.unescape(m[0]))
            elif kind == "note" and m[0][2:-1] in self.notes:
                nodes.append(("note", m[0][2:-1]))
            elif kind == "note":
                at = m.start() + 1
                brackets.append((len(nodes), False, at))
                plain("[")
            elif kind in ("bang", "open"):
                brackets.append((len(nodes), kind == "bang", at))
                plain(m[0])
            elif kind == "close":
                at = self._close(text, at, nodes, brackets)
            else:
                before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
                left = not after.isspace() and (not _punct(after) or before.isspace() or _punct(before))
                right = not before.isspace() and (not _punct(before) or after.isspace() or _punct(after))
                if m[0][0] == "_":
                    left, right = left and (not right or _punct(before)), right and (not left or _punct(after))
                nodes.append([m[0][0], len(m[0]), left, right])
        plain(text[at:])
        return _joined(_emphasis(nodes))

    def _close(self, text: str, at: int, nodes: list, brackets: list) -> int:
        if not brackets:
            nodes.append(("text", "]"))
            return at
        place, image, begin = brackets.pop()
        target = None
        if m := re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)").match(text, at):
            target, after = (_unescape(m[1] if m[1] is not None else m[2] or ""), _unescape(m[3] or m[4] or m[5] or "")), m.end()
        else:
            m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at)
            label = m[1] if m and m[1] else text[begin : at - 1]
            if _key(label) in self.references:
                target, after = self.references[_key(label)], m.end() if m else at
        if target is None:
            nodes.append(("text", "]"))
            return at
        inner = _joined(_emphasis(nodes[place + 1 :]))
        del nodes[place:]
        nodes.append(("image" if image else "link", *target, inner))
        if not image:  # no links inside links
            brackets[:] = [b for b in brackets if b[1]]
        return after


def _emphasis(nodes: list) -> list[tuple]:
    """Pairs delimiter runs from the innermost out."""
    i = 0
    while i < len(nodes):
        closer = nodes[i]
        if not isinstance(closer, list) or not closer[3] or not closer[1]:
            i += 1
            continue
        j = i - 1
        while j >= 0:
            o = nodes[j]
            if isinstance(o, list) and o[0] == closer[0] and o[2] and o[1]:
                odd = (o[3] or closer[2]) and (o[1] + closer[1]) % 3 == 0 and not (o[1] % 3 == 0 and closer[1] % 3 == 0)
                if closer[0] == "~" and o[1] != closer[1] or closer[0] != "~" and odd:
                    j -= 1
                    continue
                break
            j -= 1
        if j < 0:
            i += 1
            continue
        opener = nodes[j]
        use = opener[1] if closer[0] == "~" else 2 if opener[1] >= 2 and closer[1] >= 2 else 1
        if closer[0] == "~" and use > 2:
            i += 1
            continue
        inner = _joined([_literal(x) for x in nodes[j + 1 : i]])
        kind = "del" if closer[0] == "~" else "strong" if use == 2 else "em"
        opener[1] -= use
        closer[1] -= use
        nodes[j + 1 : i] = [(kind, inner)]
        i = j + 2
        if not opener[1]:
            del nodes[j]
            i -= 1
        if not closer[1]:
            del nodes[i]
    return [_literal(x) for x in nodes]


def _literal(x):
    return ("text", x[0] * x[1]) if isinstance(x, list) else x


def _joined(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for x in nodes:
        if x[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + x[1])
        elif x != ("text", ""):
            out.append(x)
    return out


def _punct(c: str) -> bool:
    return not c.isalnum() and not c.isspace()


def _key(label: str) -> str:
    return " ".join(label.split()).casefold()


def _unescape(s: str) -> str:
    return html.unescape(re.sub(rf"\\([{_PUNCTUATION}])", r"\1", s))


def _cells(line: str) -> list[str]:
    body = line.strip()
    body = body[1:] if body.startswith("|") else body
    if body.endswith("|") and not body.endswith("\\|"):
        body = body[:-1]
    return [c.strip() for c in re.split(r"(?<!\\)\|", body)]


def _html_end(line: str) -> str | None:
    head = line.lstrip().lower()
    for begin, end in (("<!--", "-->"), ("<?", "?>"), ("<script", "</script>"), ("<pre", "</pre>"), ("<style", "</style>"), ("<textarea", "</textarea>")):
        if head.startswith(begin):
            return end
    return None


def _gaps(body: list[str], blocks: list[tuple]) -> bool:
    """A blank line between two blocks of an item."""
    if len(blocks) < 2:
        return False
    fenced = False
    for k, line in enumerate(body):
        fenced ^= bool(_FENCE.match(line))
        if not line and not fenced and 0 < k < len(body) - 1 and not body[k + 1].startswith(" "):
            return True
    return False


def definitions(text: str, duplicate: str = "first") -> tuple[dict[str, str], list[str]]:
    """(footnote id -> body, the lines that are left).

    A definition goes on over lines indented by four spaces or a tab, also
    after blank lines; definitions in fences are text.  Of several with one id
    the ``first`` or the ``last`` counts.
    """
    found: dict[str, str] = {}
    rest: list[str] = []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, fence = 0, None
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            fence = None if fence and m[2].startswith(fence) else fence or m[2]
        m = None if fence else _NOTE.match(line)
        if not m:
            rest.append(line)
            i += 1
            continue
        body = [m[2]]
        i += 1
        while i < len(lines):
            if lines[i].startswith(("    ", "\t")):
                body.append(lines[i][1:] if lines[i].startswith("\t") else lines[i][4:])
            elif not lines[i].strip():
                j = i
                while j < len(lines) and not lines[j].strip():
                    j += 1
                if j == len(lines) or not lines[j].startswith(("    ", "\t")):
                    break
                body += [""] * (j - i)
                i = j - 1
            else:
                break
            i += 1
        if duplicate == "last" or m[1] not in found:
            found[m[1]] = "\n".join(body).strip("\n")
    return found, rest


class Document:
    """A parsed text: ``blocks``, and ``notes`` as (number, id, blocks) in the order of first reference."""

    def __init__(self, text: str | None, duplicate: str = "first"):
        bodies, rest = definitions(text or "", duplicate)
        parser = Parser(bodies)
        raw = parser.blocks(rest)
        raw_notes = {k: parser.blocks(v.split("\n")) for k, v in bodies.items()}
        self.blocks = parser.resolved(raw)
        self.notes: list[tuple[int, str, list[tuple]]] = []
        self.number: dict[str, int] = {}
        queue = list(_referenced(self.blocks))
        while queue:
            name = queue.pop(0)
            if name not in self.number:
                self.number[name] = len(self.number) + 1
                body = parser.resolved(raw_notes[name])
                self.notes.append((self.number[name], name, body))
                queue += _referenced(body)


def _referenced(nodes):
    """Footnote ids in document order."""
    stack = [iter(nodes)]
    while stack:
        node = next(stack[-1], None)
        if node is None:
            stack.pop()
        elif isinstance(node, tuple) and node and node[0] == "note":
            yield node[1]
        elif isinstance(node, tuple | list):
            stack.append(iter([x for x in node if isinstance(x, tuple | list)]))


def plain(inlines: list[tuple]) -> str:
    """Text of inlines: marks go, breaks are spaces, images give their alternative text."""
    out = []
    for x in inlines:
        if x[0] in ("text", "code"):
            out.append(x[1])
        elif x[0] in ("soft", "hard"):
            out.append(" ")
        elif x[0] in ("em", "strong", "del"):
            out.append(plain(x[1]))
        elif x[0] in ("link", "image"):
            out.append(plain(x[3]))
    return "".join(out)
