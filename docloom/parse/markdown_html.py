"""Parsed Markdown to HTML or XHTML."""

from __future__ import annotations

from docloom.parse.commonmark import Document, plain

# Alert kinds with title and role.
ALERTS = {"note": ("Note", "note"), "tip": ("Tip", "note"), "important": ("Important", "note"), "warning": ("Warning", "alert"), "caution": ("Caution", "alert"), "experiment": ("Experiment", "note")}


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    return escape_text(s).replace('"', "&quot;")


def alert_of(blocks: list[tuple]) -> tuple[str, list[tuple]] | None:
    """(kind, blocks without the marker) of a quote that opens with ``[!KIND]`` or ``Kind:``."""
    if not blocks or blocks[0][0] != "para" or not blocks[0][1] or blocks[0][1][0][0] != "text":
        return None
    head = blocks[0][1][0][1]
    if head.startswith("[!") and "]" in head:
        kind, rest = head[2:].split("]", 1)
    elif ":" in head:
        kind, rest = head.split(":", 1)
    else:
        return None
    if kind.lower() not in ALERTS:
        return None
    tail = blocks[0][1][1:]
    rest = rest.removeprefix(" ")
    if rest:
        tail = [("text", rest), *tail]
    elif tail and tail[0] == ("soft",):
        tail = tail[1:]
    return kind.lower(), ([("para", tail)] if tail else []) + blocks[1:]


class Writer:
    """``raw`` passes raw HTML through; ``xhtml`` closes void elements."""

    def __init__(self, document: Document, raw: bool = False, xhtml: bool = False):
        self.document, self.raw, self.xhtml, self.seen = document, raw, xhtml, {}

    def void(self, body: str) -> str:
        return f"<{body} />" if self.xhtml else f"<{body}>"

    def html(self, s: str) -> str:
        return s if self.raw else escape_text(s)

    def inlines(self, nodes: list[tuple]) -> str:
        return "".join(map(self.inline, nodes))

    def inline(self, x: tuple) -> str:
        kind = x[0]
        if kind == "text":
            return escape_text(x[1])
        if kind == "code":
            return f"<code>{escape_text(x[1])}</code>"
        if kind in ("em", "strong", "del"):
            return f"<{kind}>{self.inlines(x[1])}</{kind}>"
        if kind == "html":
            return self.html(x[1])
        if kind == "soft":
            return "\n"
        if kind == "hard":
            return self.void("br") + "\n"
        if kind == "note":
            number = self.document.number[x[1]]
            self.seen[number] = self.seen.get(number, 0) + 1
            anchor = f"ref-{number}" + (f"-{self.seen[number]}" if self.seen[number] > 1 else "")
            return f'<sup><a href="#fn-{number}" id="{anchor}">[{number}]</a></sup>'
        title = f' title="{escape_attribute(x[2])}"' if x[2] else ""
        if kind == "image":
            return self.void(f'img src="{escape_attribute(x[1])}" alt="{escape_attribute(plain(x[3]))}"{title}')
        return f'<a href="{escape_attribute(x[1])}"{title}>{self.inlines(x[3])}</a>'

    def blocks(self, nodes: list[tuple]) -> str:
        return "\n".join(map(self.block, nodes))

    def block(self, b: tuple) -> str:
        kind = b[0]
        if kind == "para":
            return f"<p>{self.inlines(b[1])}</p>"
        if kind == "heading":
            return f"<h{b[1]}>{self.inlines(b[2])}</h{b[1]}>"
        if kind == "hr":
            return self.void("hr")
        if kind == "html":
            return self.html(b[1])
        if kind == "code":
            language = f' class="language-{escape_attribute(b[1].split()[0])}"' if b[1].split() else ""
            return f"<pre><code{language}>{escape_text(b[2])}</code></pre>"
        if kind == "quote":
            if alert := alert_of(b[1]):
                title, role = ALERTS[alert[0]]
                return f'<aside class="markdown-alert markdown-alert-{alert[0]}" data-alert="{alert[0]}" role="{role}"><p class="markdown-alert-title">{title}</p>{self.blocks(alert[1])}</aside>'
            return f"<blockquote>{self.blocks(b[1])}</blockquote>"
        if kind == "table":
            return self.table(b)
        start = f' start="{b[2]}"' if b[1] and b[2] != 1 else ""
        items = "".join(self.item(c, x, b[3]) for c, x in b[4])
        return f"<ol{start}>{items}</ol>" if b[1] else f"<ul>{items}</ul>"

    def item(self, checked: bool | None, blocks: list[tuple], tight: bool) -> str:
        body = "".join(self.inlines(x[1]) if tight and x[0] == "para" else self.block(x) for x in blocks)
        if checked is None:
            return f"<li>{body}</li>"
        flag = ' disabled="disabled"' if self.xhtml else " disabled"
        if checked:
            flag += ' checked="checked"' if self.xhtml else " checked"
        return f'<li class="task-list-item">{self.void(f'input type="checkbox"{flag}')} {body}</li>'

    def table(self, b: tuple) -> str:
        def row(cells, tag):
            return "<tr>" + "".join(f"<{tag}{f' style="text-align: {a}"' if a else ''}>{self.inlines(c)}</{tag}>" for a, c in zip(b[1], cells, strict=True)) + "</tr>"

        body = "".join(row(r, "td") for r in b[2][1:])
        return f"<table><thead>{row(b[2][0], 'th')}</thead>" + (f"<tbody>{body}</tbody>" if body else "") + "</table>"

    def note(self, number: int, body: str) -> str:
        label, body = f"<strong>[{number}]:</strong>", body.strip()
        if body.startswith("<p>") and body.endswith("</p>") and body.count("</p>") == 1:
            body = " " + body[3:-4]
        elif body:
            label = f"<p>{label}</p>"
        return f'<div class="footnote-definition" id="fn-{number}">{label}{body}</div>'

    def render(self) -> str:
        parts = [self.blocks(self.document.blocks)]
        parts += [self.note(number, self.blocks(body)) for number, _, body in self.document.notes]
        return "\n".join(p for p in parts if p)


def to_html(markdown: str | None, *, raw: bool = False, xhtml: bool = False) -> str:
    """The HTML fragment of a Markdown text; null and empty give an empty fragment."""
    return Writer(Document(markdown), raw, xhtml).render()
