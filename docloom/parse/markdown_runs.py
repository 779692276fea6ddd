"""Parsed Markdown to runs (styled pieces of text in their block) and chapters."""

from __future__ import annotations

from docloom.parse.commonmark import Document, plain
from docloom.parse.markdown_html import Writer, alert_of

STYLES = {"strong": 1, "em": 2, "del": 4, "code": 8}


def runs(markdown: str | None) -> list[dict]:
    """Rows (seq, block, level, path, text, style, link, image, footnote, alert, checked).

    ``path`` names the blocks around the run, outermost first, each with its
    ordinal; ``style`` adds 1 strong, 2 emphasis, 4 struck, 8 code.
    """
    out: list[dict] = []
    document = Document(markdown)

    def add(text, block, path, style=0, link=None, level=None, **more):
        row = {"seq": len(out), "block": block, "level": level, "path": "/".join(path), "text": text, "style": style, "link": link, "image": None, "footnote": None, "alert": None, "checked": None}
        out.append(row | more)

    def inlines(nodes, block, path, style, link, level, more):
        for x in nodes:
            if x[0] in ("text", "html"):
                add(x[1], block, path, style, link, level, **more)
            elif x[0] == "code":
                add(x[1], block, path, style | 8, link, level, **more)
            elif x[0] in STYLES:
                inlines(x[1], block, path, style | STYLES[x[0]], link, level, more)
            elif x[0] == "link":
                inlines(x[3], block, path, style, x[1], level, more)
            elif x[0] == "image":
                add(plain(x[3]), block, path, style, link, level, **more | {"image": x[1]})
            elif x[0] == "note":
                add(str(document.number[x[1]]), block, path, style, link, level, **more | {"footnote": document.number[x[1]]})
            else:
                add("\n" if x[0] == "hard" else " ", block, path, style, link, level, **more)

    def blocks(nodes, path, more):
        for n, b in enumerate(nodes, 1):
            here = [*path, f"{b[0]}:{n}"]
            if b[0] == "para":
                inlines(b[1], "para", here, 0, None, None, more)
            elif b[0] == "heading":
                inlines(b[2], "heading", here, 0, None, b[1], more)
            elif b[0] == "code":
                add(b[2], "code", here, **more)
            elif b[0] == "hr":
                add("", "hr", here, **more)
            elif b[0] == "quote":
                alert = alert_of(b[1])
                blocks(alert[1] if alert else b[1], here, more | {"alert": alert[0]} if alert else more)
            elif b[0] == "list":
                for i, (checked, inner) in enumerate(b[4]):
                    label = f"item:{b[2] + i}" if b[1] else f"bullet:{i + 1}"
                    blocks(inner, [*here, label], more | {"checked": checked})
            elif b[0] == "table":
                for r, row in enumerate(b[2]):
                    for c, cell in enumerate(row):
                        inlines(cell, "cell", [*here, f"row:{r}", f"col:{c}"], 0, None, None, more)

    blocks(document.blocks, [], {})
    for number, _, body in document.notes:
        blocks(body, [f"note:{number}"], {})
    return out


def chapters(markdown: str | None, level: int = 1, title: str = "Untitled") -> list[dict]:
    """Rows (seq, id, title, front, xhtml): a chapter begins at each heading of just this level.

    Headings that directly follow each other at a chapter's start join to its
    title.  Without such a heading there is one chapter with ``title``.
    """
    document = Document(markdown)
    groups: list[list[tuple]] = [[]]
    for b in document.blocks:
        if b[0] == "heading" and b[1] == level and any(x[0] != "heading" or x[1] != level for x in groups[-1]):
            groups.append([])
        elif b[0] == "heading" and b[1] == level and groups[-1] and all(x[0] == "heading" and x[1] == level for x in groups[-1]):
            groups.append([])
        groups[-1].append(b)
    writer, out = Writer(document, xhtml=True), []
    for group in groups:
        if not group and len(groups) > 1:
            continue
        lead = []
        for b in group:
            if b[0] != "heading":
                break
            lead.append(plain(b[2]))
        front = not (group and group[0][0] == "heading" and group[0][1] == level)
        name = ": ".join(lead) if lead and not front else title
        out.append({"seq": len(out), "id": f"chapter-{len(out) + 1}", "title": name, "front": front and len(groups) > 1, "xhtml": writer.blocks(group)})
    notes = [writer.note(n, writer.blocks(body)) for n, _, body in document.notes]
    if notes:
        out[-1]["xhtml"] += "\n" + "\n".join(notes)
    return out


def title(markdown: str | None) -> str | None:
    """The first ATX heading outside fences."""
    fence = None
    for line in (markdown or "").split("\n"):
        head = line.lstrip()
        if head.startswith(("```", "~~~")):
            fence = None if fence == head[:3] else fence or head[:3]
        elif fence is None and head.startswith("#"):
            depth = len(head) - len(head.lstrip("#"))
            body = head[depth:]
            if depth <= 6 and body[:1] in ("", " ", "\t"):
                return body.strip().rstrip("#").strip()
    return None
