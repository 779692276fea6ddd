"""Blocks of one page: lines taken up by recognised blocks, split, merged and written as Markdown.

A box is a dict with x, y, w, h (y downwards, page units); a line adds text.
A block adds ``kind`` (paragraph, list, table, image), its ``lines``, its
``items`` (boxes with text and marker), its ``rows`` (lists of boxes with
text) and ``source``.  Fixed values: the distances below, in page units and
shares of the line height.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cmp_to_key

PAGE = (1000.0, 1000.0)
TAKE_SHARE, TAKE_LEAST = 0.15, 0.01
SPLIT_SHARE, SPLIT_LEAST = 0.8, 16
ATTACH_SHARE = 0.5
#: A line that ends in a colon, begins upper case and is at most so long is a heading.
HEADING_CHARS = 30
_HEADING = re.compile(r"^[A-ZÄÖÜ][^:\n]{0,30}:")


def box(parts: Iterable[dict]) -> dict:
    """The box around boxes."""
    parts = list(parts)
    x, y = min(p["x"] for p in parts), min(p["y"] for p in parts)
    return {"x": x, "y": y, "w": max(p["x"] + p["w"] for p in parts) - x, "h": max(p["y"] + p["h"] for p in parts) - y}


def bottom(b: dict) -> float:
    return b["y"] + b["h"]


def paragraph(lines: list[dict], around: dict | None = None) -> dict:
    return {"kind": "paragraph", **(around or box(lines)), "lines": lines, "text": "\n".join(x["text"] for x in lines)}


def _in_order(rows: list[dict], tolerance: float) -> list[dict]:
    def compare(a: dict, b: dict) -> int:
        d = a["y"] - b["y"] if abs(a["y"] - b["y"]) > tolerance else a["x"] - b["x"]
        return (d > 0) - (d < 0)

    return sorted(rows, key=cmp_to_key(compare))


class Lines:
    """The lines of a page; each is taken once."""

    def __init__(self, lines: list[dict], page: tuple[float, float]):
        self.free = [x | {"text": x["text"].strip()} for x in lines if x["text"] and x["text"].strip() and x["w"] > 0 and x["h"] > 0]
        self.width, self.height = page

    def take(self, area: dict) -> list[dict]:
        """The free lines whose middle is in the area's height and that touch its width."""
        slack = max(area["h"] / self.height * TAKE_SHARE, TAKE_LEAST)
        up, side = slack * self.height, slack * self.width
        hit = [x["y"] + x["h"] / 2 >= area["y"] - up and x["y"] + x["h"] / 2 <= bottom(area) + up and x["x"] + x["w"] >= area["x"] - side and x["x"] <= area["x"] + area["w"] + side for x in self.free]
        got = [x for x, h in zip(self.free, hit, strict=True) if h]
        self.free = [x for x, h in zip(self.free, hit, strict=True) if not h]
        return _in_order(got, 1)


def _filled(block: dict, lines: Lines) -> dict | None:
    """The block with the lines inside it; a paragraph without any is nothing."""
    if block["kind"] == "paragraph":
        got = lines.take(block)
        return paragraph(got) if got else None
    if block["kind"] == "list":
        items = []
        for item in block["items"] or []:
            got = lines.take(item)
            items.append(item | {"text": "\n".join(x["text"] for x in got) if got else item.get("text") or ""})
        return block | {"items": items}
    if block["kind"] == "table":
        rows = []
        for row in block["rows"] or []:
            cells = [(cell, lines.take(cell)) for cell in row]
            rows.append([cell | {"text": cell.get("text") or "\n".join(x["text"] for x in got)} for cell, got in cells])
        return block | {"rows": rows}
    return block


def attached(blocks: list[dict], lines: list[dict]) -> list[dict]:
    """Blocks with each leftover line in the nearest paragraph above it, or in one of its own."""
    own = []
    for x in lines:
        above = [b for b in blocks if b["kind"] == "paragraph" and bottom(b) <= bottom(x)]
        gap = lambda b, x=x: max(0, x["y"] - bottom(b))
        nearest = min(above, key=gap, default=None)
        if nearest is not None and gap(nearest) <= ATTACH_SHARE * x["h"]:
            blocks[blocks.index(nearest)] = paragraph([*nearest["lines"], x], box((nearest, x)))
        else:
            own.append(paragraph([x]))
    return blocks + own


def segments(block: dict, cut: Callable[[dict, dict, int], bool]) -> list[dict]:
    """A paragraph split before each line for which ``cut(line above, line, lines so far)`` holds."""
    parts: list[list[dict]] = []
    for x in block["lines"]:
        if not parts or cut(parts[-1][-1], x, len(parts[-1])):
            parts.append([])
        parts[-1].append(x)
    return [block] if len(parts) < 2 else [paragraph(p) for p in parts]


def wide_gap(above: dict, line: dict, _: int = 0) -> bool:
    return line["y"] - bottom(above) > max(SPLIT_SHARE * max(above["h"], line["h"]), SPLIT_LEAST)


def narrow_lead(above: dict, line: dict, so_far: int) -> bool:
    """A first line that is much narrower than the next one and stands clear of it."""
    gap = line["y"] - bottom(above)
    return so_far == 1 and gap > 0 and gap > 0.9 * max(above["h"], line["h"]) and above["w"] / max(line["w"], 1) < 0.75


def is_heading(text: str) -> bool:
    first = text.strip().split("\n")[0].strip()
    return first.endswith(":") and 1 <= len(first) - 1 <= HEADING_CHARS and first[0].isupper()


def _folded(blocks: list[dict], joins: Callable[[dict, dict], bool]) -> list[dict]:
    """Neighbouring paragraphs for which ``joins`` holds, as one."""
    out: list[dict] = []
    for b in blocks:
        if out and b["kind"] == out[-1]["kind"] == "paragraph" and joins(out[-1], b):
            out[-1] = paragraph(out[-1]["lines"] + b["lines"], box((out[-1], b)))
        else:
            out.append(b)
    return out


def merged(blocks: list[dict], page: tuple[float, float] = PAGE) -> list[dict]:
    """Paragraphs joined over small gaps at one left edge; headings stay alone."""

    def joins(a: dict, b: dict) -> bool:
        if is_heading(a["text"]) or is_heading(b["text"]):
            return False
        low = min(a["lines"][-1]["h"], b["lines"][0]["h"])
        gap = b["lines"][0]["y"] - bottom(a["lines"][-1])
        return -max(0.6 * low, 2) <= gap <= max(min(0.9 * low, low + 6), 3) and abs(a["x"] - b["x"]) <= max(0.015 * page[0], 4)

    return _folded(blocks, joins)


def composed(lines: list[dict], blocks: list[dict], page: tuple[float, float] = PAGE) -> list[dict]:
    """Blocks filled with a page's lines, what is left attached, in reading order, split and merged."""
    held = Lines(lines, page)
    filled = [b for b in (_filled(block, held) for block in blocks) if b is not None]
    every = _in_order(attached(filled, held.free), 0.01 * page[1])
    parts = [p for b in every for p in (segments(b, wide_gap) if b["kind"] == "paragraph" else [b])]
    return merged(parts, page)


def comparable(text: str) -> str:
    t = re.sub(r"^[0-9]+[.)\s]+", "", text.strip())
    t = "".join(" " if not (c.isalnum() or c.isspace()) and c not in "®™" and not _symbol(c) else c for c in t if c not in "®™")
    return re.sub(r"\s+", " ", t).strip().lower()


def _symbol(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] != "P"


def block_text(b: dict) -> str:
    if b["kind"] == "list":
        return "\n".join(i["text"] or "" for i in b["items"] or [])
    if b["kind"] == "table":
        return "\n".join(c["text"] or "" for r in b["rows"] or [] for c in r)
    return b.get("text") or ""


def without_repeats(blocks: list[dict]) -> list[dict]:
    """The first block of each comparable text; longer texts inside an earlier, longer one go too."""
    out, seen = [], []
    for b in blocks:
        key = comparable(block_text(b)) if b["kind"] != "image" else ""
        if key and (key in seen or len(key) > 40 and any(len(o) > len(key) + 10 and key in o for o in seen)):
            continue
        seen += [key] if key else []
        out.append(b)
    return out


def post_processed(blocks: list[dict], page: tuple[float, float] = PAGE) -> list[dict]:
    """Order, merge, split, drop repeats, order."""

    def joins(a: dict, b: dict) -> bool:
        if any(_HEADING.search(t["text"].strip().split("\n")[0]) for t in (a, b)):
            return False
        h, gap = b["lines"][0]["h"], b["lines"][0]["y"] - bottom(a["lines"][-1])
        return -6 <= gap <= max(min(1.5 * h, h + 20), 6) and abs(a["x"] - b["x"]) <= max(0.04 * page[0], 14)

    ordered = _folded(_in_order(blocks, 0.01 * page[1]), joins)
    parts = [p for b in ordered for p in (segments(b, narrow_lead) if b["kind"] == "paragraph" else [b])]
    return _in_order(without_repeats(parts), 0.01 * page[1])


def _cell(text: str | None) -> str:
    return (text or "").strip().replace("|", "\\|").replace("\n", " ")


def markdown(blocks: list[dict]) -> str:
    """Blocks as Markdown, in reading order, paragraphs that go on joined."""
    if not blocks:
        return ""
    page = box(blocks)

    def joins(a: dict, b: dict) -> bool:
        tall = max((a["h"] + b["h"]) / 2, 1)
        return -4 <= b["y"] - bottom(a) <= max(0.8 * tall, 6) and abs(a["x"] - b["x"]) <= max(0.02 * page["w"], 8)

    out = []
    for b in _folded(_in_order(blocks, 0.01 * page["h"]), joins):
        if b["kind"] == "paragraph":
            out.append(" ".join(x["text"].strip() for x in b["lines"] if x["text"].strip()))
        elif b["kind"] == "list":
            mark = (lambda i: f"{i}. ") if b.get("ordered") else (lambda i: "- ")
            out.append("\n".join(mark(i) + (item["text"] or "").strip().replace("\n", " ") for i, item in enumerate(b["items"] or [], 1)))
        elif b["kind"] == "table":
            rows = [[_cell(c["text"]) for c in r] for r in b["rows"] or []]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows] if width else []
            out.append("\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if lines else "")
        else:
            out.append(f"![Image]({b.get('source') or ''})")
    return "\n\n".join(x for x in out if x)
