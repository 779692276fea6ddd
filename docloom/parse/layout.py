"""Order-dependent layout steps of one page (no Spark imports); rectangles are (x, y, w, h), y downwards."""

from __future__ import annotations

from functools import cmp_to_key


def _overlaps(a: dict, b: dict) -> bool:
    """One's vertical middle lies in the other's extent."""
    mid = lambda r: r["y"] + r["h"] / 2
    inside = lambda m, r: r["y"] <= m <= r["y"] + r["h"]
    return inside(mid(a), b) or inside(mid(b), a)


def split_tall(fragments: list[dict]) -> list[dict]:
    """Fragments at least twice as high as wide and 1.5 times the typical height, cut by their text's lines or words."""
    if not fragments:
        return []
    typical = sorted(f["h"] for f in fragments)[len(fragments) // 2]
    out = []
    for f in fragments:
        parts = f["text"].split("\n") if "\n" in f["text"] else f["text"].split()
        if f["h"] >= 2 * f["w"] and f["h"] >= 1.5 * typical and len(parts) > 1:
            step = f["h"] / len(parts)
            out += [f | {"y": f["y"] + i * step, "h": step, "text": p} for i, p in enumerate(parts)]
        else:
            out.append(f)
    return out


def lines(fragments: list[dict]) -> list[dict]:
    """Lines top to bottom: seeds from left to right gather what stands at their height; texts join by tabs."""
    rest, out = sorted(split_tall(fragments), key=lambda f: (f["x"], f["y"])), []
    while rest:
        seed, line = rest[0], []
        left = []
        for f in rest:
            (line if f is seed or _overlaps(seed, f) else left).append(f)
        rest = left
        x, y = min(f["x"] for f in line), min(f["y"] for f in line)
        out.append({"x": x, "y": y, "w": max(f["x"] + f["w"] for f in line) - x, "h": max(f["y"] + f["h"] for f in line) - y, "text": "\t".join(f["text"] for f in sorted(line, key=lambda f: f["x"]))})
    return sorted(out, key=lambda line: (line["y"], line["x"]))


def joined(page_lines: list[dict]) -> str:
    """Lines as text; a wide gap gives more newlines, a step back upwards a rule."""
    if not page_lines:
        return ""
    mean = sum(x["h"] for x in page_lines) / len(page_lines) or 1.0
    out = page_lines[0]["text"]
    for a, b in zip(page_lines, page_lines[1:], strict=False):
        step = b["y"] - a["y"]
        out += ("\n---\n" if step <= 0 else "\n" * max(1, round(step / mean))) + b["text"]
    return out


def reading_order(blocks: list[dict], tolerance: float = 0.01) -> list[dict]:
    """Top to bottom, and left to right where tops differ by no more than the tolerance."""

    def compare(a: dict, b: dict) -> float:
        return a["y"] - b["y"] if abs(a["y"] - b["y"]) > tolerance else a["x"] - b["x"]

    return sorted(blocks, key=cmp_to_key(lambda a, b: (compare(a, b) > 0) - (compare(a, b) < 0)))


def paragraphs(page_lines: list[dict], scale: float = 1.0) -> list[dict]:
    """Lines merged to paragraphs where gap and left edge allow; headings stay alone; texts are joined by newlines."""
    from docloom.parse import blocks

    grown = [blocks.paragraph([x | {k: x[k] * scale for k in "xywh"}]) for x in page_lines]
    done = blocks.merged(grown, (scale, scale) if scale != 1.0 else blocks.PAGE)
    return [{k: b[k] / scale for k in "xywh"} | {"text": b["text"]} for b in done]
