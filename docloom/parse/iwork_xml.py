"""Readers of the single XML document of older page and sheet files (no Spark imports)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

OPEN, CLOSE, TEXT = "open", "close", "text"
# Elements that stand for a line break, and attributes that hold the value of a cell of each kind.
BREAKS = frozenset(("br", "lnbr", "crbr", "pgbr", "line-break"))
INNER = {"ct": "s", "fo": "fs"}
PIECE = 1 << 16


def document(content: bytes) -> bytes | None:
    """The XML of a zipped or bare older file; None without one, an error for the gzipped form."""
    if not content.startswith(b"PK"):
        return content if content.lstrip()[:1] == b"<" else None
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {n.rpartition("/")[2]: n for n in reversed(z.namelist())}
        if "index.xml" in names:
            return z.read(names["index.xml"])
        if "index.xml.gz" in names:
            raise ValueError("gzipped index of an older file")
    return None


def events(xml: bytes) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes), names without their prefix; read piece by piece."""
    found: list[tuple[str, str, dict[str, str]]] = []
    local = lambda name: name.rpartition(":")[2]
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = lambda n, a: found.append((OPEN, local(n), {local(k): v for k, v in a.items()}))
    parser.EndElementHandler = lambda n: found.append((CLOSE, local(n), {}))
    parser.CharacterDataHandler = lambda t: found.append((TEXT, t, {}))
    for at in range(0, len(xml), PIECE):
        parser.Parse(xml[at : at + PIECE], False)
        yield from found
        found.clear()
    parser.Parse(b"", True)
    yield from found


def paragraphs(content: bytes) -> list[dict]:
    """Rows (seq, text, style) of the body: placeholder prompts left out, the style's name from the nearest ancestor that has one."""
    xml = document(content)
    named: dict[str, tuple[str | None, str | None]] = {}
    storages: list[str] = []
    rows: list[tuple[list[str], str | None]] = []
    inside, prompts = False, 0
    for kind, what, given in events(xml) if xml is not None else ():
        add = None
        if kind == TEXT:
            add = what
        elif what == "text-storage":
            if kind == OPEN:
                storages.append(given.get("kind", ""))
            else:
                storages.pop()
        elif what == "paragraphstyle" and kind == OPEN:
            for label in {given.get("ID"), given.get("ident")} - {None}:
                named[label] = given.get("name"), given.get("parent-ident")
        elif what == "p":
            if kind == CLOSE:
                inside = False
            elif "body" in storages:
                rows.append(([], given.get("style")))
                inside = True
        elif what == "ghost-text":
            prompts = max(prompts - 1, 0) if kind == CLOSE else prompts + inside
        elif kind == OPEN:
            add = "\n" if what in BREAKS else "\t" if what == "tab" else None
        if add and inside and not prompts:
            rows[-1][0].append(add)

    def style_name(label: str | None) -> str | None:
        name = None
        for _ in range(16):
            if name is not None or label not in named:
                break
            name, label = named[label]
        return name

    return [{"seq": i, "text": "".join(pieces), "style": style_name(label)} for i, (pieces, label) in enumerate(rows)]


def _is_number(value: str) -> bool:
    try:
        return value.strip() == value and "_" not in value and float(value) is not None
    except ValueError:
        return False


def tables(content: bytes) -> Iterator[dict]:
    """Cells (table_seq, n_rows, n_cols, row, col, value, align) of every grid, row by row; cells that the file leaves out at the end have no row.

    Formulas show their source.  Columns whose filled cells below the first
    row are all numbers are aligned right.
    """
    xml = document(content)
    shape, values, path, cell, seq = (0, 0), [], [], None, 0
    for kind, what, given in events(xml) if xml is not None else ():
        if kind == OPEN:
            if what == "grid":
                shape, values = tuple(int(n) if (n := given.get(k, "")).isdecimal() else 0 for k in ("numrows", "numcols")), []
            elif cell is not None and what in INNER:
                cell = given.get(INNER[what], cell)
            elif cell is None and path[-1:] == ["datasource"]:
                cell = given.get("v", given.get("number", ""))
            path.append(what)
        elif kind == CLOSE:
            path.pop()
            if cell is not None and path[-1:] == ["datasource"]:
                values.append(cell)
                cell = None
            if what == "datasource" and min(shape) > 0:
                yield from _grid(seq, *shape, values)
                seq += 1


def _grid(seq: int, n_rows: int, n_cols: int, values: list[str]) -> Iterator[dict]:
    held = values[: n_rows * n_cols]
    filled: dict[int, bool] = {}
    for i in range(n_cols, len(held)):
        if held[i]:
            filled[i % n_cols] = filled.get(i % n_cols, True) and _is_number(held[i])
    for i, value in enumerate(held):
        row, col = divmod(i, n_cols)
        yield {"table_seq": seq, "n_rows": n_rows, "n_cols": n_cols, "row": row, "col": col, "value": value, "align": "right" if filled.get(col) else "left"}
