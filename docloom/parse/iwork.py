"""Readers of the packed object archives of page, sheet and slide files (no Spark imports)."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta

from docloom.parse import iwork_xml

# Object types and field numbers of the format.
STORAGE, TABLE_INFO, TABLE_MODEL, TILE_ROWS = 2001, 6000, 6001, 5
SHEET_DOCUMENT, SHEET, SLIDE_NODE, SLIDE, PLACEHOLDER, SHAPE, NOTE = 1, 2, 4, 5, 7, 2011, 15
NUMBER, DATE, DURATION, BOOL, RICH = 2, 5, 6, 7, 9
EPOCH = datetime(2001, 1, 1)


class Truncated(ValueError):
    """The bytes end too early or point outside."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Truncated("varint")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def snappy(data: bytes) -> bytes:
    """A raw Snappy block decompressed."""
    size, at = varint(data, 0)
    out = bytearray()
    while at < len(data):
        tag = data[at]
        at += 1
        if tag & 3 == 0:
            n = tag >> 2
            if n >= 60:
                width = n - 59
                n = int.from_bytes(data[at : at + width], "little")
                at += width
            n += 1
            if at + n > len(data):
                raise Truncated("literal")
            out += data[at : at + n]
            at += n
            continue
        width = {1: 1, 2: 2, 3: 4}[tag & 3]
        if at + width > len(data):
            raise Truncated("copy")
        offset = int.from_bytes(data[at : at + width], "little")
        at += width
        n = (tag >> 2) + 1
        if width == 1:
            n, offset = ((tag >> 2) & 7) + 4, (tag >> 5) << 8 | offset
        if not 0 < offset <= len(out):
            raise Truncated("offset")
        for _ in range(n // offset):
            out += out[-offset:]
        if rest := n % offset:
            out += out[-offset : len(out) - offset + rest]
    if len(out) != size:
        raise Truncated("size")
    return bytes(out)


def fields(data: bytes) -> list[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a protobuf message without its schema; stops at what is no field."""
    out, at = [], 0
    try:
        while at < len(data):
            key, at = varint(data, at)
            number, wire = key >> 3, key & 7
            if wire == 0:
                value, at = varint(data, at)
            elif wire == 2:
                n, at = varint(data, at)
                value, at = data[at : at + n], at + n
            elif wire in (1, 5):
                n = 8 if wire == 1 else 4
                value, at = data[at : at + n], at + n
            else:
                break
            if not number or at > len(data):
                break
            out.append((number, wire, value))
    except Truncated:
        pass
    return out


class Message:
    """Fields of a message by number."""

    def __init__(self, data: bytes):
        self.all = fields(data)

    def number(self, field: int, default: int | None = None) -> int | None:
        return next((v for n, w, v in self.all if n == field and w == 0), default)

    def many(self, field: int) -> list[bytes]:
        return [v for n, w, v in self.all if n == field and w == 2]

    def bytes(self, field: int) -> bytes | None:
        return next(iter(self.many(field)), None)

    def message(self, field: int) -> Message | None:
        raw = self.bytes(field)
        return None if raw is None else Message(raw)

    def float(self, field: int) -> float | None:
        return next((struct.unpack("<f", v)[0] for n, w, v in self.all if n == field and w == 5), None)

    def ref(self, field: int) -> int | None:
        inner = self.message(field)
        return inner.number(1) if inner else None


def entries(content: bytes, prefix: str = "Index/", suffix: str = ".iwa") -> Iterator[tuple[str, bytes]]:
    """Archive members by name; also from an inner Index.zip."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted(z.namelist()):
            if name.endswith("Index.zip"):
                yield from entries(z.read(name), prefix, suffix)
            elif prefix in name and name.endswith(suffix):
                yield name, z.read(name)


def objects(archive: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(id, type, payload) of the records of one archive."""
    stream, at = bytearray(), 0
    while at < len(archive):
        if at + 4 > len(archive):
            raise Truncated("chunk header")
        n = int.from_bytes(archive[at + 1 : at + 4], "little")
        if at + 4 + n > len(archive):
            raise Truncated("chunk")
        stream += snappy(archive[at + 4 : at + 4 + n])
        at += 4 + n
    data, at = bytes(stream), 0
    while at < len(data):
        try:
            n, at = varint(data, at)
        except Truncated:
            return
        if n > len(data) - at:
            return
        info, at = Message(data[at : at + n]), at + n
        for raw in info.many(2):
            part = Message(raw)
            size = part.number(3, 0)
            if size > len(data) - at:
                return
            yield info.number(1, 0), part.number(1, 0), data[at : at + size]
            at += size


class Store:
    """Objects of all archives: the first of an id wins; by type in order."""

    def __init__(self, content: bytes):
        self.by_id: dict[int, tuple[int, bytes]] = {}
        self.order: list[tuple[int, int, bytes]] = []
        for _, data in entries(content):
            try:
                found = list(objects(data))
            except Truncated:
                continue
            for i, t, payload in found:
                self.by_id.setdefault(i, (t, payload))
                self.order.append((i, t, payload))

    def get(self, i: int | None, kind: int | None = None) -> Message | None:
        t, payload = self.by_id.get(i, (None, b""))
        return Message(payload) if t is not None and kind in (None, t) else None

    def type(self, i: int) -> int | None:
        return self.by_id.get(i, (None, b""))[0]

    def of(self, kind: int) -> list[tuple[int, Message]]:
        return [(i, Message(p)) for i, t, p in self.order if t == kind]

    def references(self, payload: bytes, depth: int = 0) -> list[int]:
        """Known ids in messages that hold nothing but small numbered fields."""
        out = []
        for _, wire, value in fields(payload) if depth < 64 else []:
            if wire == 2 and value:
                inner = fields(value)
                if inner and all(n <= 3 and w == 0 for n, w, _ in inner) and inner[0][0] == 1 and inner[0][2] in self.by_id:
                    out.append(inner[0][2])
                elif inner:
                    out += self.references(value, depth + 1)
        return list(dict.fromkeys(out))


def storage_text(m: Message) -> str:
    return b"".join(m.many(3)).decode("utf-8", "replace")


# ---- tables ----


def decimal128(data: bytes) -> str | None:
    """Exact digits of a binary-integer decimal; null where the coefficient is over 64 bits."""
    low, high = struct.unpack("<QQ", data[:16])
    if high >> 61 & 3 == 3 or high & 0x1FFFFFFFFFFFF:
        return None
    exponent, digits = (high >> 49 & 0x3FFF) - 6176, str(low)
    if exponent >= 0:
        out = digits + "0" * min(exponent, 40)
    else:
        digits = digits.rjust(1 - exponent, "0")
        out = (digits[:exponent] + "." + digits[exponent:]).rstrip("0").rstrip(".")
    return "-" + out if high >> 63 and out != "0" else out


def double_text(v: float) -> str:
    """Whole numbers without a point, else 12 digits; blank for what is no number or subnormal."""
    if v != v or v in (float("inf"), float("-inf")) or 0 < abs(v) < 2.2250738585072014e-308:
        return ""
    return str(int(v)) if v == round(v) and abs(v) < 1e15 else format(v, ".12g")


def frozen(kind: int, data: bytes, decimal: bool) -> str | None:
    """The shown value of a number, date, truth or duration cell."""
    if kind == NUMBER and decimal:
        return decimal128(data) if len(data) >= 16 else None
    if kind not in (NUMBER, DATE, DURATION, BOOL) or len(data) < 8:
        return None
    (v,) = struct.unpack("<d", data[:8])
    if kind == NUMBER:
        return double_text(v)
    if kind == DATE:
        return (EPOCH + timedelta(seconds=v)).strftime("%Y-%m-%d %H:%M")
    return ("true" if v else "false") if kind == BOOL else f"{int(round(v))}s"


def table_cells(store: Store, model_id: int) -> dict | None:
    """{rows, cols, cells: [(row, col, kind, value)], aligned: {col: align}} of a table model."""
    model = store.get(model_id, TABLE_MODEL)
    data = model.message(4) if model else None
    if data is None or not model.number(6, 0) or not model.number(7, 0):
        return None
    n_rows, n_cols = model.number(6), model.number(7)

    def listed(field: int) -> list[Message]:
        listing = store.get(data.ref(field))
        return [Message(x) for x in listing.many(3)] if listing else []

    strings = {e.number(1): e.bytes(3).decode("utf-8", "replace") for e in listed(4) if e.bytes(3) is not None}
    styles = {e.number(1): e.ref(4) for e in listed(5)}
    rich: dict[int, str] = {}
    for e in listed(17):
        target = e.ref(9)
        if store.type(target) != STORAGE and (wrapper := store.get(target)):
            target = wrapper.ref(1)
        if m := store.get(target, STORAGE):
            rich[e.number(1)] = storage_text(m)
    tiles = data.message(3)
    out = {"rows": n_rows, "cols": n_cols, "cells": [], "aligned": {}}
    size = tiles.number(2, 256) if tiles else 256
    for raw in tiles.many(1) if tiles else []:
        tile = Message(raw)
        base = tile.number(1, 0) * size
        body = store.get(tile.ref(2))
        for row_raw in body.many(TILE_ROWS) if body else []:
            _row(Message(row_raw), base, out, strings, styles, rich, store)
    return out


def _row(info: Message, base: int, out: dict, strings: dict, styles: dict, rich: dict, store: Store) -> None:
    modern = info.bytes(6) is not None and info.bytes(7) is not None
    buffer, offsets = (info.bytes(6), info.bytes(7)) if modern else (info.bytes(3), info.bytes(4))
    if info.number(1) is None or buffer is None or offsets is None or base + info.number(1) >= out["rows"]:
        return
    row = base + info.number(1)
    starts = struct.unpack(f"<{len(offsets) // 2}H", offsets[: len(offsets) // 2 * 2])
    used = sorted(s for s in starts if s != 0xFFFF)
    for col, start in enumerate(starts[: out["cols"]]):
        if start == 0xFFFF:
            continue
        end = next((s for s in used if s > start), len(buffer))
        key_at, value_at = start + (12 if modern else 16), start + 12 if modern else end - 12
        if key_at + 4 > len(buffer) or value_at < start:
            continue
        kind, key = buffer[start + 1], int.from_bytes(buffer[key_at : key_at + 4], "little")
        value = rich.get(key) if modern and kind == RICH else None
        value = value if value is not None else frozen(kind, buffer[value_at : value_at + 16], modern)
        value = value if value is not None else strings.get(key)
        out["cells"].append((row, col, {NUMBER: "number", DATE: "date", DURATION: "duration", BOOL: "bool", RICH: "rich"}.get(kind, "text"), value))
        if modern and row >= 1 and start + 20 <= len(buffer) and buffer[start + 8] & 0x40:
            style = store.get(styles.get(int.from_bytes(buffer[start + 16 : start + 20], "little")))
            properties = style.message(12) if style else None
            out["aligned"][col] = {1: "right", 2: "center"}.get(properties.number(1) if properties else None, "left")


def sheets(content: bytes) -> Iterator[dict]:
    """Cells (sheet_seq, sheet, table_seq, row, col, kind, value, align) of a spreadsheet: sheets of the document, else all sheets, else all tables."""
    older = iwork_xml.document(content) if not any(True for _ in entries(content)) else None
    if older is not None:
        for cell in iwork_xml.tables(older):
            yield {"sheet_seq": 0, "sheet": None, "table_seq": cell["table_seq"], "row": cell["row"], "col": cell["col"], "kind": "text", "value": cell["value"], "align": cell["align"]}
        return
    store = Store(content)

    def models(sheet: Message) -> list[int]:
        infos = [store.get(Message(x).number(1), TABLE_INFO) for x in sheet.many(2)]
        return [m for i in infos if i and (m := i.ref(2)) and store.type(m) == TABLE_MODEL]

    found = []
    for _, document in store.of(SHEET_DOCUMENT)[:1]:
        listed = [store.get(Message(x).number(1), SHEET) for x in document.many(1)]
        found = [(s, models(s)) for s in listed if s]
    if not any(m for _, m in found):
        found = [(s, m) for _, s in store.of(SHEET) if (m := models(s))] or found
    if not any(m for _, m in found):
        loose = [m for _, i in store.of(TABLE_INFO) if (m := i.ref(2))]
        found = [(None, loose)] if loose else []
    for seq, (sheet, ids) in enumerate(found):
        name = (sheet.bytes(1) or b"").decode("utf-8", "replace") or None if sheet else None
        for t, model in enumerate(ids):
            grid = table_cells(store, model)
            for row, col, kind, value in grid["cells"] if grid else []:
                yield {"sheet_seq": seq, "sheet": name, "table_seq": t, "row": row, "col": col, "kind": kind, "value": value, "align": grid["aligned"].get(col)}


def slide_texts(content: bytes) -> Iterator[dict]:
    """Texts (idx, seq, kind, text) of a deck's slides; layouts of the theme are left out."""
    store = Store(content)
    layouts: set[int] = set()
    for _, document in store.of(SHEET_DOCUMENT)[:1]:
        show = store.get(document.ref(2))
        theme = store.get(show.ref(2)) if show else None
        layouts = {Message(x).number(1) for x in theme.many(2)} if theme else set()

    def below(i: int) -> str | None:
        for j in [i, *store.references(store.by_id[i][1])]:
            if m := store.get(j, STORAGE):
                text = storage_text(m)
                if text.replace("\ufffc", "").strip():
                    return text
        return None

    idx = 0
    for node, _ in store.of(SLIDE_NODE):
        slide = next((r for r in store.references(store.by_id[node][1]) if store.type(r) == SLIDE), None)
        if node in layouts or slide is None:
            continue
        for seq, r in enumerate(store.references(store.by_id[slide][1])):
            kind = {PLACEHOLDER: "text", SHAPE: "text", NOTE: "note"}.get(store.type(r))
            if kind and (text := below(r)):
                yield {"idx": idx, "seq": seq, "kind": kind, "text": text}
        idx += 1


def bodies(store: Store) -> list[Message]:
    """Texts of a page file's body: storages of kind 0, or if they hold nothing the longest that is no header."""
    storages = [m for _, m in store.of(STORAGE)]
    found = [m for m in storages if m.number(1) == 0]
    if any(map(storage_text, found)):
        return found
    return sorted((m for m in storages if m.number(1) != 1), key=lambda m: -len(storage_text(m)))[:1]


def page_paragraphs(content: bytes) -> Iterator[dict]:
    """Paragraphs (seq, text, font_size, bold, italic, style_id) of a page file's body."""
    store = Store(content)

    def looked_up(style: int | None, read) -> object:
        for _ in range(8):
            m = store.get(style)
            if m is None:
                return None
            properties = m.message(11)
            value = read(properties) if properties else None
            if value is not None:
                return value
            above = m.message(1)
            style = above.ref(3) if above else None
        return None

    seq = 0
    for body in bodies(store):
        runs = sorted(((e.number(1, 0), e.ref(2)) for e in (Message(x) for x in (body.message(5).many(1) if body.message(5) else []))), key=lambda r: r[0])
        at = 0
        for part in storage_text(body).replace("\u2029", "\n").split("\n"):
            style = next((s for start, s in reversed(runs) if start <= at), None)
            yield {"seq": seq, "text": part, "font_size": looked_up(style, lambda p: p.float(3)), "bold": bool(looked_up(style, lambda p: p.number(1))), "italic": bool(looked_up(style, lambda p: p.number(2))), "style_id": style}
            at += len(part.encode("utf-16-le")) // 2 + 1
            seq += 1
