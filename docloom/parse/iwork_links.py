"""Footnotes and images of page files: what the entries of a text's run tables lead to (no Spark imports)."""

from __future__ import annotations

import re
from collections.abc import Container, Iterator

from docloom.parse.iwork import STORAGE, Message, Store, bodies, fields, storage_text

# The kind of a footnote's text, endings of images, how far references and nested messages are followed.
FOOTNOTE = 2
IMAGES = ("png", "jpg", "jpeg", "heic", "heif", "tif", "tiff", "gif", "pdf")
HOPS, NESTED = 3, 8
ANCHOR = "\ufffc"


def _runs(storage: Message) -> list[tuple[int, int]]:
    """(UTF-16 place, object id) of the entries of all run tables, as they stand."""
    tables = (Message(value) for _, wire, value in storage.all if wire == 2)
    entries = (Message(raw) for table in tables for raw in table.many(1))
    return [(place, at) for e in entries if (place := e.number(1)) is not None and (at := e.ref(2)) is not None]


def _pointers(payload: bytes) -> list[int]:
    return [i for _, wire, value in fields(payload) if wire == 2 and (i := Message(value).number(1)) is not None]


def first_met(store: Store, start: int, targets: Container[int]) -> int | None:
    """The first of ``targets`` on the way along references from an object, fields in order, depth first."""
    stack, tried = [(start, 0)], {}
    while stack:
        i, hops = stack.pop()
        if i in targets:
            return i
        if hops < HOPS and i in store.by_id and tried.get(i, HOPS) > hops:
            tried[i] = hops
            stack += [(j, hops + 1) for j in reversed(_pointers(store.by_id[i][1]))]
    return None


def footnotes(content: bytes) -> Iterator[dict]:
    """Rows (number, body_seq, place, note_id, text): marks of the body in their order, numbered one by one."""
    store = Store(content)
    notes = {i: m for i, m in store.of(STORAGE) if m.number(1) == FOOTNOTE}
    number = 0
    for seq, body in enumerate(bodies(store)):
        marks = [(place, note) for place, i in _runs(body) if (note := first_met(store, i, notes)) is not None]
        for place, note in sorted(marks, key=lambda m: m[0]):
            number += 1
            text = re.sub("[\u2028\n\t]", " ", storage_text(notes[note]).replace(ANCHOR, "")).strip()
            yield {"number": number, "body_seq": seq, "place": place, "note_id": note, "text": text}


def registry(store: Store) -> dict[int, str]:
    """File names of images by data id: messages that hold a number and, in their fourth field, a name."""
    named: dict[int, str] = {}

    def look(payload: bytes, depth: int) -> None:
        m = Message(payload)
        name = (m.bytes(4) or b"").decode("utf-8", "replace")
        if m.number(1) is not None and "/" not in name and name.rpartition(".")[1:] > (".", "") and name.rpartition(".")[2].lower() in IMAGES:
            named[m.number(1)] = name
        if depth + 1 < NESTED:
            for _, wire, value in m.all:
                if wire == 2 and len(value) >= 2:
                    look(value, depth + 1)

    for _, _, payload in store.order:
        look(payload, 0)
    return named


def logical_name(file: str) -> str:
    """A file's name without the number that the writer puts behind it."""
    return re.sub(r"-[0-9]+(\.[^.]*)$", r"\1", file)


def is_content(file: str) -> bool:
    """Neither a preview nor a decoration of a theme."""
    name = logical_name(file).lower()
    return "-small" not in file.lower() and not name.startswith("presetimagefill") and "bullet" not in name


def reference_names(files: dict[int, str]) -> dict[int, str]:
    """Unique names by data id, in the order of the ids: a name that is taken gets the first free number."""
    names: dict[int, str] = {}
    taken: set[str] = set()
    next_number: dict[str, int] = {}
    for i in sorted(files):
        wanted = name = logical_name(files[i])
        stem, dot, ending = wanted.rpartition(".")
        while name in taken:
            next_number[wanted] = next_number.get(wanted, 0) + 1
            name = f"{stem}-{next_number[wanted]}{dot}{ending}"
        taken.add(name)
        names[i] = name
    return names


def _images(store: Store) -> tuple[dict[int, str], dict[int, str]]:
    files = {i: f for i, f in registry(store).items() if is_content(f)}
    return files, reference_names(files)


def images(content: bytes) -> list[dict]:
    """Rows (data_id, file, name) of the placed images."""
    files, names = _images(Store(content))
    return [{"data_id": i, "file": files[i], "name": names[i]} for i in sorted(files)]


def shown(store: Store, attachment: int, names: Container[int]) -> int | None:
    """The image that an attachment shows: one that it points to, else that of the drawing it wraps, a few wrappers deep."""
    for _ in range(HOPS + 1):
        if attachment not in store.by_id:
            return None
        payload = store.by_id[attachment][1]
        for i in _pointers(payload):
            if i in names:
                return i
        attachment = Message(payload).ref(1)
    return None


def anchored_images(content: bytes) -> Iterator[dict]:
    """Rows (body_seq, place, data_id, name): images at the anchors of the body's text, the first of a place."""
    store = Store(content)
    _, names = _images(store)
    for seq, body in enumerate(bodies(store)):
        units = storage_text(body).encode("utf-16-le", "surrogatepass")
        met: dict[int, int] = {}
        for place, i in _runs(body):
            if place not in met and units[2 * place : 2 * place + 2] == b"\xfc\xff" and (image := shown(store, i, names)) is not None:
                met[place] = image
        for place, image in sorted(met.items()):
            yield {"body_seq": seq, "place": place, "data_id": image, "name": names[image]}
