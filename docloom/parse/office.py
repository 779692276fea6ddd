"""Readers and writers of zipped XML documents and of e-mail (no Spark imports)."""

from __future__ import annotations

import email
import email.policy
import io
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

from docloom.parse.commonmark import Document
from docloom.parse.markdown_html import escape_attribute, escape_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _value(node, name: str, default=None):
    found = node.find(f"{_W}{name}") if node is not None else None
    return default if found is None else found.get(f"{_W}val", default)


def _on(node, name: str) -> bool:
    found = node.find(f"{_W}{name}") if node is not None else None
    return found is not None and found.get(f"{_W}val", "true") not in ("0", "false", "none")


def _parts(content: bytes, wanted: tuple[str, ...]) -> dict[str, ET.Element]:
    """Only the wanted members are decompressed."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        return {n: ET.fromstring(z.read(f"word/{n}.xml")) for n in wanted if f"word/{n}.xml" in names}


def docx_runs(content: bytes) -> Iterator[dict]:
    """Runs (para, seq, style, outline, num_id, level, format, start, text, bold, italic, struck, note_id) of a word-processor file; an empty paragraph has one empty run."""
    parts = _parts(content, ("document", "styles", "numbering"))
    if "document" not in parts:
        raise ValueError("no word/document.xml")
    styles = {s.get(f"{_W}styleId"): (_value(s, "name"), _value(s.find(f"{_W}pPr"), "outlineLvl")) for s in parts["styles"].iter(f"{_W}style")} if "styles" in parts else {}
    levels: dict[str, dict[int, tuple[str, int]]] = {}
    links: dict[str, str] = {}
    nums: dict[str, str] = {}
    if "numbering" in parts:
        for a in parts["numbering"].iter(f"{_W}abstractNum"):
            key = a.get(f"{_W}abstractNumId")
            levels[key] = {int(x.get(f"{_W}ilvl")): (_value(x, "numFmt", "decimal"), int(_value(x, "start", "1"))) for x in a.findall(f"{_W}lvl")}
            if own := _value(a, "styleLink"):
                links[own] = key
        for a in parts["numbering"].iter(f"{_W}abstractNum"):
            if (to := _value(a, "numStyleLink")) in links:
                levels[a.get(f"{_W}abstractNumId")] = levels[links[to]]
        nums = {n.get(f"{_W}numId"): _value(n, "abstractNumId") for n in parts["numbering"].iter(f"{_W}num")}
    for number, p in enumerate(parts["document"].iter(f"{_W}p")):
        props = p.find(f"{_W}pPr")
        style = _value(props, "pStyle")
        name, outline = styles.get(style, (style, None))
        listed = props.find(f"{_W}numPr") if props is not None else None
        num, level = _value(listed, "numId"), int(_value(listed, "ilvl", "0"))
        kind, start = levels.get(nums.get(num, ""), {}).get(level, ("decimal", 1)) if num and num != "0" else (None, None)
        row = {"para": number, "style": name, "outline": int(outline) if outline is not None else None, "num_id": int(num) if num and num != "0" else None, "level": level if kind else None, "format": kind, "start": start}
        seq = 0
        for r in p.iter(f"{_W}r"):
            rp = r.find(f"{_W}rPr")
            look = {"bold": _on(rp, "b"), "italic": _on(rp, "i"), "struck": _on(rp, "strike"), "note_id": None}
            text = ""
            for x in r:
                if x.tag == f"{_W}t":
                    text += x.text or ""
                elif x.tag == f"{_W}tab":
                    text += "\t"
                elif x.tag in (f"{_W}br", f"{_W}cr"):
                    text += "\n"
                elif x.tag == f"{_W}footnoteReference":
                    yield row | look | {"seq": seq, "text": "", "note_id": int(x.get(f"{_W}id"))}
                    seq += 1
            if text:
                yield row | look | {"seq": seq, "text": text}
                seq += 1
        if not seq:
            yield row | {"seq": 0, "text": "", "bold": False, "italic": False, "struck": False, "note_id": None}


def docx_notes(content: bytes) -> Iterator[dict]:
    """(note_id, text) of the footnotes, without separators."""
    root = _parts(content, ("footnotes",)).get("footnotes")
    for n in root.findall(f"{_W}footnote") if root is not None else []:
        if n.get(f"{_W}type") in ("separator", "continuationSeparator", "continuationNotice"):
            continue
        paras = ["".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in n.iter(f"{_W}p")]
        yield {"note_id": int(n.get(f"{_W}id")), "text": " ".join(x for x in paras if x)}


def media(content: bytes, folder: str = "word/media/") -> Iterator[dict]:
    """(name, data): media members, each file name once."""
    seen = set()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for n in z.namelist():
            name = n.rsplit("/", 1)[-1]
            if n.startswith(folder) and name and name not in seen:
                seen.add(name)
                yield {"name": name, "data": z.read(n)}


def eml_html(content: bytes) -> dict:
    """(subject, html, text) of an e-mail: the first HTML part, the first plain part."""
    message = email.message_from_bytes(content, policy=email.policy.default)
    parts = {}
    for part in message.walk():
        if part.get_content_type() in ("text/html", "text/plain"):
            try:
                body = part.get_content()
            except (LookupError, UnicodeDecodeError):
                body = part.get_payload(decode=True).decode("latin-1")
            parts.setdefault(part.get_content_type(), body)
    html = parts.get("text/html")
    if html is None and "<html" in parts.get("text/plain", "").lower():
        html = parts["text/plain"]
    return {"subject": str(message["subject"]) if message["subject"] else None, "html": html, "text": parts.get("text/plain")}


def image_size(data: bytes) -> dict:
    """(width, height) from a PNG or JPEG header, or nulls."""
    none = {"width": None, "height": None}
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return dict(zip(("width", "height"), struct.unpack(">II", data[16:24]), strict=True))
    if data[:2] != b"\xff\xd8":
        return none
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return {"width": w, "height": h}
        if mark in (0xFF, 0x01) or 0xD0 <= mark <= 0xD9:
            at += 1 if mark == 0xFF else 2
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return none


def zipped(files: list[tuple[str, bytes | str]], stored_first: bool = False) -> bytes:
    """A zip of files in order, without times, so that equal content gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for i, (name, data) in enumerate(files):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if stored_first and not i else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def to_epub(markdown: str | None, title: str = "Untitled", level: int = 1, identifier: str = "urn:docloom", modified: datetime | None = None, language: str = "en") -> bytes:
    """An EPUB of a Markdown text: one XHTML file a chapter, navigation in both forms."""
    from docloom.parse.markdown_runs import chapters

    parts = chapters(markdown, level, title)
    stamp = (modified or datetime(2000, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    page = lambda head, body: f'<?xml version="1.0" encoding="UTF-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{language}"><head><title>{escape_text(head)}</title></head><body>{body}</body></html>'
    files: list[tuple[str, bytes | str]] = [
        ("mimetype", "application/epub+zip"),
        ("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
    ]
    items = "".join(f'<item id="{c["id"]}" href="{c["id"]}.xhtml" media-type="application/xhtml+xml"/>' for c in parts)
    spine = "".join(f'<itemref idref="{c["id"]}"/>' for c in parts)
    files.append(("OEBPS/content.opf", f'<?xml version="1.0" encoding="UTF-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape_text(identifier)}</dc:identifier><dc:title>{escape_text(title)}</dc:title><dc:language>{language}</dc:language><meta property="dcterms:modified">{stamp}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{items}</manifest><spine toc="ncx">{spine}</spine></package>'))
    files.append(("OEBPS/nav.xhtml", page(title, '<nav epub:type="toc"><ol>' + "".join(f'<li><a href="{c["id"]}.xhtml">{escape_text(c["title"])}</a></li>' for c in parts) + "</ol></nav>")))
    points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{escape_text(c["title"])}</text></navLabel><content src="{c["id"]}.xhtml"/></navPoint>' for i, c in enumerate(parts, 1))
    files.append(("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="UTF-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{escape_attribute(identifier)}"/></head><docTitle><text>{escape_text(title)}</text></docTitle><navMap>{points}</navMap></ncx>'))
    files += [(f"OEBPS/{c['id']}.xhtml", page(c["title"], c["xhtml"])) for c in parts]
    return zipped(files, stored_first=True)


class _DocxWriter:
    """Word-processor XML of a parsed Markdown document."""

    def __init__(self, document: Document):
        self.document, self.lists = document, 0

    def run(self, text: str, style: int) -> str:
        look = "".join(x for bit, x in ((1, "<w:b/>"), (2, "<w:i/>"), (4, "<w:strike/>"), (8, '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>')) if style & bit)
        pieces = [f'<w:t xml:space="preserve">{escape_text(p)}</w:t>' for p in text.split("\n")]
        return f"<w:r>{f'<w:rPr>{look}</w:rPr>' if look else ''}{'<w:br/>'.join(pieces)}</w:r>"

    def inlines(self, nodes: list[tuple], style: int = 0) -> str:
        out = []
        for x in nodes:
            if x[0] in ("text", "code", "html"):
                out.append(self.run(x[1], style | (8 if x[0] == "code" else 0)))
            elif x[0] in ("strong", "em", "del"):
                out.append(self.inlines(x[1], style | {"strong": 1, "em": 2, "del": 4}[x[0]]))
            elif x[0] in ("link", "image"):
                out.append(self.inlines(x[3], style))
            elif x[0] == "note":
                out.append(f'<w:r><w:footnoteReference w:id="{self.document.number[x[1]]}"/></w:r>')
            else:
                out.append(self.run("\n" if x[0] == "hard" else " ", style))
        return "".join(out)

    @staticmethod
    def para(body: str, style: str = "", extra: str = "") -> str:
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + extra
        return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{body}</w:p>"

    def blocks(self, nodes: list[tuple], extra: str = "", style: str = "", level: int = 0) -> str:
        out = []
        for b in nodes:
            if b[0] == "para":
                out.append(self.para(self.inlines(b[1]), style, extra))
            elif b[0] == "heading":
                out.append(self.para(self.inlines(b[2]), f"Heading{b[1]}"))
            elif b[0] == "code":
                out.append(self.para(self.run(b[2], 8), "Code"))
            elif b[0] == "quote":
                out.append(self.blocks(b[1], style="Quote"))
            elif b[0] == "hr":
                out.append(self.para("", extra='<w:pBdr><w:bottom w:val="single" w:sz="6" w:space="1" w:color="auto"/></w:pBdr>'))
            elif b[0] == "table":
                rows = "".join("<w:tr>" + "".join(f"<w:tc>{self.para(self.inlines(c))}</w:tc>" for c in r) + "</w:tr>" for r in b[2])
                out.append(f"<w:tbl><w:tblPr/>{rows}</w:tbl>")
            elif b[0] == "list":
                number = 2 if b[1] else 1
                mark = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{number}"/></w:numPr>'
                for _, item in b[4]:
                    out.append(self.blocks(item[:1], extra=mark, style="ListParagraph", level=level + 1))
                    out.append(self.blocks(item[1:], level=level + 1))
        return "".join(out)


def to_docx(markdown: str | None) -> bytes:
    """A word-processor file of a Markdown text, with lists, tables and footnotes."""
    document = Document(markdown)
    w, ns = _DocxWriter(document), 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = w.blocks(document.blocks)
    notes = "".join(f'<w:footnote w:id="{n}">{w.blocks(b) or w.para("")}</w:footnote>' for n, _, b in document.notes)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:pPr><w:outlineLvl w:val="{i - 1}"/></w:pPr></w:style>' for i in range(1, 7)) + "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{s}"/></w:style>' for s in ("Code", "Quote", "ListParagraph"))
    levels = lambda kind: "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{"•" if kind == "bullet" else f"%{i + 1}."}"/></w:lvl>' for i in range(9))
    numbering = f'<w:abstractNum w:abstractNumId="0">{levels("bullet")}</w:abstractNum><w:abstractNum w:abstractNumId="1">{levels("decimal")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num>'
    head, kinds = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>', "application/vnd.openxmlformats-officedocument.wordprocessingml"
    names = ("document", "styles", "numbering", "footnotes")
    overrides = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{kinds}.{"document.main" if n == "document" else n}+xml"/>' for n in names)
    relations = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    link = lambda i, kind, target: f'<Relationship Id="r{i}" Type="{relations}/{kind}" Target="{target}"/>'
    package = "http://schemas.openxmlformats.org/package/2006"
    return zipped(
        [
            ("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{overrides}</Types>'),
            ("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships">{link(1, "officeDocument", "word/document.xml")}</Relationships>'),
            ("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{"".join(link(i, n, f"{n}.xml") for i, n in enumerate(names[1:], 1))}</Relationships>'),
            ("word/document.xml", f"{head}<w:document {ns}><w:body>{body}</w:body></w:document>"),
            ("word/styles.xml", f"{head}<w:styles {ns}>{styles}</w:styles>"),
            ("word/numbering.xml", f"{head}<w:numbering {ns}>{numbering}</w:numbering>"),
            ("word/footnotes.xml", f"{head}<w:footnotes {ns}>{notes}</w:footnotes>"),
        ]
    )


