import struct

import pytest

from docloom.functions.sanitize import sanitize
from docloom.parse import css, html_tree, iwork, iwork_links, iwork_xml, layout, office


def vint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def num(field, n):
    return vint(field << 3) + vint(n)


def sub(field, data):
    return vint(field << 3 | 2) + vint(len(data)) + data


def archive(*objects):
    """One archive file of (id, type, payload)."""
    stream = b""
    for i, t, payload in objects:
        info = num(1, i) + sub(2, num(1, t) + num(3, len(payload)))
        stream += vint(len(info)) + info + payload
    block = vint(len(stream)) + b"".join(bytes([60 << 2, len(stream[k : k + 200]) - 1]) + stream[k : k + 200] for k in range(0, len(stream), 200))
    return b"\0" + len(block).to_bytes(3, "little") + block


def bundle(*files):
    return office.zipped([(f"Index/{n}.iwa", data) for n, data in files])


def test_snappy():
    assert iwork.snappy(b"\x0b\x28hello world") == b"hello world"
    assert iwork.snappy(bytes([9, 0]) + b"a" + bytes([(4 << 2) | 1, 1])) == b"a" * 9
    for bad in (b"\x05\x28hel", bytes([4, 0]) + b"a" + bytes([2 << 2 | 2, 9, 0])):
        with pytest.raises(iwork.Truncated):
            iwork.snappy(bad)


def test_numbers():
    assert iwork.decimal128(struct.pack("<QQ", 1249, (6176 - 2) << 49)) == "12.49"
    assert iwork.decimal128(struct.pack("<QQ", 500, (6176 - 2) << 49 | 1 << 63)) == "-5"
    assert iwork.decimal128(struct.pack("<QQ", 7, (6176 + 2) << 49)) == "700"
    assert [iwork.double_text(v) for v in (3.0, 12040.079999999998, float("nan"), 5e-324)] == ["3", "12040.08", "", ""]
    assert iwork.frozen(iwork.DATE, struct.pack("<d", 86400.0), True) == "2001-01-02 00:00"
    assert iwork.frozen(iwork.DURATION, struct.pack("<d", 89.6), True) == "90s"


def test_page_paragraphs():
    runs = sub(1, num(1, 0) + sub(2, num(1, 100))) + sub(1, num(1, 12) + sub(2, num(1, 101)))
    body = num(1, 0) + sub(3, "Tide Tables\nHigh water at nine.\nLow water at three.".encode()) + sub(5, runs)
    size = lambda v: vint(3 << 3 | 5) + struct.pack("<f", v)
    styles = [(100, 2022, sub(11, num(1, 1) + size(24))), (101, 2022, sub(1, sub(3, num(1, 102)))), (102, 2022, sub(11, size(11)))]
    got = list(iwork.page_paragraphs(bundle(("Document", archive((1, 2001, body))), ("Styles", archive(*styles)))))
    assert [(r["text"], r["font_size"], r["bold"]) for r in got] == [("Tide Tables", 24.0, True), ("High water at nine.", 11.0, False), ("Low water at three.", 11.0, False)]


def test_sheet_over_two_tiles():
    cell = lambda key: bytes([5, 3]) + bytes(10) + struct.pack("<I", key)
    number = bytes([5, 2]) + bytes(10) + struct.pack("<QQ", 1249, (6176 - 2) << 49)
    row = lambda i, *cells: sub(5, num(1, i) + sub(6, b"".join(c or b"" for c in cells)) + sub(7, offsets(cells)))

    def offsets(cells):
        out, at = b"", 0
        for c in cells:
            out += struct.pack("<H", 0xFFFF if c is None else at)
            at += len(c or b"")
        return out

    strings = sub(3, num(1, 1) + sub(3, b"Item")) + sub(3, num(1, 2) + sub(3, b"total"))
    tiles = num(2, 256) + sub(1, num(1, 0) + sub(2, num(1, 20))) + sub(1, num(1, 1) + sub(2, num(1, 21)))
    model = num(6, 300) + num(7, 3) + sub(4, sub(3, tiles) + sub(4, num(1, 30)))
    objects = [(1, 1, sub(1, num(1, 2))), (2, 2, sub(1, b"Sheet 1") + sub(2, num(1, 10))), (10, 6000, sub(2, num(1, 11))), (11, 6001, model), (30, 6005, strings), (20, 6002, row(0, cell(1), None, number)), (21, 6002, row(4, cell(2), None, number))]
    got = list(iwork.sheets(bundle(("Tables", archive(*objects)))))
    assert [(r["sheet"], r["row"], r["col"], r["kind"], r["value"]) for r in got] == [("Sheet 1", 0, 0, "text", "Item"), ("Sheet 1", 0, 2, "number", "12.49"), ("Sheet 1", 260, 0, "text", "total"), ("Sheet 1", 260, 2, "number", "12.49")]


def test_slides_without_layouts():
    text = lambda s: sub(3, s.encode())
    ref = lambda f, i: sub(f, num(1, i))
    objects = [(1, 1, ref(2, 2)), (2, 2, ref(2, 3)), (3, 10, ref(2, 40)), (40, 4, ref(1, 50)), (41, 4, ref(1, 51)), (50, 5, b""), (51, 5, ref(1, 60) + ref(2, 61) + ref(3, 62))]
    objects += [(60, 7, ref(1, 70)), (61, 2011, ref(1, 71)), (62, 15, ref(1, 72)), (70, 2001, text("Title")), (71, 2001, text("Body")), (72, 2001, text("Note"))]
    got = list(iwork.slide_texts(bundle(("Deck", archive(*objects)))))
    assert [(r["idx"], r["kind"], r["text"]) for r in got] == [(0, "text", "Title"), (0, "text", "Body"), (0, "note", "Note")]


def test_docx_round_trip():
    data = office.to_docx("# T\n\nHello **b** *i*[^1].\n\n- a\n- b\n\n1. x\n\n[^1]: note text")
    runs = list(office.docx_runs(data))
    assert [(r["style"], r["text"]) for r in runs if r["text"].strip()] == [("heading 1", "T"), (None, "Hello "), (None, "b"), (None, "i"), (None, "."), ("ListParagraph", "a"), ("ListParagraph", "b"), ("ListParagraph", "x")]
    assert list(office.docx_notes(data)) == [{"note_id": 1, "text": "note text"}]


def test_epub_is_stored_first():
    import io
    import zipfile

    z = zipfile.ZipFile(io.BytesIO(office.to_epub("# A\n\nx & y\n\n# B\n\nz", title="Book")))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert b"x &amp; y" in z.read("OEBPS/chapter-1.xhtml") and len([n for n in z.namelist() if "chapter" in n]) == 2


def test_mail():
    raw = b'Subject: Hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary="b"\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b\r\nContent-Type: text/html; charset=utf-8\r\nContent-Transfer-Encoding: quoted-printable\r\n\r\n<p>caf=C3=A9=\r\n!</p>\r\n--b--\r\n'
    got = office.eml_html(raw)
    assert got["subject"] == "Hi" and got["html"].strip() == "<p>café!</p>" and got["text"].strip() == "plain"


def test_image_sizes():
    assert office.image_size(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480)) == {"width": 640, "height": 480}
    assert office.image_size(b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 20, 30) + bytes(9)) == {"width": 30, "height": 20}
    assert office.image_size(b"nothing") == {"width": None, "height": None}


def test_sanitizer():
    assert sanitize("safe‮text")["text"] == "safetext"
    marks = sanitize("A" + "́" * 20)
    assert len(marks["text"]) == 15 and marks["excessive_marks"] == 2 and marks["abuse"]
    family = "👨‍👩‍👧‍👦"
    assert sanitize(family)["text"] == family and not sanitize(family)["abuse"]
    assert sanitize("Alert: ⚠️️️")["text"] == "Alert: ⚠️"
    assert sanitize(None)["text"] is None


def test_layout():
    box = lambda x, y, w, h, t: {"x": x, "y": y, "w": w, "h": h, "text": t}
    got = layout.lines([box(0.5, 0.1, 0.2, 0.02, "b"), box(0.1, 0.1, 0.2, 0.02, "a"), box(0.1, 0.2, 0.2, 0.02, "c")])
    assert [x["text"] for x in got] == ["a\tb", "c"]
    assert layout.joined(got) == "a\tb\n\n\n\n\nc"
    assert [x["text"] for x in layout.reading_order([box(0.5, 0.1, 1, 1, "r"), box(0.1, 0.105, 1, 1, "l")])] == ["l", "r"]


def test_css():
    tree = html_tree.parse('<div id="x" class="a b"><p style="color: red">t<b>u</b></p><p lang="en-US">v</p></div>')
    p1, p2 = (i for i in range(len(tree)) if tree.tag[i] == "p")
    for selector, want in (("div p", True), ("div > p", True), ("#x.a p:first-child", True), ("p + p", False), ("p[lang|=en]", False)):
        assert css.matches(tree, p1, selector) is want
    assert css.matches(tree, p2, "p + p") and css.matches(tree, p2, "p[lang|=en]") and css.matches(tree, p2, "p ~ p:last-child")
    assert css.specificity("#x.a p:first-child") == (1, 2, 1)
    got = {(r["node_id"], r["prop"]): (r["value"], r["inherited"]) for r in css.styles(tree, "p { color: blue; margin: 1px 2px } #x { color: green } p { color: black !important }")}
    assert got[p1, "color"] == ("black", False) and got[p1, "margin-left"] == ("2px", False)
    assert got[p1 + 2, "color"] == ("black", True)


def test_shorthands():
    sides = lambda name, value: dict(css.longhands(name, value))
    assert sides("padding", "1px 2px 3px") == {"padding-top": "1px", "padding-right": "2px", "padding-bottom": "3px", "padding-left": "2px"}
    assert sides("border-color", "red rgb(1, 2, 3)") == {"border-top-color": "red", "border-right-color": "rgb(1, 2, 3)", "border-bottom-color": "red", "border-left-color": "rgb(1, 2, 3)"}
    assert sides("margin", "1px 2px 3px 4px 5px") == {} == sides("margin", "")
    assert sides("border-left", "dashed hsl(20, 10%, 5%)") == {"border-left-width": "medium", "border-left-style": "dashed", "border-left-color": "hsl(20, 10%, 5%)"}
    assert sides("border", "2px")["border-bottom-width"] == "2px" and len(sides("border", "2px")) == 12
    assert css.longhands("page-break-after", "always") == [("break-after", "always")]
    assert css.longhands("background", "url(a b.png) no-repeat #abcd red") == [("background-color", "#abcd")] and css.longhands("background", "url(x)") == []
    assert css.is_color("RebeccaPurple") and css.is_color("rgba(1,2,3,.5)") and not any(map(css.is_color, ("#12345", "rgb(1,2)", "rgb(1,2%,3)", "solid")))


def test_styles_by_any_anchor():
    tree = html_tree.parse('<div id="x" class="a b"><p class="c">t</p></div>')
    got = {(tree.tag[r["node_id"]], r["prop"]): r["value"] for r in css.styles(tree, "* { a: 1 } DIV { b: 2 } .b { c: 3 } #x { d: 4 } div .c { e: 5 } :first-child { f: 6 } .a.b { c: 7 } p { c: 8 }")}
    assert {k: v for k, v in got.items() if k[0] in ("div", "p")} == {("div", "a"): "1", ("div", "b"): "2", ("div", "c"): "7", ("div", "d"): "4", ("div", "f"): "6", ("p", "a"): "1", ("p", "c"): "8", ("p", "e"): "5", ("p", "f"): "6"}


OLDER = b"""<?xml version="1.0"?><sl:document xmlns:sl="l" xmlns:sf="f" xmlns:sfa="a"><sf:paragraphstyle sfa:ID="s-1" sf:ident="lead" sf:name="Titel"/>
<sf:paragraphstyle sf:ident="s-2" sf:parent-ident="lead"/><sf:paragraphstyle sf:ident="loop" sf:parent-ident="loop"/>
<sf:text-storage sf:kind="note"><sf:p>aside</sf:p></sf:text-storage>
<sf:text-storage sf:kind="body"><sf:p sf:style="s-2">One<sf:br/>&amp; two<sf:ghost-text>prompt<sf:tab/></sf:ghost-text></sf:p><sf:p sf:style="loop">a<sf:tab/>b</sf:p><sf:p/></sf:text-storage>
<sf:tabular-model><sf:grid sf:numcols="2" sf:numrows="3"><sf:datasource><sf:t><sf:ct sfa:s="k"/></sf:t><sf:t><sf:ct/></sf:t><sf:g/><sf:n sf:v="2.5"/><sf:f><sf:fo sf:fs="=SUM(B)"/></sf:f></sf:datasource></sf:grid></sf:tabular-model></sl:document>"""


def test_older_pages_and_grids():
    for content in (OLDER, office.zipped([("index.xml", OLDER)])):
        assert [(r["seq"], r["text"], r["style"]) for r in iwork_xml.paragraphs(content)] == [(0, "One\n& two", "Titel"), (1, "a\tb", None), (2, "", None)]
        cells = list(iwork_xml.tables(content))
        assert [(c["row"], c["col"], c["value"], c["align"]) for c in cells] == [(0, 0, "k", "left"), (0, 1, "", "right"), (1, 0, "", "left"), (1, 1, "2.5", "right"), (2, 0, "=SUM(B)", "left")]
    assert [c["value"] for c in iwork.sheets(office.zipped([("index.xml", OLDER)]))] == ["k", "", "", "2.5", "=SUM(B)"]
    assert iwork_xml.paragraphs(b"") == [] == list(iwork_xml.tables(office.zipped([("other", b"")])))
    with pytest.raises(ValueError):
        iwork_xml.document(office.zipped([("index.xml.gz", b"")]))


def run(place, i):
    return sub(1, num(1, place) + sub(2, num(1, i)))


def test_footnotes_of_pages():
    note = lambda t: num(1, 2) + sub(3, t.encode())
    first = num(1, 0) + sub(3, b"ab") + sub(9, run(2, 50) + run(1, 60)) + sub(12, run(0, 99))
    second = num(1, 0) + sub(3, b"c") + sub(9, run(1, 70))
    objects = [(1, 2001, first), (2, 2001, second), (70, 2001, note("\ufffc one\ttwo\u2028three ")), (50, 900, sub(2, num(1, 51))), (51, 900, sub(1, num(1, 52))), (52, 900, sub(1, num(1, 53))), (53, 900, sub(1, num(1, 70)))]
    # 50 is too far from the note, 60 is two steps away
    objects += [(60, 900, sub(2, num(1, 60)) + sub(3, num(1, 61))), (61, 900, sub(1, num(1, 70)))]
    got = [(r["number"], r["body_seq"], r["place"], r["note_id"], r["text"]) for r in iwork_links.footnotes(bundle(("Document", archive(*objects))))]
    assert got == [(1, 0, 1, 70, "one two three"), (2, 1, 1, 70, "one two three")]
    nearer = bundle(("Document", archive(*[(i, t, sub(1, num(1, 70)) if i == 53 else p) for i, t, p in objects if i != 50], (50, 900, sub(2, num(1, 52))))))
    assert [r["place"] for r in iwork_links.footnotes(nearer)] == [1, 2, 1]


def test_images_of_pages():
    entry = lambda i, name: sub(3, num(1, i) + sub(4, name.encode()))
    files = {9: "map-31.png", 3: "map-7.png", 5: "map-12-small.png", 6: "PresetImageFill2-4.jpg", 7: "bullet_gray-1.png", 8: "scan.TIFF", 4: "notes.txt", 2: "a/b.png", 11: "map-1-44.png"}
    body = num(1, 0) + sub(3, "x\U0001d11e\ufffc\ufffc\ufffc".encode()) + sub(9, run(3, 20) + run(4, 30) + run(5, 40) + run(1, 20))
    wrapped = [(20, 900, sub(1, num(1, 21))), (21, 901, sub(8, num(1, 9))), (30, 900, sub(2, num(1, 5))), (40, 900, sub(2, num(1, 8)) + sub(3, num(1, 3)))]
    content = bundle(("Document", archive((1, 2001, body), *wrapped)), ("Metadata", archive((2, 11006, b"".join(entry(i, n) for i, n in files.items())))))
    assert [(r["data_id"], r["name"]) for r in iwork_links.images(content)] == [(3, "map.png"), (8, "scan.TIFF"), (9, "map-1.png"), (11, "map-1-1.png")]
    assert [(r["place"], r["name"]) for r in iwork_links.anchored_images(content)] == [(3, "map-1.png"), (5, "scan.TIFF")]


def test_body_of_several_storages():
    paragraph = lambda *o: [(r["seq"], r["text"]) for r in iwork.page_paragraphs(bundle(("Document", archive(*o))))]
    text = lambda kind, t: num(1, kind) + sub(3, t)
    assert paragraph((1, 2001, text(0, b"a\nb")), (2, 2001, text(0, b"c"))) == [(0, "a"), (1, "b"), (2, "c")]
    assert paragraph((1, 2001, text(0, b"")), (2, 2001, text(1, b"a long header")), (3, 2001, text(3, b"box"))) == [(0, "box")]
