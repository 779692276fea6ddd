from docloom.parse import blocks as B


def line(x, y, w, h, text):
    return {"x": x, "y": y, "w": w, "h": h, "text": text}


def texts(found):
    return [B.block_text(b) for b in found]


def test_lines_are_taken_once_and_the_rest_is_attached_or_alone():
    lines = [line(50, 100, 300, 20, "the heron"), line(50, 122, 280, 20, "waits"), line(50, 150, 200, 20, "near the reeds"), line(600, 700, 80, 20, " alone "), line(50, 400, 90, 20, "  ")]
    area = {"kind": "paragraph", "x": 50, "y": 95, "w": 300, "h": 45}
    got = B.composed(lines, [area, area], (1000, 1000))
    assert texts(got) == ["the heron\nwaits\nnear the reeds", "alone"]
    assert (got[0]["y"], got[0]["h"], got[0]["w"]) == (100, 70, 300)


def test_list_and_table_cells_take_their_lines():
    lines = [line(0, 0, 100, 10, "rope"), line(0, 50, 100, 10, "oar"), line(300, 0, 50, 10, "seen")]
    items = [{"x": 0, "y": 0, "w": 100, "h": 10, "text": "?", "marker": "-"}, {"x": 0, "y": 200, "w": 100, "h": 10, "text": "kept", "marker": "-"}]
    table = [[{"x": 300, "y": 0, "w": 50, "h": 10, "text": ""}, {"x": 500, "y": 0, "w": 50, "h": 10, "text": "own"}]]
    got = B.composed(lines, [{"kind": "list", "x": 0, "y": 0, "w": 100, "h": 210, "items": items}, {"kind": "table", "x": 300, "y": 0, "w": 250, "h": 10, "rows": table}])
    assert sorted(texts(got)) == ["oar", "rope\nkept", "seen\nown"]


def test_split_merge_and_headings():
    lines = [line(10, 0, 200, 20, "one"), line(10, 22, 200, 20, "two"), line(10, 80, 200, 20, "three"), line(10, 104, 90, 20, "Notes:"), line(10, 126, 200, 20, "four"), line(40, 148, 200, 20, "five")]
    whole = {"kind": "paragraph", "x": 10, "y": 0, "w": 230, "h": 170}
    assert texts(B.composed(lines, [whole])) == ["one\ntwo", "three\nNotes:\nfour\nfive"]
    alone = [B.paragraph([x]) for x in lines]
    assert texts(B.merged(alone)) == ["one\ntwo", "three", "Notes:", "four", "five"]
    assert not B.is_heading("notes:") and not B.is_heading("N" * 32 + ":") and not B.is_heading("") and not B.is_heading(":")


def test_post_processing():
    long = "a long passage about eels that is repeated in the margin of the page"
    pars = [B.paragraph([x]) for x in (line(0, 300, 400, 20, long + " and then some more"), line(0, 500, 300, 20, long), line(0, 0, 100, 20, "Eels"), line(500, 700, 90, 20, "eels!"), line(0, 100, 300, 20, "swim"), line(0, 126, 300, 20, "west"))]
    assert texts(B.post_processed(pars)) == ["Eels", "swim\nwest", long + " and then some more"]


def test_markdown():
    cell = lambda t: {"x": 0, "y": 0, "w": 1, "h": 1, "text": t}
    item = lambda t: cell(t) | {"marker": "a)"}
    page = [
        {"kind": "image", "x": 0, "y": 400, "w": 10, "h": 10, "source": "eel.png"},
        B.paragraph([line(0, 0, 100, 10, " up"), line(0, 12, 100, 10, "stream ")]),
        B.paragraph([line(0, 26, 100, 10, "again")]),
        {"kind": "list", "x": 0, "y": 200, "w": 10, "h": 10, "ordered": True, "items": [item("net"), item(" trap ")]},
        {"kind": "table", "x": 0, "y": 300, "w": 10, "h": 10, "rows": [[cell("a|b"), cell("c")], [cell(None)]]},
    ]
    assert B.markdown(page) == "up stream again\n\n1. net\n2. trap\n\n| a\\|b | c |\n| --- | --- |\n|  |  |\n\n![Image](eel.png)"
    assert B.markdown([]) == ""
