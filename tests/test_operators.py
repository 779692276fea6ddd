import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry
from docloom.functions import text as T
from docloom.operators import html, joins, layout, markdown, paragraphs, tables


def rows(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_text_functions(spark):
    df = spark.createDataFrame([("a & <b> \"c\"", "  ** x", "12. Hello®, World!", "• item", "a\tb ")], "e string, m string, k string, i string, t string")
    got = df.select(T.escape_text("e").alias("e"), T.escape_attribute("e").alias("a"), T.comparable_text("k").alias("k"), T.clean_list_item("i").alias("i"), T.four_space_tabs("t").alias("t"), T.externalized(F.lit(" x "), F.lit("**")).alias("b")).first()
    assert tuple(got) == ("a &amp; &lt;b&gt; \"c\"", "a &amp; &lt;b&gt; &quot;c&quot;", "hello world", "item", "a    b", " **x** ")
    plain = spark.sql("select '# Head\n> quote **b** [l](u) ![i](s)\n-----\n' as t").select(T.strip_markdown("t").alias("t")).first()["t"]
    assert plain.split("\n")[:2] == ["Head", "quote b l i"] and "---" in plain


def test_style_names(spark):
    df = spark.createDataFrame([("Subtitle", None), ("Title", None), ("heading 4", None), ("Body", 2), ("Body", None), ("My Subheading", None)], "name string, outline int")
    assert rows(df.select(T.heading_level("name", F.col("outline")).alias("h")), "h") == [2, 1, 4, 3, None, 3]


def test_numerals(spark):
    df = spark.createDataFrame([(1,), (26,), (27,), (702,), (703,), (1994,)], "n int")
    assert rows(df.select(T.alphabetic(F.col("n")).alias("a"), T.roman(F.col("n")).alias("r")), "a", "r") == [("a", "i"), ("z", "xxvi"), ("aa", "xxvii"), ("zz", "dccii"), ("aaa", "dcciii"), ("bxr", "mcmxciv")]


def test_urls_and_charsets(spark):
    df = spark.createDataFrame([("a.png",), ("/a.png",), ("//h/a.png",), ("data:x",), ("http://x/y",)], "s string")
    assert rows(df.select(T.resolved_url("s", F.lit("http://h.org/d/p.html?q")).alias("u")), "u") == ["http://h.org/d/a.png", "http://h.org/a.png", "//h/a.png", "data:x", "http://x/y"]
    got = spark.createDataFrame([(b"\xe9", "Latin1"), (b"\xc3\xa9", "utf-8"), (b"x", "who")], "b binary, l string").select(T.decoded("b", "l").alias("t"))
    assert rows(got, "t") == ["é", "é", None]


PAGE = "<html><head><style>p{}</style></head><body><nav><ul><li><a href='/x'>go on</a></li></ul></nav><article><p>Some <b>text</b> and <a href='y'>more</a></p><img src='i.png'><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></article></body></html>"


def test_nodes(spark):
    pages = spark.createDataFrame([(1, "http://h/d/", PAGE), (2, None, None), (3, "http://h", "<p>")], "page_id long, url string, html string")
    nodes = html.dom_nodes(pages)
    assert nodes.where("_error is not null").count() == 0 and nodes.where("page_id = 2").count() == 1
    assert rows(html.links(nodes), "seq", "href", "text") == [(1, "http://h/x", "go on"), (2, "http://h/d/y", "more")]
    assert rows(html.images(nodes), "src", "alt") == [("i.png", "Image")]
    assert rows(html.stylesheets(nodes), "kind", "value") == [("inline", "p{}")]
    assert rows(html.list_items(nodes), "ordinal", "ordered") == [(1, False)]
    assert rows(html.table_kinds(nodes), "n_rows", "n_cells", "is_layout") == [(2, 4, False)]
    density = {r["tag"]: r["density"] for r in html.link_density(nodes).where("page_id = 1").collect()}
    assert density["nav"] == 1.0 and 0 < density["article"] < 0.5
    assert html.visible(nodes, tags=("nav",)).where("tag = 'li'").count() == 0
    got = {r["page_id"]: r for r in html.render(pages, main=True).collect()}
    assert got[1]["tier"] == "semantic" and "go on" not in got[1]["content"] and got[2]["content"] == ""


def test_relational_density_equals_sequential(spark):
    from docloom.parse import html_main, html_tree

    nodes = html.dom_nodes(spark.createDataFrame([(1, None, PAGE)], "page_id long, url string, html string"))
    tree = html_tree.parse(PAGE)
    m = html_main.Measures(tree, set())
    for r in html.link_density(nodes).collect():
        assert r["text_chars"] == m.size(r["node_id"]) and r["density"] == pytest.approx(m.link_density(r["node_id"]))


def test_footnote_pairs(spark):
    page = '<p>x<a href="#n1" id="r1">1</a></p><ol><li id="n1">note <a href="#r1">back</a></li></ol><a href="#top">t</a>'
    nodes = html.dom_nodes(spark.createDataFrame([(1, page)], "page_id long, html string"), base=None)
    assert html.footnote_pairs(nodes).count() == 1


def test_saved_names(spark):
    images = spark.createDataFrame([(1, 1, "a/x.png"), (1, 2, "b/x.png"), (1, 3, "a/x.png"), (1, 4, "c/y.png?q")], "page_id int, seq int, src string")
    assert dict(rows(html.saved_image_names(images), "src", "name")) == {"a/x.png": "x.png", "b/x.png": "x-2.png", "c/y.png?q": "y.png"}


def test_markdown_errors_do_not_fail(spark):
    docs = spark.createDataFrame([(1, "# a"), (2, None)], "doc_id long, text string")
    assert sorted(rows(markdown.to_html(docs), "doc_id", "html")) == [(1, "<h1>a</h1>"), (2, "")]


def test_page_lists(spark):
    # (seq, level, ordered, is_code, is_empty): text clears, bullets clear deeper levels only, empty paragraphs are passed over
    data = [(1, 0, True, False, False), (2, 1, True, False, False), (3, 0, True, False, False), (4, 1, True, False, False), (5, 0, False, False, True), (6, 0, False, False, False), (7, 0, True, False, False), (8, None, False, False, False), (9, 0, True, False, False)]
    items = spark.createDataFrame([(1, *x) for x in data], "doc_id int, seq int, level int, ordered boolean, is_code boolean, is_empty boolean")
    got = dict(rows(paragraphs.numbered_strict(items), "seq", "number"))
    assert got == {1: 1, 2: 1, 3: 2, 4: 1, 6: None, 7: 3, 8: None, 9: 1}


def test_tables(spark):
    data = [(0, 0, "Item"), (0, 1, "Qty"), (0, 2, "Price"), (1, 0, "a|b"), (1, 2, "12.49"), (2, 0, None), (2, 3, "")]
    cells = spark.createDataFrame([(1, *x) for x in data], "t int, row int, col int, value string")
    used = tables.used_range(cells, ["t"])
    assert tables.gfm(used, ["t"]).first()["markdown"] == "| Item | Qty | Price |\n| --- | --- | --: |\n| a\\|b |  | 12.49 |"
    assert tables.tsv(used, ["t"]).first()["tsv"] == "Item\tQty\tPrice\na|b\t\t12.49"
    sheets = spark.createDataFrame([(1, 0, "S1", 0, "A"), (1, 1, "S2", 0, "B")], "doc_id int, sheet_seq int, sheet string, table_seq int, markdown string")
    assert tables.sheets_markdown(sheets).first()["markdown"] == "## S1\n\nA\n\n## S2\n\nB"


def test_joins(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 5, "b"), (1, 7, "c")], "k int, at int, v string")
    assert sorted(rows(joins.as_of(left, right, ["k"], "at", "v"), "k", "at", "v"), key=str) == [(1, 0, None), (1, 5, "b"), (2, 9, None)]
    styles = spark.createDataFrame([(1, 1, 2, None, 0), (1, 2, 3, 12, None), (1, 3, 1, 9, 5)], "doc_id int, style_id int, parent_id int, size int, bold int")
    assert dict((r["style_id"], (r["size"], r["bold"])) for r in joins.inherited(styles, ["size", "bold"]).collect()) == {1: (12, 0), 2: (12, 5), 3: (9, 5)}
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 9, 8)], "doc_id int, src int, dst int")
    assert sorted(rows(joins.reachable(edges, spark.createDataFrame([(1, 1)], "doc_id int, id int")), "id")) == [1, 2, 3]


def test_geometry(spark):
    df = spark.sql("select named_struct('x', 0.0D, 'y', 0.0D, 'w', 2.0D, 'h', 2.0D) a, named_struct('x', 1.0D, 'y', 1.0D, 'w', 2.0D, 'h', 2.0D) b")
    got = df.select(geometry.overlap(F.col("a"), F.col("b")).alias("o"), geometry.overlap_ratio(F.col("a"), F.col("b")).alias("r"), geometry.clamped(F.col("b")).alias("c")).first()
    assert got["o"] == 1.0 and got["r"] == 0.25 and got["c"]["w"] == 0.0


def test_blocks(spark):
    long = "this is a long paragraph of text that goes on for more than forty characters"
    blocks = spark.createDataFrame([(1, 0, 1, long + " and then some more words"), (1, 0, 2, long), (1, 0, 3, "Short"), (1, 0, 4, "short!")], "doc_id int, page int, seq int, text string")
    assert sorted(rows(layout.first_blocks(blocks), "seq")) == [1, 3]


def test_every_query_has_a_stable_schema(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50
    assert __spark_entry__.entry(spark).count() > 0


def test_streams(spark, tmp_path):
    from docloom.streaming import streams

    spark.createDataFrame([(1, "# a"), (2, "*b*")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    stream = streams.table(spark, f"{tmp_path}/in", "doc_id long, text string")
    streams.run_available(stream, markdown.to_html, f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(rows(spark.read.parquet(f"{tmp_path}/out"), "html")) == ["<h1>a</h1>", "<p><em>b</em></p>"]


def test_docx_markdown(spark):
    from docloom.sinks.files import to_docx
    from docloom.sources.office import docx_markdown

    text = "# T\n\nHello **b**[^1].\n\n- a\n- b\n\n1. x\n2. y\n\n[^1]: note text"
    files = to_docx(spark.createDataFrame([(7, text)], "doc_id long, text string")).select(F.col("doc_id").alias("path"), "content")
    assert docx_markdown(files).first()["text"] == "# T\n\nHello **b**[^1].\n\n- a\n- b\n1. x\n2. y\n\n[^1]: note text"


def test_reachable_over_long_chains(spark):
    edges = spark.createDataFrame([(1, i, i + 1) for i in range(66)] + [(1, 66, 60)], "doc_id int, src int, dst int")
    got = joins.reachable(edges, spark.createDataFrame([(1, 0)], "doc_id int, id int"))
    assert sorted(r["id"] for r in got.collect()) == list(range(67))


def test_numbered_beyond_nine_levels(spark):
    items = spark.createDataFrame([(1, 1, 1, 11, True), (1, 2, 1, 11, True), (1, 3, 1, 10, True), (1, 4, 1, 11, True), (1, 5, None, None, None)], "doc_id int, seq int, num_id int, level int, ordered boolean").withColumn("start", F.lit(1))
    assert sorted(rows(paragraphs.numbered(items), "seq", "number"), key=str) == [(1, 1), (2, 2), (3, 1), (4, 1), (5, None)]


def test_gap_split_takes_the_taller_line_and_breaks_ties(spark):
    lines = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1.0, 0.1, "a"), (1, 0, 2, 0.0, 0.17, 1.0, 0.05, "b"), (1, 0, 2, 0.0, 0.3, 1.0, 0.05, "c")], "doc_id int, page int, seq int, x double, y double, w double, h double, text string")
    assert sorted(rows(layout.split_by_gap(lines), "text", "paragraph")) == [("a", 0), ("b", 0), ("c", 1)]


def test_files_by_format(spark, tmp_path):
    from docloom.sinks.files import save, to_plain
    from docloom.sources.tables import as_text, decoded, files

    docs = spark.createDataFrame([(1, "# Eel **one**"), (2, None)], "doc_id long, text string")
    for kind, ending in (("text", ".txt"), ("markdown", ".md"), ("json", ".json")):
        assert save(to_plain(docs, kind), f"file://{tmp_path}/{kind}", ending).count() == 2
    got = {r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1]: r["text"] for r in as_text(files(spark, str(tmp_path))).collect()}
    assert got["markdown/1.md"] == "# Eel **one**" and got["text/1.txt"] == "Eel one" and got["json/1.json"] is None
    odd = spark.createDataFrame([("a", "é".encode("cp1252"), "'Windows_1252'"), ("b", "日".encode("shift_jis"), "SJIS"), ("c", "é".encode(), None), ("d", b"x", "klingon"), ("e", b"\xff", "utf-8")], "path string, content binary, charset string")
    assert {r["path"]: r["text"] for r in decoded(odd).collect()} == {"a": "é", "b": "日", "c": "é", "d": None, "e": None}


def test_sanitized_paths_agree(spark):
    from docloom.functions.sanitize import sanitize, sanitized

    texts = ["plain é text", "", None, "a\r\nb", "e\u0301", "x" + "\u0301" * 40, "\u202eabc", "日本"]
    got = {r["doc_id"]: r for r in sanitized(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        want = sanitize(t)
        assert {k: got[i][k] for k in want} == want


def test_nearest_ties_and_gaps(spark):
    """Of several at one place the largest value, before and after; nulls, NaN and null keys as in SQL; no row is lost."""
    nan = float("nan")
    left = spark.createDataFrame([(1, 1, 5.0), (1, 2, 9.0), (1, 3, None), (1, 4, nan), (None, 5, 5.0), (2, 6, 1.0), (3, 7, 1.0), (1, 8, 5.0)], "k int, id int, at double")
    right = spark.createDataFrame([(1, 7.0, 30), (1, 7.0, 33), (1, 7.0, 31), (1, 3.5, 8), (1, nan, 90), (1, None, 99), (None, 5.0, 60), (2, None, 11), (2, None, 12)], "k int, at double, other int")
    got = {r["id"]: (r["other"], r["distance"]) for r in joins.nearest(left, right, ["k"], "at", "other").collect()}
    assert got[1] == got[8] == (8, 1.5) and got[2] == (33, 2.0)
    assert got[3] == (8, None) and got[4][0] == 8 and got[5] == (None, None) and got[6] == (12, None) and got[7] == (None, None)
    after = joins.nearest(left.where("id = 1"), right.where("at = 7"), ["k"], "at", "other", found="f").first()
    assert (after["other"], after["distance"], after["f"]) == (33, 2.0, 7.0)


def test_cascade_of_equal_declarations(spark):
    """Equal declarations: the first in place; null ranks highest, null values do not count."""
    rows = spark.createDataFrame([(1, "p", 7, 1, 0.5, 2), (1, "p", 8, 1, 0.5, 1), (1, "p", 9, 1, 0.5, 3), (2, "p", 5, 1, None, 1), (2, "p", 6, 1, 9.0, 2), (2, "p", None, 2, 1.0, 3), (3, "p", None, 1, 1.0, 1)], "k int, prop string, value int, level int, a double, place long")
    rows = rows.withColumns({"b": F.lit(0), "c": F.lit(0), "ord": F.lit(1)})
    assert {(r["k"], r["value"]) for r in joins.cascade(rows.repartition(3), ["k"], place="place").collect()} == {(1, 8), (2, 5), (3, None)}


def test_table_in_order(spark, tmp_path):
    from docloom.sources.tables import table_in_order

    for name, ids in (("b", [5, 6]), ("a", [9, 1, 4])):
        spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.parquet(str(tmp_path / name))
        (tmp_path / "t.parquet").mkdir(exist_ok=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "t.parquet" / f"{name}.parquet")
    assert [r["id"] for r in table_in_order(spark, str(tmp_path), "t").orderBy("place").collect()] == [9, 1, 4, 5, 6]


def test_rowwise_values():
    """Column by column the same values as cell by cell, for slices, nulls and empty arrays of nested rows."""
    import pyarrow as pa

    from docloom.plans.rowwise import values

    kind = pa.list_(pa.struct([("x", pa.float64()), ("t", pa.string()), ("n", pa.list_(pa.struct([("i", pa.int32())])))]))
    rows = [[{"x": 1.5, "t": "a", "n": [{"i": 1}, None]}], None, [], [{"x": None, "t": None, "n": None}, None, {"x": float("inf"), "t": "b", "n": []}], [{"x": 2.0, "t": "c", "n": [{"i": None}]}]]
    array = pa.array(rows, kind)
    assert values(array) == rows and [values(array.slice(a, 2)) for a in range(5)] == [rows[a : a + 2] for a in range(5)]
    assert values(pa.array([], kind)) == [] and values(pa.array([1, 2], pa.int64())) == [1, 2] and values(pa.array([b"x", None])) == [b"x", None]


def test_block_outputs(spark):
    """Only the columns asked for are made, with the same values."""
    lines = spark.createDataFrame([(1, 0, i, 0.0, 20.0 * i, 50.0, 10.0, f"t{i}") for i in range(4)], "doc_id int, page int, seq int, x double, y double, w double, h double, text string")
    blocks = lines.withColumn("kind", F.lit("paragraph")).withColumn("lines", F.array(F.struct("x", "y", "w", "h", "text")))
    few = layout.post_processed(blocks, outputs=("kind", "text"))
    assert few.columns == ["doc_id", "page", "seq", "kind", "text", "_error"]
    assert rows(few, *few.columns) == rows(layout.post_processed(blocks), *few.columns)
