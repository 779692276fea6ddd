"""Operators on tables of HTML texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.plans.rowwise import rowwise

NODES = "node_id int, parent_id int, subtree_end int, depth int, sib_ord int, kind string, tag string, attrs map<string,string>, text string, transparent boolean"


def _parsed(html, base):
    import sys

    from docloom.parse import html_tree

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    return html_tree.parse(html, base)


def _nodes(html, base=None):
    tree = _parsed(html, base)
    order: dict[int, int] = {}
    for i in range(len(tree)):
        up = tree.parent[i]
        order[up] = order.get(up, -1) + 1
        yield {"node_id": i, "parent_id": up if up >= 0 else None, "subtree_end": tree.end[i], "depth": tree.depth[i], "sib_ord": order[up], "kind": tree.kind[i], "tag": tree.tag[i], "attrs": tree.attrs[i], "text": tree.text[i], "transparent": tree.kind[i] == "element" and tree.transparent(i)}


OUTPUTS = {"content": "string", "markdown": "string", "link_density": "double"}


def _rendered(html, base=None, main=False, outputs=tuple(OUTPUTS)):
    from docloom.parse import html_main, html_markdown, html_text, html_tree

    tree = _parsed(html, base)
    top, gone, tier = html_main.select(tree) if main else (html_tree.root(tree), set(), "whole")
    made = {
        "content": lambda: html_text.text(tree, top, gone).strip(),
        "markdown": lambda: html_markdown.markdown(tree, top, gone),
        "link_density": lambda: html_main.Measures(tree, gone).link_density(top),
    }
    return {"tier": tier} | {name: made[name]() for name in outputs}


def dom_nodes(pages: DataFrame, *, key: str = "page_id", html: str = "html", base: str | None = "url") -> DataFrame:
    """One row a node in document order: (key, NODES, _error)."""
    return rowwise(pages, _nodes, [html, *([base] if base else [])], NODES, [key], many=True)


def render(pages: DataFrame, *, main: bool = False, key: str = "page_id", html: str = "html", base: str | None = "url", outputs: tuple[str, ...] = tuple(OUTPUTS), keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, tier, outputs, _error); ``main`` keeps the main content only, and only the ``outputs`` asked for are made."""
    schema = ", ".join(["tier string", *[f"{name} {OUTPUTS[name]}" for name in outputs]])
    return rowwise(pages, lambda h, b=None: _rendered(h, b, main, outputs), [html, *([base] if base else [])], schema, [key, *keep])


def visible(nodes: DataFrame, key: str = "page_id", tags: tuple[str, ...] = ()) -> DataFrame:
    """Nodes outside the subtrees of ``tags``: a running maximum of subtree ends in document order, no range join."""
    order = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    until = F.max(F.when(F.col("tag").isin(*tags), F.col("subtree_end"))).over(order)
    return nodes.withColumn("_until", F.coalesce(until, F.lit(0))).where("node_id >= _until").drop("_until")


def subtree_sums(nodes: DataFrame, sums: dict[str, Column], key: str = "page_id") -> DataFrame:
    """Adds for each node the sum of an expression over its subtree.

    Running sums in document order; a subtree's sum is the running sum at its
    last node less that before its first, one equi-join on (key, node).
    """
    order = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    own = {f"_own_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    running = nodes.withColumns(own).withColumns({f"_run_{n}": F.sum(f"_own_{n}").over(order) for n in sums})
    ends = running.select(F.col(key).alias("_key"), (F.col("node_id") + 1).alias("_end"), *[F.col(f"_run_{n}").alias(f"_at_{n}") for n in sums])
    joined = running.join(ends, (F.col(key) == F.col("_key")) & (F.col("subtree_end") == F.col("_end")))
    return joined.select(*nodes.columns, *[(F.col(f"_at_{n}") - F.col(f"_run_{n}") + F.col(f"_own_{n}")).alias(n) for n in sums])


def link_density(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, node_id, tag, text_chars, link_chars, density) of every element."""
    order = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("node_id") < F.coalesce(F.max(F.when(F.col("tag") == "a", F.col("subtree_end"))).over(order), F.lit(0))
    chars = F.when(F.col("kind") == "text", F.length(F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))))
    marked = nodes.withColumn("_inside", inside)
    got = subtree_sums(marked, {"text_chars": chars, "link_chars": F.when(F.col("_inside"), chars)}, key)
    return got.where("kind = 'element'").select(key, "node_id", "tag", "text_chars", "link_chars", F.when(F.col("text_chars") > 0, F.least(F.lit(1.0), F.col("link_chars") / F.col("text_chars"))).otherwise(0.0).alias("density"))


def _with_text(nodes: DataFrame, tag: str, key: str) -> DataFrame:
    """Elements ``tag`` with the texts below them joined; elements of this kind do not nest."""
    order = Window.partitionBy(key).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    holder = F.last(F.when(F.col("tag") == tag, F.struct("node_id", "subtree_end", "attrs")), ignorenulls=True).over(order)
    inside = nodes.withColumn("_h", holder).where("node_id < _h.subtree_end")
    got = inside.groupBy(key, F.col("_h.node_id").alias("_id")).agg(F.any_value("_h.attrs").alias("attrs"), F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("node_id", "text")))).alias("_t"))
    return got.select(key, F.col("_id").alias("node_id"), "attrs", F.trim(F.regexp_replace(F.array_join(F.transform("_t", lambda x: x["text"]), ""), r"\s+", " ")).alias("text"))


def links(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, href, text) of the links with a place outside the page and a text."""
    found = _with_text(nodes, "a", key).select(key, "node_id", F.col("attrs")["href"].alias("href"), "text")
    found = found.where("href is not null and href <> '' and not startswith(href, '#') and text <> ''")
    return found.select(key, F.row_number().over(Window.partitionBy(key).orderBy("node_id")).alias("seq"), "href", "text")


def images(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, src, alt): images with a source that is not inline data; the default text is Image."""
    src, alt = F.col("attrs")["src"], F.col("attrs")["alt"]
    found = nodes.where((F.col("tag") == "img") & src.isNotNull() & (src != "") & ~src.startswith("data:"))
    return found.select(key, F.row_number().over(Window.partitionBy(key).orderBy("node_id")).alias("seq"), src.alias("src"), F.coalesce(F.nullif(alt, F.lit("")), F.lit("Image")).alias("alt"))


def saved_image_names(images: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, src, name): each source once, names made unique with -2, -3 .. in order of appearance."""
    first = images.groupBy(key, "src").agg(F.min("seq").alias("seq"))
    file = F.regexp_extract(F.regexp_replace("src", r"[?#].*$", ""), r"([^/]*)$", 1)
    named = first.withColumn("file", F.when(file == "", "image").otherwise(file))
    turn = F.row_number().over(Window.partitionBy(key, "file").orderBy("seq"))
    stem, ext = F.regexp_replace("file", r"\.[^.]*$", ""), F.regexp_extract("file", r"(\.[^.]*)$", 1)
    return named.withColumn("turn", turn).select(key, "src", F.when(F.col("turn") == 1, F.col("file")).otherwise(F.concat(stem, F.lit("-"), F.col("turn").cast("string"), ext)).alias("name"))


def stylesheets(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, seq, kind, value): inline CSS and links to style sheets in document order."""
    inline = nodes.alias("n").join(nodes.where("tag = 'style'").select(F.col(key).alias("_k"), F.col("node_id").alias("_p")), (F.col(key) == F.col("_k")) & (F.col("parent_id") == F.col("_p"))).where("kind = 'raw'").select(key, "node_id", F.lit("inline").alias("kind"), F.col("text").alias("value"))
    rel = F.split(F.lower(F.coalesce(F.col("attrs")["rel"], F.lit(""))), r"\s+")
    linked = nodes.where((F.col("tag") == "link") & F.array_contains(rel, "stylesheet") & F.col("attrs")["href"].isNotNull()).select(key, "node_id", F.lit("link").alias("kind"), F.col("attrs")["href"].alias("value"))
    every = inline.unionByName(linked)
    return every.select(key, F.row_number().over(Window.partitionBy(key).orderBy("node_id")).alias("seq"), "kind", "value")


def list_items(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, list_id, ordered, ordinal, item_id) of the direct items of lists."""
    lists = nodes.where("tag in ('ul', 'ol')").select(F.col(key).alias("_k"), F.col("node_id").alias("list_id"), (F.col("tag") == "ol").alias("ordered"))
    items = nodes.where("tag = 'li'").join(lists, (F.col(key) == F.col("_k")) & (F.col("parent_id") == F.col("list_id")))
    return items.select(key, "list_id", "ordered", F.row_number().over(Window.partitionBy(key, "list_id").orderBy("node_id")).alias("ordinal"), F.col("node_id").alias("item_id"))


def footnote_pairs(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ref_id, def_id): links to an element of the page whose subtree links back, a self-join in both directions."""
    anchors = nodes.where("tag = 'a'").select(key, "node_id", F.regexp_extract(F.coalesce(F.col("attrs")["href"], F.lit("")), r"#(.+)$", 1).alias("to"), F.col("attrs")["id"].alias("own")).where("to <> ''")
    targets = nodes.where(F.col("attrs")["id"].isNotNull()).select(key, F.col("node_id").alias("def_id"), "subtree_end", F.col("attrs")["id"].alias("to"))
    refs = anchors.join(targets, [key, "to"])
    back = anchors.select(key, F.col("node_id").alias("back_id"), F.col("to").alias("own"))
    return refs.join(back, [key, "own"]).where("back_id >= def_id and back_id < subtree_end").select(key, F.col("node_id").alias("ref_id"), "def_id").distinct()


def table_kinds(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, table_id, n_rows, n_cells, spread, is_layout) by the tests that aggregates express.

    Nested tables, one row, one cell in the first row, mostly images, mostly
    many-block cells, or uneven rows make a layout table.
    """
    tables = nodes.where("tag = 'table'").select(key, F.col("node_id").alias("table_id"), F.col("subtree_end").alias("table_end"))
    # rows hang on their table or on a section of it, cells on their row: equalities, also after a nested table
    sections = nodes.where("tag in ('thead', 'tbody', 'tfoot')").select(key, F.col("node_id").alias("up"), F.col("parent_id").alias("of"))
    rows_of = nodes.where("tag = 'tr'").select(key, F.col("node_id").alias("row_id"), F.col("parent_id").alias("up")).join(sections, [key, "up"], "left")
    rows_of = rows_of.select(key, "row_id", F.coalesce("of", "up").alias("table_id")).join(tables.select(key, "table_id"), [key, "table_id"], "left_semi")
    cells = nodes.where("tag in ('td', 'th')").select(key, "node_id", F.col("parent_id").alias("row_id")).join(rows_of, [key, "row_id"])
    blocks = F.col("tag").isin("p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6")
    kids = nodes.where("kind = 'element'").groupBy(key, F.col("parent_id").alias("node_id")).agg(F.count_if(blocks).alias("blocks"), F.count(F.lit(1)).alias("elements"), F.count_if(F.col("tag") == "img").alias("images"))
    cells = cells.join(kids, [key, "node_id"], "left").na.fill(0, ["blocks", "elements", "images"])
    rows = cells.groupBy(key, "table_id", "row_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("images") == 1) & (F.col("elements") == 1)).alias("image_only"), F.count_if(F.col("blocks") >= 3).alias("many"))
    rows = rows_of.join(rows.withColumnRenamed("table_id", "_t"), [key, "row_id"], "left").drop("_t").na.fill(0, ["n", "image_only", "many"])
    per = rows.groupBy(key, "table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n_cells"), F.min_by("n", "row_id").alias("first"), F.sum("image_only").alias("image_only"), F.sum("many").alias("many"), F.stddev_pop("n").alias("spread"))
    # tables do not overlap otherwise, so one that holds another ends after the next one begins
    following = F.lead("table_id").over(Window.partitionBy(key).orderBy("table_id"))
    holds = tables.withColumn("_next", following).where("_next < table_end").select(key, "table_id", F.lit(True).alias("has_inner"))
    per = per.join(holds, [key, "table_id"], "left")
    layout = F.coalesce("has_inner", F.lit(False)) | (F.col("n_rows") <= 1) | (F.col("first") <= 1) | (F.col("image_only") > 0.5 * F.col("n_cells")) | (F.col("many") > 0.3 * F.col("n_cells")) | (F.col("spread") > 1.0)
    return per.select(key, "table_id", "n_rows", "n_cells", "spread", layout.alias("is_layout"))


def css_rules(sheets: DataFrame, *, key: str = "page_id", css: str = "value") -> DataFrame:
    """(key, ord, selector, a, b, c, prop, value, important, _error) of style sheets."""

    def run(text):
        from docloom.parse.css import rules

        return rules(text or "")

    return rowwise(sheets, run, [css], "ord int, selector string, a int, b int, c int, prop string, value string, important boolean", [key], many=True)


def computed_styles(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node_id, prop, value, inherited, _error): the styles that the page's own sheets give its nodes."""

    def run(text):
        from docloom.parse.css import styles

        tree = _parsed(text, None)
        own = "\n".join(tree.text[i] for i in range(len(tree)) if tree.kind[i] == "raw" and tree.tag[tree.parent[i]] == "style")
        return styles(tree, own)

    return rowwise(pages, run, [html], "node_id int, prop string, value string, inherited boolean", [key], many=True)
