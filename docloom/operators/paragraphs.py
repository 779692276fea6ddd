"""Relational operators over paragraph, run and list tables of word-processor files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import list_marker, run_markdown


def _joined(parts: Column, sep: str = "") -> Column:
    """Values of structs (seq, value) in the order of seq."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda p: p["value"]), sep)


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Adjacent runs of one style as one; a footnote mark separates.  Rows (keys, seq, text, bold, italic, struck, footnote)."""
    order = Window.partitionBy(*keys).orderBy("seq")
    style = F.struct("bold", "italic", "struck")
    starts = ~style.eqNullSafe(F.lag(style).over(order)) | F.col("footnote").isNotNull() | F.lag("footnote").over(order).isNotNull()
    islands = runs.withColumn("island", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(order))
    return islands.groupBy(*keys, "island").agg(F.min("seq").alias("seq"), _joined(F.struct("seq", F.col("text").alias("value"))).alias("text"), *[F.first(c).alias(c) for c in ("bold", "italic", "struck", "footnote")]).drop("island")


def paragraph_texts(runs: DataFrame, keys: list[str], markdown: bool = True) -> DataFrame:
    """(keys, text): the merged runs of a paragraph, marked up or plain, with footnote marks."""
    merged = merge_runs(runs, keys)
    body = run_markdown("text", F.coalesce("bold", F.lit(False)), F.coalesce("italic", F.lit(False)), F.coalesce("struck", F.lit(False))) if markdown else F.col("text")
    value = F.when(F.col("footnote").isNotNull(), F.concat(F.lit("[^"), F.col("footnote").cast("string"), F.lit("]"))).otherwise(body)
    return merged.groupBy(*keys).agg(_joined(F.struct("seq", value.alias("value"))).alias("text"))


def numbered(items: DataFrame, doc: str = "doc_id", start: str = "start") -> DataFrame:
    """Adds ``number`` to rows (doc, seq, num_id, level, ordered, start): counters by list and level that a shallower ordered item resets; other paragraphs and bullets do not.  Any number of levels."""
    by_list = Window.partitionBy(doc, "num_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    counts = F.col("num_id").isNotNull() & F.col("ordered")
    # one running count a level of resets that this level sees: ordered rows of smaller level
    deepest = (items.agg(F.max("level")).first()[0] or 0) + 1
    resets = F.array(*[F.sum((counts & (F.col("level") < k)).cast("int")).over(by_list) for k in range(deepest)])
    rows = items.withColumn("island", F.get(resets, F.col("level")))
    turn = F.sum(counts.cast("int")).over(Window.partitionBy(doc, "num_id", "level", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("number", F.when(counts, turn + F.greatest(F.coalesce(start, F.lit(1)), F.lit(1)) - 1)).drop("island")


def numbered_strict(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """As ``numbered`` for page layouts: a paragraph outside lists or a code block clears all counters, bullets clear deeper levels, empty paragraphs are passed over.  Rows (doc, seq, level, ordered, is_code, is_empty); level null outside lists."""
    live = items.where(~F.coalesce("is_empty", F.lit(False)))
    order = Window.partitionBy(doc).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    clears = F.col("level").isNull() | F.coalesce("is_code", F.lit(False))
    live = live.withColumn("run", F.sum(clears.cast("int")).over(order))
    inside = Window.partitionBy(doc, "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    resets = F.array(*[F.sum(F.coalesce((F.col("level") < k).cast("int"), F.lit(0))).over(inside) for k in range(9)])
    live = live.withColumn("island", F.get(resets, F.col("level")))
    ordered = F.col("level").isNotNull() & F.col("ordered") & ~clears
    turn = F.sum(ordered.cast("int")).over(Window.partitionBy(doc, "run", "level", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return live.withColumn("number", F.when(ordered, turn)).drop("run", "island")


def markers(items: DataFrame) -> DataFrame:
    """Adds ``marker``: the number by ``format`` with a dot, or a dash for bullets."""
    return items.withColumn("marker", F.when(F.col("number").isNotNull(), F.concat(list_marker(F.col("number"), F.col("format")), F.lit("."))).when(F.col("num_id").isNotNull(), F.lit("-")))


def joined(paragraphs: DataFrame, doc: str = "doc_id", text: str = "text", is_list: str = "is_list") -> DataFrame:
    """(doc, text): one newline between list items, else an empty line; empty paragraphs drop."""
    live = paragraphs.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    before = F.lag(is_list).over(Window.partitionBy(doc).orderBy("seq"))
    gap = F.when(before.isNull(), "").when(before & F.col(is_list), "\n").otherwise("\n\n")
    live = live.withColumn("_v", F.concat(gap, F.col(text)))
    return live.groupBy(doc).agg(_joined(F.struct("seq", F.col("_v").alias("value"))).alias("text"))


def footnote_numbers(marks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, note_id, number): numbered by first reference; rows (doc, seq, note_id)."""
    first = marks.groupBy(doc, "note_id").agg(F.min("seq").alias("first"))
    return first.select(doc, "note_id", F.dense_rank().over(Window.partitionBy(doc).orderBy("first")).alias("number"))


def body_sizes(paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, body_size): the font size of most text, a weighted mode; ties go to the smaller size."""
    by_size = paragraphs.where("font_size is not null").groupBy(doc, "font_size").agg(F.sum(F.length("text")).alias("chars"))
    return by_size.groupBy(doc).agg(F.max_by("font_size", F.struct("chars", -F.col("font_size"))).alias("body_size"))


def headings(paragraphs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds ``heading``: an explicit level within 1 .. 6, else by size ratio to the body for short single lines (200 characters, 140 if not bold)."""
    rows = paragraphs.join(body_sizes(paragraphs, doc), doc, "left")
    ratio = F.col("font_size") / F.col("body_size")
    short = F.length("text") <= F.when(F.coalesce("bold", F.lit(False)), 200).otherwise(140)
    fits = short & ~F.col("text").contains("\n") & (F.trim("text") != "") & (ratio > 1.15)
    return rows.withColumn("heading", F.when(F.col("explicit_level").isNotNull(), F.least(F.greatest(F.col("explicit_level"), F.lit(1)), F.lit(6))).when(fits, F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).otherwise(3)))


def slides(storages: DataFrame, deck: str = "doc_id") -> DataFrame:
    """(deck, idx, title, body, notes): a slide's first text is its title, the others its body; rows (deck, idx, seq, kind, text, is_layout), layouts left out."""
    live = storages.where(~F.coalesce("is_layout", F.lit(False)) & (F.trim("text") != ""))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("seq", "text")))), lambda x: x["text"])
    got = live.groupBy(deck, "idx").agg(texts.alias("t"), F.min_by("text", F.when(F.col("kind") == "note", F.col("seq"))).alias("notes"))
    return got.select(deck, "idx", F.get("t", F.lit(0)).alias("title"), F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))).alias("body"), F.when(F.exists(F.array("notes"), lambda n: n.isNotNull()), F.col("notes")).alias("notes"))


def deck_markdown(slides: DataFrame, deck: str = "doc_id") -> DataFrame:
    """(deck, markdown): a heading a slide, its body as bullets, notes quoted."""
    lines_of = lambda c: F.split(c, "\n")
    title = F.concat(F.lit("## "), F.coalesce("title", F.concat(F.lit("Slide "), F.col("idx").cast("string"))))
    body = F.transform(F.flatten(F.transform("body", lines_of)), lambda x: F.concat(F.lit("- "), x))
    notes = F.when(F.col("notes").isNotNull(), F.transform(lines_of(F.col("notes")), lambda x: F.concat(F.lit("> "), x)))
    parts = F.filter(F.array(title, F.when(F.size(body) > 0, F.array_join(body, "\n")), F.array_join(notes, "\n")), lambda x: x.isNotNull())
    one = slides.withColumn("md", F.array_join(parts, "\n\n"))
    return one.groupBy(deck).agg(_joined(F.struct(F.col("idx").alias("seq"), F.col("md").alias("value")), "\n\n").alias("markdown"))


def plain_lists(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, text): paragraphs as plain text with the markers that a page shows, four blanks a level, empty lines between; rows (doc, seq, text, level, ordered)."""
    body = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    rows = numbered_strict(items.withColumn("_body", body).withColumn("is_empty", F.col("_body") == "").withColumn("is_code", F.lit(False)), doc)
    mark = F.when(F.col("number").isNotNull(), F.concat(F.col("number").cast("string"), F.lit(". "))).otherwise("• ")
    value = F.when(F.col("level").isNull(), F.col("_body")).otherwise(F.concat(F.repeat(F.lit("    "), F.col("level").cast("int")), mark, "_body"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", value.alias("v")))), lambda x: x["v"]), "\n\n").alias("text"))


def style_headings(styles: DataFrame, doc: str = "doc_id", code: str = "code-block") -> DataFrame:
    """(doc, style_id, heading, is_code) from the identifier of the nearest style that has one; rows (doc, style_id, parent_id, identifier)."""
    from docloom.operators.joins import inherited

    name = F.regexp_extract(F.coalesce("identifier", F.lit("")), r"paragraphstyle-(.*)$", 1)
    digits = F.regexp_extract(name, r"^Heading ([0-9]{1,9})$", 1)
    level = F.when((name == "Title") | (name == "Heading"), 1).when(digits != "", F.greatest(F.least(F.try_to_number(digits, F.lit("999999999")).cast("int"), F.lit(6)), F.lit(1)))
    return inherited(styles, ["identifier"], doc=doc).select(doc, "style_id", level.cast("int").alias("heading"), F.coalesce(F.col("identifier").endswith(code), F.lit(False)).alias("is_code"))


def list_members(paragraphs: DataFrame, levels: DataFrame, list_styles: DataFrame, styles: DataFrame, doc: str = "doc_id", ordered_kind: int = 2) -> DataFrame:
    """(doc, seq, level, ordered): whether a paragraph at ``at`` is a list item.

    The list style and the level in force there are as-of joins over runs
    (doc, at, style_id) and (doc, at, level); ``styles`` has (doc, style_id,
    parent_id, markers array<int>), markers by level from the nearest style
    that has any: 0 is no list, ``ordered_kind`` a number, others a bullet.
    """
    from docloom.operators.joins import as_of, inherited

    rows = as_of(as_of(paragraphs.select(doc, "seq", "at"), list_styles, [doc], "at", "style_id"), levels, [doc], "at", "level")
    own = inherited(styles, ["markers"], doc=doc).select(doc, "style_id", "markers")
    rows = rows.join(own, [doc, "style_id"], "left").withColumn("level", F.greatest(F.coalesce("level", F.lit(0)), F.lit(0)))
    marker = F.get("markers", F.least(F.col("level"), F.size("markers") - 1).cast("int"))
    listed = F.coalesce(marker != 0, F.lit(False))
    return rows.select(doc, "seq", F.when(listed, F.col("level")).alias("level"), (listed & (marker == ordered_kind)).alias("ordered"))
