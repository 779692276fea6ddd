"""Operators over page geometry: fragments, lines and blocks (doc, page, x, y, w, h, text), y downwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import comparable_text
from docloom.plans.rowwise import rowwise

PAGE = ["doc_id", "page"]
BOX = "x double, y double, w double, h double, text string"


def _pages(rows: DataFrame) -> DataFrame:
    """One row a page: its boxes as an array."""
    return rows.groupBy(*PAGE).agg(F.collect_list(F.struct("x", "y", "w", "h", "text")).alias("boxes"))


def _per_page(rows: DataFrame, name: str, scale: float = 1.0) -> DataFrame:
    def run(boxes):
        from docloom.parse import layout

        steps = {"lines": layout.lines, "order": layout.reading_order, "paragraphs": lambda b: layout.paragraphs(layout.lines(b), scale)}
        return [b | {"seq": i} for i, b in enumerate(steps[name](sorted(boxes, key=lambda b: (b["y"], b["x"], b["text"]))))]

    return rowwise(_pages(rows), run, ["boxes"], f"seq int, {BOX}", PAGE, many=True)


def lines(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, seq, BOX): fragments gathered to lines."""
    return _per_page(fragments, "lines")


def reading_order(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, BOX): the exact comparator order."""
    return _per_page(blocks, "order")


def paragraphs(fragments: DataFrame, scale: float = 1000.0) -> DataFrame:
    """(doc_id, page, seq, BOX): lines merged to paragraphs; ``scale`` is page units a unit of the boxes."""
    return _per_page(fragments, "paragraphs", scale)


def page_text(page_lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): newlines by the gap in line heights, a rule where the page steps back up."""
    order = Window.partitionBy(*PAGE).orderBy("seq")
    mean = F.avg("h").over(Window.partitionBy(*PAGE))
    step = F.col("y") - F.lag("y").over(order)
    gap = F.when(step.isNull(), "").when(step <= 0, "\n---\n").otherwise(F.repeat(F.lit("\n"), F.greatest(F.lit(1), F.bround(step / mean, 0).cast("int"))))
    rows = page_lines.withColumn("_v", F.concat(gap, "text"))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_v"))), lambda x: x["_v"]), "").alias("text"))


def typical_height(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, height): the upper median of the fragments' heights."""
    heights = F.array_sort(F.collect_list("h"))
    return fragments.groupBy(*PAGE).agg(heights.alias("_h")).select(*PAGE, F.get("_h", F.floor(F.size("_h") / 2).cast("int")).alias("height"))


def assigned(page_lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, page, seq, block): the first block around a line's middle, with a tolerance of 0.15 of its height or 0.01.

    The page keeps it a hash join; the inequality is a residual filter.
    """
    b = blocks.select(*PAGE, F.col("seq").alias("block"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    tolerance = F.greatest(0.15 * F.col("h"), F.lit(0.01))
    middle = F.col("y") + F.col("h") / 2
    near = page_lines.join(b, PAGE).where((middle >= F.col("by") - tolerance) & (middle <= F.col("by") + F.col("bh") + tolerance) & (F.col("x") < F.col("bx") + F.col("bw") + tolerance) & (F.col("x") + F.col("w") > F.col("bx") - tolerance))
    return near.groupBy(*PAGE, "seq").agg(F.min("block").alias("block"))


def anchors(page_lines: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, image, line): the first line with more than 0.05 overlap, or around the image's middle."""
    from docloom.functions.geometry import contains, overlap_ratio

    i = images.select(*PAGE, "image", F.struct(*[F.col(c) for c in "xywh"]).alias("ir"))
    near = page_lines.withColumn("lr", F.struct(*"xywh")).join(i, PAGE)
    hit = (overlap_ratio(F.col("lr"), F.col("ir")) > 0.05) | contains(F.col("lr"), F.col("ir.x") + F.col("ir.w") / 2, F.col("ir.y") + F.col("ir.h") / 2)
    return near.where(hit).groupBy(*PAGE, "image").agg(F.min("seq").alias("line"))


def split_by_gap(page_lines: DataFrame, least: float = 0.016) -> DataFrame:
    """Adds ``paragraph``: a new one where the gap to the line above is over 0.8 of the taller of both and over ``least``.

    Lines are in order of (seq, y, x, h, text), so that equal numbers do not
    make the result depend on the plan.
    """
    order = Window.partitionBy(*PAGE).orderBy("seq", "y", "x", "h", "text")
    gap = F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)
    tall = F.greatest(F.col("h"), F.lag("h").over(order))
    return page_lines.withColumn("_new", F.coalesce((gap > F.greatest(0.8 * tall, F.lit(least))).cast("int"), F.lit(0))).withColumn("paragraph", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


#: A block of a page: boxes in page units, with what its kind needs.
BLOCK = (
    "kind string, x double, y double, w double, h double, text string, source string, ordered boolean, "
    "lines array<struct<x:double,y:double,w:double,h:double,text:string>>, "
    "items array<struct<x:double,y:double,w:double,h:double,text:string,marker:string>>, "
    "rows array<array<struct<x:double,y:double,w:double,h:double,text:string>>>"
)

FIELDS = tuple(x.split(" ", 1)[0] for x in BLOCK.split(", "))


def _blocks(blocks: DataFrame) -> DataFrame:
    """One row a page: its blocks as an array, in order of seq."""
    fields = [x.split(" ", 1) for x in BLOCK.split(", ")]
    columns = [n for n, _ in fields]
    missing = [F.lit(None).cast(t).alias(n) for n, t in fields if n not in blocks.columns]
    rows = blocks.select(*PAGE, "seq", *[c for c in columns if c in blocks.columns], *missing)
    return rows.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*columns).alias("b")))), lambda x: x["b"]).alias("blocks"))


def _made(outputs: tuple[str, ...]) -> str:
    """The schema of (seq, the ``outputs`` of BLOCK)."""
    kinds = dict(x.split(" ", 1) for x in BLOCK.split(", "))
    return ", ".join(["seq int", *[f"{n} {kinds[n]}" for n in outputs]])


def _many(step):
    return lambda *values: [b | {"seq": i} for i, b in enumerate(step(*values))]


def composed(page_lines: DataFrame, blocks: DataFrame, page: tuple[float, float] = (1000.0, 1000.0), *, outputs: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, page, seq, outputs): recognised blocks filled with the page's lines, the others attached or paragraphs of their own; ``outputs`` are columns of BLOCK."""

    def run(boxes, held):
        from docloom.parse import blocks as B

        return B.composed(sorted(boxes or [], key=lambda b: (b["y"], b["x"], b["text"])), held or [], page)

    both = _pages(page_lines).join(_blocks(blocks), PAGE, "full")
    return rowwise(both, _many(run), ["boxes", "blocks"], _made(outputs), PAGE, many=True)


def post_processed(blocks: DataFrame, page: tuple[float, float] = (1000.0, 1000.0), *, outputs: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, page, seq, outputs): ordered, merged, split and without repeats; ``outputs`` are columns of BLOCK."""

    def run(held):
        from docloom.parse import blocks as B

        return B.post_processed(held, page)

    return rowwise(_blocks(blocks), _many(run), ["blocks"], _made(outputs), PAGE, many=True)


def blocks_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, markdown): the blocks of each page as Markdown."""

    def run(held):
        from docloom.parse import blocks as B

        return {"markdown": B.markdown(held)}

    return rowwise(_blocks(blocks), run, ["blocks"], "markdown string", PAGE)


def split_by_char_gap(chars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fragment, text, x, y, w, h): characters (keys, seq, ch, x, y, w, h) gathered to fragments.

    A new one begins after white space where the gap is over 1.5 of the mean
    width, 0.6 of the mean height and 4; widths count up to 3 heights (at
    least 12).  Lags and a running sum, no recognition.
    """
    order = Window.partitionBy(*keys).orderBy("seq")
    rows = chars.withColumn("_blank", F.col("ch").rlike(r"^\s*$"))
    rows = rows.withColumn("_spaced", F.coalesce(F.lag("_blank").over(order), F.lit(False)))
    boxed = ~F.col("_blank") & (F.col("w") > 0) & (F.col("h") > 0)
    before = F.last(F.when(boxed, F.struct("x", "w", "h")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_b", before)
    tall = F.greatest((F.col("_b.h") + F.col("h")) / 2, F.lit(1.0))
    limit = F.greatest(3 * tall, F.lit(12.0))
    own, last = F.least("w", limit), F.least("_b.w", limit)
    gap = F.col("x") - (F.col("_b.x") + last)
    cut = boxed & F.col("_spaced") & (gap > F.greatest(1.5 * F.greatest((own + last) / 2, F.lit(1.0)), 0.6 * tall, F.lit(4.0)))
    rows = rows.withColumn("_cut", F.coalesce(cut.cast("int"), F.lit(0))).withColumn("_part", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    seen = lambda c: F.when(boxed, c)
    parts = rows.groupBy(*keys, "_part").agg(
        F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda c: c["ch"]), ""), r"^\s+|\s+$", "")).alias("text"),
        F.min(seen(F.col("x"))).alias("x"), F.min(seen(F.col("y"))).alias("y"), F.max(seen(F.col("x") + F.col("w"))).alias("_r"), F.max(seen(F.col("y") + F.col("h"))).alias("_d"),
    )
    parts = parts.where("text <> '' and x is not null")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_part"))
    return parts.select(*keys, number.alias("fragment"), "text", "x", "y", (F.col("_r") - F.col("x")).alias("w"), (F.col("_d") - F.col("y")).alias("h"))


def first_lines(page_lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Lines without repeats: the first of each comparable text; those without one drop."""
    keyed = page_lines.withColumn("_k", comparable_text(text)).where("_k <> ''")
    return keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("seq"))).where("_r = 1").drop("_k", "_r")


def first_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without repeats on a page: equal comparable texts, and texts of over 40 characters inside an earlier one that is over 10 longer."""
    keyed = blocks.withColumn("_k", comparable_text("text"))
    once = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE, "_k").orderBy("seq"))).where("_r = 1").drop("_r")
    seen = once.select(*PAGE, F.col("seq").alias("_s"), F.col("_k").alias("_o"))
    part = once.join(seen, PAGE).where((F.length("_k") > 40) & (F.col("_s") < F.col("seq")) & (F.length("_o") > F.length("_k") + 10) & F.col("_o").contains(F.col("_k")))
    return once.join(part.select(*PAGE, "seq").distinct(), [*PAGE, "seq"], "left_anti").drop("_k")


def candidate_images(rects: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rectangles that may be images: at least 1 % of the page, under 95 % wide and high, not over 35 % text."""
    from docloom.functions.geometry import overlap

    sized = rects.where("w * h >= 0.01 and w < 0.95 and h < 0.95").withColumn("ir", F.struct(*"xywh"))
    b = blocks.select(*PAGE, F.struct(*"xywh").alias("br"))
    text = sized.join(b, PAGE).groupBy(*PAGE, "image").agg(F.sum(overlap(F.col("ir"), F.col("br"))).alias("_t"))
    return sized.join(text, [*PAGE, "image"], "left").where(F.coalesce("_t", F.lit(0.0)) <= 0.35 * F.col("w") * F.col("h")).drop("_t", "ir")


def transcript(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, text): blocks in order; list items with markers, tables by bars, images named."""
    body = (
        F.when(F.col("kind") == "list", F.array_join(F.transform("items", lambda i: F.concat(F.coalesce(i["marker"], F.lit("•")), F.lit(" "), F.replace(i["text"], F.lit("\n"), F.lit("\n  ")))), "\n"))
        .when(F.col("kind") == "table", F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ", "")), "\n"))
        .when(F.col("kind") == "image", F.concat(F.lit("[Image: "), F.coalesce("text", F.lit("")), F.lit("]")))
        .otherwise(F.col("text"))
    )
    rows = blocks.withColumn("_v", body)
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_v"))), lambda x: x["_v"]), "\n\n").alias("text"))
