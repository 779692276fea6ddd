"""DataFrames from binary office files: rows (path, content) of ``sources.tables.files``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import paragraphs
from docloom.plans.rowwise import rowwise

RUNS = "para int, seq int, style string, outline int, num_id int, level int, format string, start int, text string, bold boolean, italic boolean, struck boolean, note_id int"


def _many(name: str, module: str = "office"):
    def run(content):
        from importlib import import_module

        return list(getattr(import_module(f"docloom.parse.{module}"), name)(content))

    return run


def _one(name: str):
    def run(content):
        from docloom.parse import office

        return getattr(office, name)(content)

    return run


def docx_runs(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("docx_runs"), ["content"], RUNS, ["path"], many=True)


def docx_notes(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("docx_notes"), ["content"], "note_id int, text string", ["path"], many=True)


def media(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("media"), ["content"], "name string, data binary", ["path"], many=True)


def emails(files: DataFrame) -> DataFrame:
    return rowwise(files, _one("eml_html"), ["content"], "subject string, html string, text string", ["path"])


def image_sizes(files: DataFrame) -> DataFrame:
    return rowwise(files, _one("image_size"), ["content"], "width int, height int", ["path"])


def sheet_cells(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("sheets", "iwork"), ["content"], "sheet_seq int, sheet string, table_seq int, row int, col int, kind string, value string, align string", ["path"], many=True)


def slide_texts(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("slide_texts", "iwork"), ["content"], "idx int, seq int, kind string, text string", ["path"], many=True)


def page_paragraphs(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("page_paragraphs", "iwork"), ["content"], "seq int, text string, font_size double, bold boolean, italic boolean, style_id long", ["path"], many=True)


def page_footnotes(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("footnotes", "iwork_links"), ["content"], "number int, body_seq int, place int, note_id long, text string", ["path"], many=True)


def page_images(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("images", "iwork_links"), ["content"], "data_id long, file string, name string", ["path"], many=True)


def page_anchors(files: DataFrame) -> DataFrame:
    return rowwise(files, _many("anchored_images", "iwork_links"), ["content"], "body_seq int, place int, data_id long, name string", ["path"], many=True)


def older_paragraphs(files: DataFrame) -> DataFrame:
    """(path, seq, text, style, level) of the body of older page files; ``level`` is the heading level of the style's name."""
    from docloom.functions.text import legacy_heading

    rows = rowwise(files, _many("paragraphs", "iwork_xml"), ["content"], "seq int, text string, style string", ["path"], many=True)
    return rows.withColumn("level", legacy_heading("style"))


def older_cells(files: DataFrame) -> DataFrame:
    """Cells of the grids of older page and sheet files."""
    return rowwise(files, _many("tables", "iwork_xml"), ["content"], "table_seq int, n_rows int, n_cols int, row int, col int, value string, align string", ["path"], many=True)


def docx_markdown(files: DataFrame) -> DataFrame:
    """(path, text): the Markdown of word-processor files from their run tables: merged runs, headings, numbered lists, footnotes."""
    from docloom.functions.text import four_space_tabs, heading_level

    runs = docx_runs(files).where("_error is null")
    marks = runs.where("note_id is not null").select(F.col("path").alias("doc_id"), F.struct("para", "seq").alias("seq"), "note_id")
    numbers = paragraphs.footnote_numbers(marks).withColumnRenamed("doc_id", "path")
    runs = runs.join(numbers, ["path", "note_id"], "left").withColumn("footnote", F.col("number"))
    texts = paragraphs.paragraph_texts(runs, ["path", "para"])
    props = runs.groupBy("path", "para").agg(*[F.first(c).alias(c) for c in ("style", "outline", "num_id", "level", "format", "start")])
    items = props.withColumn("seq", F.col("para")).withColumn("ordered", F.col("num_id").isNotNull() & (F.col("format") != "bullet"))
    marked = paragraphs.markers(paragraphs.numbered(items, doc="path"))
    heading = heading_level("style", F.col("outline"))
    rows = texts.join(marked, ["path", "para"]).withColumn("text", four_space_tabs("text"))
    lead = F.when(F.col("num_id").isNotNull(), F.concat(F.repeat(F.lit("    "), F.col("level")), "marker", F.lit(" "))).when(heading.isNotNull(), F.concat(F.repeat(F.lit("#"), heading), F.lit(" "))).otherwise("")
    rows = rows.where("text <> ''").select("path", F.col("para").alias("seq"), F.concat(lead, "text").alias("text"), F.col("num_id").isNotNull().alias("is_list"))
    notes = docx_notes(files).where("_error is null").join(numbers, ["path", "note_id"])
    ends = notes.select("path", (F.lit(1_000_000_000) + F.col("number")).alias("seq"), F.concat(F.lit("[^"), F.col("number").cast("string"), F.lit("]: "), "text").alias("text"), F.lit(False).alias("is_list"))
    return paragraphs.joined(rows.unionByName(ends), "path")
