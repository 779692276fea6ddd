"""Readers of document tables and files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import charset_label
from docloom.plans.rowwise import rowwise

#: File ending -> format of the reader that takes it.
FORMATS = {".html": "html", ".htm": "html", ".xhtml": "html", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".docx": "docx", ".eml": "eml", ".pages": "pages", ".numbers": "numbers", ".key": "keynote", ".png": "image", ".jpg": "image", ".jpeg": "image"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_in_order(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table with ``place``: a number that rises from row to row of a file, and from file to file by name."""
    rows = table(spark, folder, name)
    # file:/ and file:/// are one
    names, columns = sorted(re.sub(r"^([^:/]+):/+", r"\1:/", n) for n in rows.inputFiles()), rows.columns
    rows = rows.select("*", F.regexp_replace(F.col("_metadata.file_path"), r"^([^:/]+):/+", "$1:/").alias("_file"), F.col("_metadata.row_index").alias("place"))
    if len(names) > 1:
        ranks = spark.createDataFrame([(n, i << 40) for i, n in enumerate(names)], "_file string, _from long")
        rows = rows.join(F.broadcast(ranks), "_file", "left").withColumn("place", F.coalesce("_from", F.lit(0)) + F.col("place"))
    return rows.select(*columns, "place")


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, format, content) of binary files; ``pattern`` prunes by file name before anything is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    ending = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return reader.load(path).select("path", kind[ending].alias("format"), "content")


# Charset labels beyond those of the JVM functions, and the codec of each.
CODECS = {
    "utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "ascii", "ascii": "ascii", "iso-8859-1": "latin-1", "latin1": "latin-1", "iso-8859-2": "iso8859-2",
    "windows-1250": "cp1250", "windows-1251": "cp1251", "windows-1252": "cp1252", "cp1252": "cp1252", "win-1252": "cp1252", "windows-1253": "cp1253", "windows-1254": "cp1254",
    "shift-jis": "shift_jis", "sjis": "shift_jis", "cp932": "shift_jis", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "utf-32": "utf-32",
}


def decoded(rows: DataFrame, *, key: str = "path", content: str = "content", label: str = "charset") -> DataFrame:
    """(key, text, _error): bytes under their declared charsets; UTF-8 without a label, null for labels without a codec."""

    def run(data, charset):
        codec = CODECS.get(charset) if charset else "utf-8"
        return {"text": bytes(data).decode(codec) if codec and data is not None else None}

    plain = rows.select(F.col(key), F.col(content), charset_label(label).alias("_label")).withColumnsRenamed({content: "_data"})
    return rowwise(plain, run, ["_data", "_label"], "text string", [key])


def as_text(rows: DataFrame) -> DataFrame:
    """(path, format, text, _error) of ``files``: each format through its reader, as Markdown where it has structure.

    Rows of formats without a text (images, unknown endings) have a null text.
    """
    from docloom.operators import html, markdown
    from docloom.sources import office

    none = F.lit(None).cast("string")
    of = lambda *kinds: rows.where(F.col("format").isin(*kinds))
    plain = decoded(of("text", "markdown", "html").withColumn("charset", none)).join(rows.select("path", "format"), "path")
    pages = html.render(plain.where("format = 'html'").select("path", F.col("text").alias("html")), key="path", base=None, outputs=("markdown",))
    mails = office.emails(of("eml"))
    mails = html.render(mails.select("path", "html"), key="path", base=None, outputs=("markdown",))
    parts = [
        plain.where("format <> 'html'").select("path", "text", "_error"),
        pages.select("path", F.col("markdown").alias("text"), "_error"),
        mails.select("path", F.col("markdown").alias("text"), "_error"),
        office.docx_markdown(of("docx")).select("path", "text", none.alias("_error")),
        rows.where(~F.coalesce(F.col("format").isin("text", "markdown", "html", "eml", "docx"), F.lit(False))).select("path", none.alias("text"), none.alias("_error")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return rows.select("path", "format").join(every, "path", "left")
