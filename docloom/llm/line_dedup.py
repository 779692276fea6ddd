"""Line deduplication by site-relative frequency.

For each host (``source``) the pages that contain a line are divided by the
host's pages; lines above ``ratio``, on at least ``min_pages`` pages, are
boilerplate of that host and are dropped from its pages.  Lines are compared
by their MD5; a page counts once for a line however often it repeats it.  A
host has at most lines-per-page / ratio boilerplate lines, so they travel as
one short array a host, and page texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, small, written

RATIO = 0.03
MIN_PAGES = 5


def _host() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("host")


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")


def boilerplate(documents: DataFrame, *, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line_md5, n_pages, host_pages) of each host's boilerplate lines.

    Lines without a word never count.  ``host`` is "=" and the source, or
    "null" for a null source, which is a host like any other.
    """
    worded = F.filter(_lines(), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    keys = F.array_distinct(F.transform(worded, lambda x: F.md5(x)))
    seen = documents.select(_host(), F.explode(F.concat(keys, F.array(F.lit("")))).alias("line_md5"))
    # the empty key stands for the page itself, so one pass gives lines and totals
    counts = written(seen.groupBy("host", "line_md5").agg(F.count(F.lit(1)).alias("n_pages")).where(f"n_pages >= {int(min_pages)} or line_md5 = ''"), "lines")
    pages = counts.where("line_md5 = ''").select("host", F.col("n_pages").alias("host_pages"))
    return counts.where("line_md5 <> ''").join(pages, "host").where(F.col("n_pages") > ratio * F.col("host_pages"))


def drop_lines(documents: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(row, n_lines, n_dropped, clean_text) for every row; ``row`` is a struct of the columns ``keep``.

    A null text stays null with no lines; a text of boilerplate only becomes
    empty.  The other lines keep their order and blank lines.  Repeated rows
    are pages each; an empty table gives no rows.
    """
    lists = written(boilerplate(documents, ratio=ratio, min_pages=min_pages).groupBy("host").agg(F.collect_list("line_md5").alias("bad")), "boilerplate")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"), _host())
    rows = rows.join(small(lists), "host", "left")
    lines = _lines()
    kept = F.when(F.col("bad").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("bad", F.md5(x))))
    rows = rows.select("row", "text", kept.alias("kept"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")
    dropped = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines()) - F.size("kept")).cast("long")
    clean = F.when(F.col("text").isNotNull(), F.array_join("kept", "\n"))
    return rows.select("row", n.alias("n_lines"), dropped.alias("n_dropped"), clean.alias("clean_text"))


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): the hash is of the cleaned text, null for a null text."""
    return drop_lines(documents).select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("clean_text"), 256).alias("kept_sha256"))


def clean(documents: DataFrame) -> DataFrame:
    """All documents and columns with cleaned texts; ``n_chars`` follows the text where it exists."""
    new = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    rows = drop_lines(documents, keep=tuple(documents.columns))
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in documents.columns])
