"""Operators on tables of Markdown texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.plans.rowwise import rowwise

RUNS = "seq int, block string, level int, path string, text string, style int, link string, image string, footnote int, alert string, checked boolean"


def to_html(docs: DataFrame, *, key: str = "doc_id", text: str = "text", raw: bool = False, xhtml: bool = False) -> DataFrame:
    """(key, html, _error)."""

    def run(t):
        from docloom.parse.markdown_html import to_html as convert

        return {"html": convert(t, raw=raw, xhtml=xhtml)}

    return rowwise(docs, run, [text], "html string", [key])


def runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, RUNS, _error): one row a run."""

    def run(t):
        from docloom.parse.markdown_runs import runs as split

        return split(t)

    return rowwise(docs, run, [text], RUNS, [key], many=True)


def chapters(docs: DataFrame, *, key: str = "doc_id", text: str = "text", level: int = 1, title: str = "Untitled") -> DataFrame:
    """(key, seq, id, title, front, xhtml, _error)."""

    def run(t):
        from docloom.parse.markdown_runs import chapters as split

        return split(t, level, title)

    return rowwise(docs, run, [text], "seq int, id string, title string, front boolean, xhtml string", [key], many=True)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): the lines of a text, numbered from 0."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n", "line"))


def titles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, title): the first ATX heading outside fences, by a running parity of fence lines."""
    rows = lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = rows.withColumn("fences", F.sum(fence.cast("int")).over(order))
    found = rows.where((F.col("fences") % 2 == 0) & F.col("line").rlike(r"^\s*#{1,6}(\s|$)"))
    return found.groupBy(key).agg(F.min_by(F.trim(F.regexp_replace(F.regexp_replace("line", r"^\s*#{1,6}\s*", ""), r"\s*#*\s*$", "")), "n").alias("title"))


def footnotes(docs: DataFrame, key: str = "doc_id", text: str = "text", duplicate: str = "first") -> tuple[DataFrame, DataFrame]:
    """(definitions (key, id, body), references (key, id, pos, number, occurrence)).

    Definitions run over indented lines (gaps and islands); references count
    only if defined, numbers follow first reference.
    """
    rows = lines(docs, key, text)
    order = Window.partitionBy(key).orderBy("n")
    head = F.regexp_extract("line", r"^ {0,3}\[\^([^\s\]]+)\]:", 1)
    rows = rows.withColumn("id", F.when(head != "", head)).withColumn("inside", F.col("line").rlike(r"^(    |\t)") | (F.trim("line") == ""))
    start = F.col("id").isNotNull() | ~F.col("inside")
    rows = rows.withColumn("island", F.sum(start.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("owner", F.first("id").over(Window.partitionBy(key, "island").orderBy("n")))
    body = F.regexp_replace(F.regexp_replace("line", r"^ {0,3}\[\^[^\s\]]+\]:[ \t]?", ""), r"^(    |\t)", "")
    defs = rows.where("owner is not null").groupBy(key, "island", F.col("owner").alias("id")).agg(F.min("n").alias("at"), F.array_sort(F.collect_list(F.struct("n", body.alias("b")))).alias("parts"))
    defs = defs.select(key, "id", "at", F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["b"]), "\n"), r"\n+$", "").alias("body"))
    pick = Window.partitionBy(key, "id").orderBy(F.asc("at") if duplicate == "first" else F.desc("at"))
    defs = defs.withColumn("r", F.row_number().over(pick)).where("r = 1").drop("r", "at")
    refs = rows.where("owner is null").select(key, "n", F.posexplode(F.regexp_extract_all("line", F.lit(r"\[\^([^\s\]]+)\]"), F.lit(1))).alias("i", "id"))
    refs = refs.join(defs.select(key, "id"), [key, "id"], "left_semi")
    refs = refs.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy("n", "i")))
    refs = refs.withColumn("first", F.min("pos").over(Window.partitionBy(key, "id")))
    refs = refs.withColumn("number", F.dense_rank().over(Window.partitionBy(key).orderBy("first"))).withColumn("occurrence", F.row_number().over(Window.partitionBy(key, "id").orderBy("pos")))
    return defs, refs.select(key, "id", "pos", "number", "occurrence")
