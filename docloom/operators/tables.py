"""Operators over table cells: rows (keys, row, col, value), both counted from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def used_range(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells up to the last row and column that hold a value; tables without a value drop."""
    full = F.col("value").isNotNull() & (F.col("value") != "")
    table = Window.partitionBy(*keys)
    marked = cells.withColumns({"_r": F.max(F.when(full, F.col("row"))).over(table), "_c": F.max(F.when(full, F.col("col"))).over(table)})
    return marked.where("row <= _r and col <= _c").drop("_r", "_c")


def alignments(cells: DataFrame, keys: list[str], explicit: DataFrame | None = None) -> DataFrame:
    """(keys, col, align): an explicit one, else right if the body's values are numbers and none is text, else left."""
    body = cells.where((F.col("row") > 0) & F.col("value").isNotNull() & (F.col("value") != ""))
    number = F.expr("try_cast(value as double)").isNotNull()
    got = cells.select(*keys, "col").distinct().join(body.groupBy(*keys, "col").agg(F.bool_and(number).alias("numeric")), [*keys, "col"], "left")
    got = got.withColumn("_own", F.when(F.coalesce("numeric", F.lit(False)), "right").otherwise("left")).drop("numeric")
    if explicit is None:
        return got.withColumnRenamed("_own", "align")
    return got.join(explicit, [*keys, "col"], "left").select(*keys, "col", F.coalesce("align", "_own").alias("align"))


def _rows(cells: DataFrame, keys: list[str], value, sep: str, default: str = "") -> DataFrame:
    """(keys, row, line): the values of each row over all columns of the table, gaps filled."""
    width = cells.groupBy(*keys).agg((F.max("col") + 1).alias("_n"))
    lines = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce(value, F.lit(default)).alias("v")))).alias("_m")).join(width, keys)
    at = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.element_at("_m", i.cast("int")), F.lit(default)))
    return lines.select(*keys, "row", F.array_join(at, sep).alias("line"))


def gfm(cells: DataFrame, keys: list[str], explicit: DataFrame | None = None) -> DataFrame:
    """(keys, markdown): row 0 is the header; bars are escaped and line breaks become spaces."""
    cells = cells.withColumn("col", F.col("col").cast("int")).withColumn("row", F.col("row").cast("int"))
    safe = F.trim(F.regexp_replace(F.replace("value", F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "))
    rows = _rows(cells, keys, safe, " | ").select(*keys, (F.col("row") * 2).alias("seq"), F.concat(F.lit("| "), "line", F.lit(" |")).alias("line"))
    rule = F.when(F.col("align") == "center", ":-:").when(F.col("align") == "right", "--:").otherwise("---")
    rules = alignments(cells, keys, explicit).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", rule.alias("r")))), lambda x: x["r"]), " | ").alias("line"))
    every = rows.unionByName(rules.select(*keys, F.lit(1).alias("seq"), F.concat(F.lit("| "), "line", F.lit(" |")).alias("line")))
    return every.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n").alias("markdown"))


def tsv(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tsv): values by tabs, rows by newlines."""
    cells = cells.withColumn("col", F.col("col").cast("int"))
    rows = _rows(cells, keys, F.regexp_replace("value", r"[\t\r\n]+", " "), "\t")
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("tsv"))


def grid_cells(values: DataFrame, keys: list[str], columns: str = "n_cols") -> DataFrame:
    """Cells of row-major value lists: rows (keys, n_cols, values array<string>)."""
    at = values.select(*keys, columns, F.posexplode("values").alias("i", "value"))
    return at.select(*keys, F.floor(F.col("i") / F.col(columns)).cast("int").alias("row"), (F.col("i") % F.col(columns)).cast("int").alias("col"), "value")


def tile_rows(tiles: DataFrame, tile_size: int = 256) -> DataFrame:
    """Adds the absolute ``row`` of rows placed by tile."""
    return tiles.withColumn("row", F.col("tile_id") * F.lit(tile_size) + F.col("local_row"))


def sheets_markdown(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, markdown) of rows (doc, sheet_seq, sheet, table_seq, markdown): sheet headings only with several sheets."""
    many = F.size(F.collect_set("sheet_seq").over(Window.partitionBy(doc))) > 1
    first = F.row_number().over(Window.partitionBy(doc, "sheet_seq").orderBy("table_seq")) == 1
    rows = tables.withColumn("_v", F.concat(F.when(many & first, F.concat(F.lit("## "), "sheet", F.lit("\n\n"))).otherwise(""), "markdown"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_seq", "table_seq", "_v"))), lambda x: x["_v"]), "\n\n").alias("markdown"))


def as_json(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): a table as {"rows": [[..], ..]}, gaps as empty strings."""
    cells = cells.withColumn("col", F.col("col").cast("int"))
    width = cells.groupBy(*keys).agg((F.max("col") + 1).alias("_n"))
    lines = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce("value", F.lit("")).alias("v")))).alias("_m")).join(width, keys)
    lines = lines.select(*keys, "row", F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.element_at("_m", i.cast("int")), F.lit(""))).alias("r"))
    return lines.groupBy(*keys).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("row", "r"))), lambda x: x["r"]).alias("rows"))).alias("json"))


def as_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): the first row as header cells."""
    from docloom.functions.text import escape_text

    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    cells = cells.withColumn("col", F.col("col").cast("int")).withColumn("_h", F.concat(F.lit("<"), tag, F.lit(">"), escape_text(F.coalesce("value", F.lit(""))), F.lit("</"), tag, F.lit(">")))
    lines = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "_h"))), lambda x: x["_h"]), "").alias("_l"))
    return lines.groupBy(*keys).agg(F.concat(F.lit("<table><tr>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_l"))), lambda x: x["_l"]), "</tr><tr>"), F.lit("</tr></table>")).alias("html"))
