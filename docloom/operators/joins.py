"""As-of, interval, recursive and graph joins that documents' internal tables need."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.sources.folders import shared_folder


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, *, since: str | None = None) -> DataFrame:
    """Adds ``value`` of the last right row at or before each left row.

    A union and one running window by the keys: no inequality join, each side
    is shuffled once.  Right rows at the same place as a left row count.
    """
    order = Window.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.lit(None).cast(right.schema[at].dataType).alias("_since"), F.struct(*left.columns).alias("_row"))
    b = right.select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.col(at).alias("_since"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_value").alias("v"), F.col("_since").alias("s"))), ignorenulls=True).over(order)
    rows = a.unionByName(b).withColumn("_last", last).where("_side = 1")
    out = [F.col("_last.v").alias(value)] + ([F.col("_last.s").alias(since)] if since else [])
    return rows.select("_row.*", *out)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, *, found: str | None = None) -> DataFrame:
    """Adds ``value`` and ``distance`` (``found``: also the place) of the right row nearest to each left row.

    Of two as near the one before it, of several at one place the one of the
    largest value.  Right rows without a place (null, NaN) come last, and a left
    row without one gets the key's first right row; null keys meet nothing.
    A union and a running window in each direction, no inequality join.
    """
    kind, of_value = right.schema[at].dataType, right.schema[value].dataType
    known = lambda c: c.isNotNull() & ~F.isnan(c) if kind.typeName() in ("double", "float") else c.isNotNull()
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    a = left.where(whole).select(*keys, F.col(at).cast(kind).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(of_value).alias("_value"), F.struct(*left.columns).alias("_row"))
    b = right.where(whole).select(*keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    one = F.struct(F.col("_at").alias("at"), F.col("_value").alias("v"))
    other = F.when((F.col("_side") == 0) & known(F.col("_at")), one)
    by, so_far = Window.partitionBy(*keys), (Window.unboundedPreceding, 0)
    rows = a.unionByName(b)
    rows = rows.withColumn("_before", F.last(other, ignorenulls=True).over(by.orderBy("_at", "_side", "_value").rowsBetween(*so_far)))
    # from the other end, so that the frame grows and is not summed up anew for each row
    down = by.orderBy(F.desc("_at"), F.desc("_side"), "_value")
    rows = rows.withColumn("_after", F.last(other, ignorenulls=True).over(down.rowsBetween(*so_far)))
    rows = rows.withColumn("_any", F.last(F.when(F.col("_side") == 0, one), ignorenulls=True).over(by.orderBy(F.desc_nulls_first("_at"), F.desc("_side"), "_value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    back, ahead = F.col("_at") - F.col("_before.at"), F.col("_after.at") - F.col("_at")
    near = F.when(F.col("_after").isNull() | (back <= ahead), F.col("_before")).otherwise(F.col("_after"))
    near = F.coalesce(F.when(known(F.col("_at")), near), F.col("_any"))
    rows = rows.where("_side = 1").withColumn("_near", near)
    distance = F.abs(F.col("_at") - F.col("_near.at"))
    rows = rows.select("_row.*", F.col("_near.v").alias(value), distance.alias("distance"), *([F.col("_near.at").alias(found)] if found else []))
    types = {f.name: f.dataType for f in rows.schema}
    lost = left.where(~whole).select(*left.columns, *[F.lit(None).cast(types[c]).alias(c) for c in rows.columns if c not in left.columns])
    return rows.unionByName(lost)


def top_k(rows: DataFrame, keys: list[str], k: int, score: list[Column], order: list[str]) -> DataFrame:
    """The ``k`` best rows of each key by ``score``, numbered anew (``place``) in their own order."""
    best = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*score))).where(F.col("_rank") <= k).drop("_rank")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def clipped(spans: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """Half-open spans (keys, start, end, ...) cut to parts (keys, part, part_start, part_end) and counted from the part's start; the keys keep it a hash join."""
    both = spans.join(parts, keys).where("start < part_end and end > part_start")
    extra = [c for c in spans.columns if c not in (*keys, "start", "end")]
    return both.select(*keys, "part", (F.greatest("start", "part_start") - F.col("part_start")).alias("start"), (F.least("end", "part_end") - F.col("part_start")).alias("end"), *extra)


def inherited(styles: DataFrame, fields: list[str], *, doc: str = "doc_id", depth: int = 8) -> DataFrame:
    """(doc, style_id, fields): each field from the nearest ancestor that sets it, less than ``depth`` away; cycles end there.

    ``styles`` has (doc, style_id, parent_id, fields); null means unset, any other value (0 and false too) is set.
    """
    parents = styles.select(doc, F.col("style_id").alias("_up"), F.col("parent_id").alias("_next"), *[F.col(f).alias(f"_{f}") for f in fields])
    out = styles.select(doc, "style_id", F.col("parent_id").alias("_next_id"), *fields)
    for _ in range(depth - 1):
        out = out.join(parents.withColumnRenamed("_up", "_next_id"), [doc, "_next_id"], "left")
        out = out.select(doc, "style_id", F.col("_next").alias("_next_id"), *[F.coalesce(f, f"_{f}").alias(f) for f in fields])
    return out.drop("_next_id")


def reachable(edges: DataFrame, roots: DataFrame, *, doc: str = "doc_id") -> DataFrame:
    """(doc, id) of all that ``roots`` (doc, id) reach over ``edges`` (doc, src, dst), cycles included.

    A frontier loop until no id is new, however long the chains: each round
    joins only the newest ids and writes them to the shared folder, so lineage
    stays short and a lost executor costs a re-read.
    """
    spark = edges.sparkSession
    base = f"{shared_folder(spark)}/docloom/reach-{uuid.uuid4().hex}"
    roots.select(doc, "id").distinct().write.parquet(f"{base}/round=0")
    schema = roots.select(doc, "id").schema
    frontier = spark.read.schema(schema).parquet(f"{base}/round=0")
    for n in itertools.count(1):
        known = spark.read.schema(schema).parquet(*[f"{base}/round={k}" for k in range(n)])
        fresh = edges.join(frontier, (edges[doc] == frontier[doc]) & (edges["src"] == frontier["id"])).select(edges[doc], F.col("dst").alias("id")).distinct().join(known, [doc, "id"], "left_anti")
        fresh.write.parquet(f"{base}/round={n}")
        frontier = spark.read.schema(schema).parquet(f"{base}/round={n}")
        if frontier.isEmpty():
            return known


def first_wins(rows: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The first row of each key: an object store in which the first writer wins."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def best_fit(objects: DataFrame, schemas: DataFrame, *, samples: int = 4) -> DataFrame:
    """(type, message): the one message that knows every field of a type's first ``samples`` objects; none where two do.

    ``objects`` has a row (type, object, field) for each field, ``schemas``
    (message, field).  The limit by type is applied before the shuffle.
    """
    order = Window.partitionBy("type").orderBy("object")
    first = objects.select("type", "object").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= samples).drop("_r")
    fields = objects.select("type", "object", "field").join(first, ["type", "object"], "left_semi").groupBy("type", "field").agg(F.count(F.lit(1)).alias("n"))
    total = fields.groupBy("type").agg(F.sum("n").alias("total"))
    known = fields.join(schemas.select("message", "field").distinct(), "field").groupBy("type", "message").agg(F.sum("n").alias("known"))
    whole = known.join(total, "type").where("known = total").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))
    return whole.where("n = 1").select("type", "message")


def cascade(declarations: DataFrame, keys: list[str], *, place: str | None = None) -> DataFrame:
    """(keys, prop, value): the winning declaration by level, specificity (a, b, c) and order; rows (keys, prop, value, level, a, b, c, ord).

    A null counts as the largest, rows without a value do not count.  Of equal
    declarations the one with the least ``place`` (a number) wins; without it, any.
    """
    rank = [x for c in ("level", "a", "b", "c", "ord") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    rank = F.struct(*rank, *([(-F.col(place)).alias("place")] if place else []))
    return declarations.groupBy(*keys, "prop").agg(F.max_by("value", F.when(F.col("value").isNotNull(), rank)).alias("value"))


def sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: float, cap_seconds: float | None = None) -> DataFrame:
    """(keys, begin, end, n_events): bursts with pauses under ``gap_seconds``; ``cap_seconds`` cuts a long burst."""
    order = Window.partitionBy(*keys).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    pause = seconds - F.lag(seconds).over(order)
    rows = events.withColumn("_burst", F.sum(F.coalesce((pause > gap_seconds).cast("int"), F.lit(1))).over(order))
    if cap_seconds is not None:
        begun = F.min(seconds).over(Window.partitionBy(*keys, "_burst"))
        rows = rows.withColumn("_part", F.floor((seconds - begun) / cap_seconds))
    else:
        rows = rows.withColumn("_part", F.lit(0))
    return rows.groupBy(*keys, "_burst", "_part").agg(F.min(at).alias("begin"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n_events")).drop("_burst", "_part")
