"""The same operators on streams: every one of them is stateless by document, sessions excepted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Applies an operator to all that is there and writes Parquet; a restart goes on from the checkpoint."""
    operator(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_texts(stream: DataFrame, at: str, delay: str, text: str = "text") -> DataFrame:
    """Documents without repeats of a text within the watermark."""
    return stream.withColumn("_key", F.sha2(F.col(text), 256)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def settled(stream: DataFrame, keys: list[str], at: str, gap: str, delay: str) -> DataFrame:
    """(keys, begin, end, n_events): a burst is given out once no event came for ``gap`` and the watermark has passed it."""
    window = F.session_window(F.col(at), gap)
    return stream.withWatermark(at, delay).groupBy(*keys, window.alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max(at).alias("end")).select(*keys, F.col("w.start").alias("begin"), "end", "n_events")
