"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java and RE2 form of one separator run of the words ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table is broadcast only if its measured size in memory stays below this.
BROADCAST_BYTES = 8 << 20
#: Rows of an Arrow batch that carries whole texts.
TEXT_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Where none is named, a local session (tests) gets a temporary folder of
    its own; a cluster session raises, as its executors could not see one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


@contextmanager
def _text_batches(spark: SparkSession) -> Iterator[None]:
    """Keeps Arrow batches small while the body runs, so that a worker's memory does not follow them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the plans made while the body runs go as soon as these have run, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs only a re-read, and gives the
    optimizer real sizes.  Files stay until ``forget`` or until the shared
    folder is cleaned; the shuffle files behind them go at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    with _text_batches(spark), _shuffles_dropped(spark):
        # a plan of its own, made under these settings
        df.select("*").write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing reads any more."""
    for table_ in tables:
        path = getattr(table_, "_docloom_path", None)
        if path:
            jvm, conf = table_.sparkSession._jvm, table_.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value in Spark's row format, at least."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 16
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            size = F.aggregate(column, F.lit(16).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType))
        else:
            size = F.size(column) * 8 + 16
    elif isinstance(kind, T.StructType):
        size = sum((_bytes_of(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    elif isinstance(kind, T.MapType):
        size = _bytes_of(F.map_keys(column), T.ArrayType(kind.keyType)) + _bytes_of(F.map_values(column), T.ArrayType(kind.valueType))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def bytes_in_memory(df: DataFrame) -> int:
    """The size of all rows of ``df`` as a broadcast would hold them, measured."""
    row = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a written table for broadcast if its measured bytes stay below ``limit``; else leave the join to the planner."""
    if bytes_in_memory(df) > limit:
        return df
    out = F.broadcast(df)
    out._docloom_path = getattr(df, "_docloom_path", None)
    return out


def fold(doc_id: str | Column, parts: int) -> Column:
    """``crc32(doc_id as text) mod parts``; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string")) % F.lit(parts)


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_of(column: str = "text") -> Column:
    return F.col(column).cast("string")


def text_key(column: str = "text") -> Column:
    """A 64-bit key of a text, to find a row again together with its id; a null text has one too."""
    return F.xxhash64(text_of(column))


def kind_of(df: DataFrame, column: str) -> str:
    return df.select(column).schema[0].dataType.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
