"""Sequential per-document functions as Arrow maps over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, StringType, _parse_datatype_string

#: Output rows that are gathered before they go to the JVM.
FLUSH = 4096
#: Input rows that are turned into Python values at once.
SLICE = 256


def values(array: pa.Array) -> list:
    """The values of an Arrow array as ``to_pylist`` gives them; arrays of structs column by column, not cell by cell."""
    kind = array.type
    if not len(array):
        # an empty array may come without offsets
        return []
    if pa.types.is_list(kind):
        cuts = array.offsets.to_pylist()
        flat = values(array.values.slice(cuts[0], cuts[-1] - cuts[0]))
        out = [flat[a - cuts[0] : b - cuts[0]] for a, b in zip(cuts, cuts[1:], strict=False)]
    elif pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        out = [dict(zip(names, row, strict=True)) for row in zip(*[values(array.field(i)) for i in range(kind.num_fields)], strict=True)]
    elif array.null_count == 0 and (pa.types.is_floating(kind) or pa.types.is_integer(kind)):
        return array.to_numpy().tolist()
    else:
        return array.to_pylist()
    if array.null_count:
        out = [x if valid else None for x, valid in zip(out, array.is_valid().to_pylist(), strict=True)]
    return out


def rowwise(df: DataFrame, function: Callable, inputs: list[str], schema: str, keep: list[str], *, many: bool = False) -> DataFrame:
    """Applies ``function`` to the values of ``inputs`` of each row, streaming.

    It returns one dict, or with ``many`` any number of them.  The result has
    the columns ``keep``, those of ``schema`` and ``_error``: a row on which
    the function fails keeps its key, with nulls and the message, and never
    fails the task.
    """
    out = _parse_datatype_string(schema)
    source = df.select(*[df[k].alias(f"k{i}") for i, k in enumerate(keep)], *[df[c].alias(f"v{i}") for i, c in enumerate(inputs)])
    full = StructType([StructField(k, df.schema[k].dataType) for k in keep] + list(out) + [StructField("_error", StringType())])
    arrow, names, n_keep = to_arrow_schema(full), [f.name for f in out], len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in full]

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, arrow.field(i).type) for i, c in enumerate(rows)], schema=arrow)
            for c in rows:
                c.clear()
            return batch

        def add(keys, found, error):
            for i, k in enumerate(keys):
                rows[i].append(k)
            for i, name in enumerate(names, n_keep):
                rows[i].append(found.get(name))
            rows[-1].append(error)

        for batch in batches:
            # some rows at a time, so that memory does not follow the batch
            slices = (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))
            for row in (row for part in slices for row in zip(*[values(c) for c in part.columns], strict=True)):
                keys = row[:n_keep]
                try:
                    got = function(*row[n_keep:])
                    for found in got if many else [got]:
                        add(keys, found, None)
                except Exception as e:  # noqa: BLE001  the row tells what is wrong with its document
                    add(keys, {}, f"{type(e).__name__}: {e}"[:500])
                if len(rows[-1]) >= FLUSH:
                    yield flush()
        if rows[-1]:
            yield flush()

    return source.mapInArrow(run, full)
