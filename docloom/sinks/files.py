"""Files from Markdown columns: the bytes are a column, writing them is one file a row from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.plans.rowwise import rowwise


def to_epub(docs: DataFrame, *, key: str = "doc_id", text: str = "text", title: str = "Untitled", level: int = 1) -> DataFrame:
    """(key, content, _error)."""

    def run(t):
        from docloom.parse.office import to_epub as build

        return {"content": build(t, title, level)}

    return rowwise(docs, run, [text], "content binary", [key])


def to_docx(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, _error)."""

    def run(t):
        from docloom.parse.office import to_docx as build

        return {"content": build(t)}

    return rowwise(docs, run, [text], "content binary", [key])


def to_plain(docs: DataFrame, kind: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content): documents as text, Markdown or JSON files; a text file has no Markdown marks, a JSON file is one object."""
    from docloom.functions.text import strip_markdown

    forms = {"text": lambda c: strip_markdown(c), "markdown": lambda c: c, "json": lambda c: F.to_json(F.struct(F.col(key).alias("id"), c.alias("text")))}
    return docs.select(key, F.encode(F.coalesce(forms[kind](F.col(text)), F.lit("")), "UTF-8").alias("content"))


def save(rows: DataFrame, folder: str, ending: str, *, key: str = "doc_id") -> DataFrame:
    """Write one file a row under ``folder`` from the executors, through the file system that the folder names; (key, path, size).

    A file is written under a name of its own and then moved, so that a task
    that runs twice leaves one whole file.
    """
    import pyarrow as pa

    def run(batches):
        import uuid

        import pyarrow.fs as fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/{k}{ending}"
                part = f"{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, name)
                names.append(f"{folder}/{k}{ending}")
                sizes.append(len(content or b""))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["key", "path", "size"])

    kind = rows.select(key).schema[0].dataType.simpleString()
    done = rows.where(F.col(key).isNotNull()).select(key, "content").mapInArrow(run, f"key {kind}, path string, size long")
    return done.withColumnRenamed("key", key)
