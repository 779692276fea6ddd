"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered from every labelled row in one pass.  The log-probability
matrix is broadcast in blocks of ``LANGS`` languages (``LANGS`` x ``BUCKETS``
values), so its size does not follow the number of labels.  Each Arrow batch
becomes sparse count matrices (rows by buckets) that are multiplied with the
block at once.  Texts are scored whole; a very long one is counted piece by
piece, each n-gram in the piece that it ends in.

Repeated rows count and are scored like any others; an empty table gives no
rows; columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import kernels
from docloom.llm.common import fold, kind_of, written

BUCKETS = 1 << 13
#: Languages of one broadcast block, and of the counts that a task holds at once.
LANGS = 256
#: Characters of a text that are counted at once.
CHUNK = 1 << 20
_SPACE = 32


class _Letters:
    """Lookup from code point to its case-folded letter, or to a space."""

    _map = None

    @classmethod
    def map(cls) -> np.ndarray:
        if cls._map is None:
            m = np.full(0x110000, _SPACE, dtype=np.uint32)
            for c in range(0x30000):
                ch = chr(c)
                if ch.isalpha():
                    low = ch.lower()
                    m[c] = ord(low) if len(low) == 1 else c
            m[0x30000:] = np.arange(0x30000, 0x110000)
            m[0xE0000:] = _SPACE
            cls._map = m
        return cls._map


def _grams(codes: np.ndarray, row: np.ndarray, buckets: int, lead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each 1- to 3-gram that lies in one row; ``lead`` marks codes that only begin n-grams."""
    shift = np.uint32(33 - buckets.bit_length())
    rows, hashes = [], []
    with np.errstate(over="ignore"):
        one = (codes + np.uint32(1)) * np.uint32(0x9E3779B1)
        gram = one
        for width, (x, m) in enumerate(((0, 0), (0x5BD1E995, 0x85EBCA77), (0x27D4EB2F, 0xC2B2AE3D)), 1):
            if width > 1:
                gram = (gram[:-1] ^ np.uint32(x)) * np.uint32(m) + one[width - 1 :]
            end = row[width - 1 :]
            ok = row[: len(end)] == end
            if lead is not None:
                ok &= ~lead[width - 1 :]
            h = gram[ok]
            h = h ^ (h >> np.uint32(15))
            hashes.append((h * np.uint32(0x2C1B3C6D)) >> shift)
            rows.append(end[ok])
    return np.concatenate(rows), np.concatenate(hashes)


def _long_counts(text: str, buckets: int) -> np.ndarray:
    """Counts of one text, piece by piece; what ends in a piece is counted there."""
    letters, total = _Letters.map(), np.zeros(buckets, dtype=np.int64)
    carry = np.array([_SPACE], dtype=np.uint32)
    first = True
    for at in range(0, len(text) + 1, CHUNK):
        part = letters[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at + CHUNK > len(text):
            part = np.append(part, np.uint32(_SPACE))
        c = np.concatenate((carry, part))
        blank = c == _SPACE
        keep = np.concatenate(([True], ~(blank[1:] & blank[:-1])))
        keep[: len(carry)] = True
        lead = np.zeros(len(c), dtype=bool)
        lead[: 0 if first else len(carry)] = True
        c, lead = c[keep], lead[keep]
        total += np.bincount(_grams(c, np.zeros(len(c), np.int64), buckets, lead)[1], minlength=buckets)
        carry, first = c[-2:], False
    return total


def _short_counts(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count, has a letter by row) of texts, in order of row and bucket."""
    sizes = np.array([len(t) + 2 for t in texts], dtype=np.int64)
    joined = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes, row = _Letters.map()[joined], np.repeat(np.arange(len(texts)), sizes)
    blank = codes == _SPACE
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (row[1:] != row[:-1])
    lettered = np.bincount(row[~blank], minlength=len(texts)) > 0
    rows, hashes = _grams(codes[keep], row[keep], buckets)
    keys, counts = np.unique(rows * buckets + hashes, return_counts=True)
    return keys // buckets, keys % buckets, counts, lettered


def sparse_counts(column: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row, bucket, count, has a letter by row): sparse count matrices of slices of a text column."""
    _, offsets = kernels.utf8(column)
    for i, j in kernels.slices(offsets):
        texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
        if len(texts) == 1 and len(texts[0]) > CHUNK:
            total = _long_counts(texts[0], buckets)
            at = np.flatnonzero(total)
            yield i, j, np.zeros(len(at), np.int64), at, total[at], np.array([has_letter(texts[0])])
        else:
            yield i, j, *_short_counts(texts, buckets)


def has_letter(text: str) -> bool:
    letters = _Letters.map()
    return any((letters[np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)] != _SPACE).any() for a in range(0, len(text), CHUNK))


def train(rows: DataFrame, *, text: str = "text", label: str = "lang", buckets: int = BUCKETS) -> DataFrame:
    """(lang, docs, counts): documents and n-gram counts of every label, from all rows with a label and a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in sums.items():
                at = np.flatnonzero(c)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])
            sums.clear()

        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, j, row, bucket, n, lettered in sparse_counts(batch.column(0), buckets):
                names, of_row = np.unique(langs[i:j].astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    mine = lettered & (of_row == k)
                    if not mine.any():
                        continue
                    if name not in sums:
                        if len(sums) >= LANGS:
                            yield from flush()
                        sums[name] = np.zeros(buckets + 1, dtype=np.int64)
                    here = mine[row]
                    sums[name] += np.bincount(bucket[here], weights=n[here], minlength=buckets + 1).astype(np.int64)
                    sums[name][buckets] += int(mine.sum())
        yield from flush()

    kept = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    counts = kept.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    model = counts.groupBy("lang").agg(F.max(F.when(F.col("bucket") == buckets, F.col("n"))).alias("docs"), F.collect_list(F.struct("bucket", "n")).alias("counts"))
    return written(model, "languages")


def _blocks(model: DataFrame, buckets: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(labels, log priors, buckets x labels log-probabilities) of blocks of at most ``LANGS`` labels in code point order."""
    total = model.agg(F.sum("docs")).first()[0]
    labels, docs, matrix = [], [], []
    for row in model.orderBy("lang").toLocalIterator():
        c = np.ones(buckets)
        for bucket, n in row["counts"]:
            if bucket < buckets:
                c[bucket] += n
        labels.append(row["lang"])
        docs.append(row["docs"])
        matrix.append(np.log(c / c.sum()))
        if len(labels) == LANGS:
            yield labels, np.log(np.array(docs) / total), np.ascontiguousarray(np.array(matrix).T)
            labels, docs, matrix = [], [], []
    if labels:
        yield labels, np.log(np.array(docs) / total), np.ascontiguousarray(np.array(matrix).T)


def _times(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """The product of a sparse count matrix with the block."""
    out = np.zeros((rows, weights.shape[1]))
    if not len(row):
        return out
    begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    step = max(1, (1 << 22) // max(1, len(row)))
    for k in range(0, weights.shape[1], step):
        out[row[begin], k : k + step] = np.add.reduceat(weights[bucket, k : k + step] * n[:, None], begin, axis=0)
    return out


def predict(rows: DataFrame, model: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing
    was learned.  The score is the posterior of the predicted label; ties go
    to the first label in code point order.
    """
    kind = kind_of(rows, doc_id)
    df = rows.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("best"), F.lit(0.0).alias("mass"))
    for block in _blocks(model, buckets):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, start, weights = shared.value
            for batch in batches:
                for i, j, row, bucket, n, lettered in sparse_counts(batch.column(1), buckets):
                    log = _times(row, bucket, n, j - i, weights) + start
                    top = log.argmax(axis=1)
                    here = log[np.arange(j - i), top]
                    old = batch.column(3).slice(i, j - i).to_numpy(zero_copy_only=False)
                    before = np.where(np.isnan(old.astype(float)), -np.inf, old.astype(float))
                    best = np.maximum(before, here)
                    # the mass of all labels so far, relative to the best one
                    mass = batch.column(4).slice(i, j - i).to_numpy() * np.exp(before - best) + np.exp(log - best[:, None]).sum(axis=1)
                    was = batch.column(2).slice(i, j - i).to_pylist()
                    pred = [None if not ok else names[t] if h > b else w for ok, t, h, b, w in zip(lettered, top, here, before, was, strict=True)]
                    none = pa.array(~lettered)
                    yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(pred, pa.string()), pa.array(best, pa.float64(), mask=none.to_numpy(zero_copy_only=False)), pa.array(mass, pa.float64())], ["doc_id", "text", "lang_pred", "best", "mass"])

        df = df.mapInArrow(score, f"doc_id {kind}, text string, lang_pred string, best double, mass double")
    return df.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), F.lit(0.0)).otherwise(1 / F.col("mass")).alias("score"))


def identify(documents: DataFrame) -> DataFrame:
    """Learn on documents whose fold of 4 is not 2 and predict all: (doc_id, held_out, lang_pred, score).

    Rows with a null id or null lang never train; a null id is not held out.
    """
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(documents.where(~held & F.col("doc_id").isNotNull()))
    return written(predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score"), "predicted")
