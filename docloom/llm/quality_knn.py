"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Terms are words, pairs of words, word endings and repeated words (which of the
last words a word repeats), hashed to ``BUCKETS``.  Their logarithmic counts,
weighted by inverse document frequency, make the term-document matrix of a
bounded labelled sample, and its truncated SVD the latent space.  The labelled
bank (at most ``SAMPLE`` vectors of ``RANK`` floats) is broadcast; every
document is compared with all of it in blocks of exact cosine products, and
the labels of its nearest neighbours are averaged with their similarity as
weight.

Repeated document rows are scored like any others; an empty table gives no
rows; columns besides doc_id and text (and the label) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import kernels
from docloom.llm.common import fold, kind_of, text_key, text_of, written

#: Rows that are learned from: labelled ids with the smallest hashes, at most so many rows.
SAMPLE = 4000
BUCKETS = 1 << 12
RANK = 64
NEIGHBOURS = 9
BLOCK = 1024
THRESHOLD = 0.3
#: Bytes of a word's ending, and how far back a repeated word is looked for.
ENDING, BACK = 3, 3


def _terms(w: kernels.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 64-bit hash) of the terms of a slice, one kind of term after the other."""
    row = np.repeat(np.arange(w.last - w.first), np.diff(w.rows))
    yield row, w.hash
    pair = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    yield row[1:][pair], kernels.windows(w.hash, 2)[pair]
    with np.errstate(over="ignore"):
        ending = np.zeros(len(row), kernels.U64)
        for k in range(1, ENDING + 1):
            held = w.end - k >= w.start
            byte = np.where(held, w.data[np.maximum(w.end - k, 0)] if len(w.data) else 0, 0)
            ending = ending * kernels.U64(257) + byte.astype(kernels.U64)
        yield row, kernels.mix(ending ^ kernels.U64(0xE7D1))
    for k in range(1, BACK + 1):
        same = (row[k:] == row[:-k]) & (w.hash[k:] == w.hash[:-k])
        yield row[k:][same], np.full(int(same.sum()), kernels.mix(np.array([0xB0B0 + k], kernels.U64))[0])


def counts(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, row, bucket, count): the sparse term-document matrix of slices of a text column."""
    shift = kernels.U64(64 - (BUCKETS.bit_length() - 1))
    for w in kernels.words(column):
        parts = [r * BUCKETS + (kernels.mix(h) >> shift).astype(np.int64) for r, h in _terms(w)]
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        yield w.first, w.last, keys // BUCKETS, keys % BUCKETS, n


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(size > 1e-12, size, 1)).astype(np.float32)


def _project(row: np.ndarray, bucket: np.ndarray, n: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """Unit latent vectors; ``weights`` has the axes times the inverse document frequencies."""
    out = np.zeros((rows, weights.shape[1]), dtype=np.float32)
    if len(row):
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        tf = np.log1p(n).astype(np.float32)
        out[row[begin]] = np.add.reduceat(weights[bucket] * tf[:, None], begin, axis=0)
    return _unit(out)


def _axes(x: np.ndarray, rank: int) -> np.ndarray:
    """The leading right singular vectors of x, by a randomised range finder with power steps."""
    rank = min(rank, *x.shape)
    probe = x @ np.random.default_rng(17).standard_normal((x.shape[1], min(rank + 16, x.shape[0], x.shape[1]))).astype(np.float32)
    for _ in range(4):
        probe = x @ (x.T @ np.linalg.qr(probe)[0])
    _, _, v = np.linalg.svd(np.linalg.qr(probe)[0].T @ x, full_matrices=False)
    return np.ascontiguousarray(v[:rank].T)


def train(documents: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, bank of unit latent vectors, labels) from at most ``sample`` labelled rows.

    An id with several labels takes their mean; null labels, null ids and
    texts without a word are not used.
    """

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, row, bucket, n in counts(batch.column(0)):
                cuts = pa.array(np.searchsorted(row, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int32())) for x in (bucket, n)]
                yield pa.record_batch([*lists, batch.column(1).slice(i, j - i)], ["bucket", "n", "y"])

    place = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y")).orderBy(*place).limit(sample)
    rows = documents.select("doc_id", text_of().alias("text")).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(F.broadcast(picked), "doc_id")
    rows = rows.orderBy(*place, text_key()).limit(sample).select("text", "y")
    got = written(rows.mapInArrow(featurize, "bucket array<int>, n array<int>, y double"), "sample").toPandas()
    if got.empty:
        return np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0)
    row = np.repeat(np.arange(len(got)), got["bucket"].map(len))
    bucket, n, y = np.concatenate(got["bucket"].to_list()), np.concatenate(got["n"].to_list()), got["y"].to_numpy(dtype=float)
    idf = (np.log((1 + len(got)) / (1 + np.bincount(bucket, minlength=BUCKETS))) + 1).astype(np.float32)
    x = np.zeros((len(got), BUCKETS), dtype=np.float32)
    x[row, bucket] = np.log1p(n) * idf[bucket]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    axes = _axes(x, RANK)
    return (axes * idf[:, None]).astype(np.float32), _unit(x @ axes), y


def vote(latent: np.ndarray, bank: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted label mean of the ``k`` nearest bank rows; rows tied with the k-th all count."""
    out = np.empty(len(latent))
    k = min(k, len(bank))
    for i in range(0, len(latent), BLOCK):
        sim = latent[i : i + BLOCK] @ bank.T
        kth = np.partition(sim, len(bank) - k, axis=1)[:, len(bank) - k]
        weight = np.where(sim >= kth[:, None], np.maximum(sim, 1e-6), 0)
        out[i : i + BLOCK] = (weight @ y) / weight.sum(axis=1)
    return np.clip(out, 0, 1)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (doc_id, score) for every row; 0.5 where nothing was learned.

    A null text, or one without a word, has no direction and no neighbours; it
    scores 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bank, y = shared.value
        for batch in batches:
            for i, j, row, bucket, n in counts(batch.column(1)):
                s = np.full(j - i, 0.5)
                if len(bank):
                    s = vote(_project(row, bucket, n, j - i, weights), bank, y)
                    s[np.bincount(row, minlength=j - i) == 0] = 0
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(s, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind_of(documents, 'doc_id')}, score double")


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Learn where the fold of 5 is not 0 and score all: (doc_id, held_out, score, predicted)."""
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = train(documents, labels.select("doc_id", "quality").where(~held))
    scored = score(documents, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    return written(scored, "scored")
