"""Substring deduplication with repeated-phrase automata.

1. Confirm: each document's word sequence is sampled by minimizers: of every
   run of ``WIDTH`` words the phrase of ``PHRASE`` words with the smallest
   hash.  Equal runs pick the same phrase, so a run that recurs in another
   document has a phrase that recurs; phrases of two documents or more are
   confirmed.
2. Compile: the corpus's confirmed phrases are dealt to shards of about
   ``SHARD_PHRASES``, all phrases that one document was the first to hold to
   the same shard, and each shard is an Aho-Corasick automaton.
3. Stream: every document that holds a confirmed phrase runs through the
   automaton of each shard that has one, with all of the shard's phrases, in
   chunks of about ``CHUNK_WORDS`` words, so that a passage of very many
   documents is many tasks.  A document without a confirmed phrase cannot
   share a run with another one and need not be streamed.
4. The runs around the located phrases are compared across documents by their
   64-bit hashes; every word of a run that also starts in a document with a
   smaller id is removed.

Exact copies of a word sequence are settled by their fingerprint before that.
Neither automata nor the tables behind them grow with the corpus: their number
does, and each document meets only the shards of its own phrases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import kernels
from docloom.llm.common import forget, kind_of, small, text_key, text_of, written

WIDTH = 50
PHRASE = 14
SHARD_PHRASES = 20_000
CHUNK_WORDS = 1_000_000
#: Runs found more often than this are joined apart from the others.
HOT = 2000
#: Bytes of the keys of texts that are broadcast to fetch them.
KEY_BYTES = 32 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_KEY = ["doc_id", "text_key"]
_BITS, _PLACE = np.array([15, 10, 5, 0]), np.array([0, 32, 64, 96])


def _lowest(g: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each run of ``size`` values."""
    low, have = g, 1
    while have < size:
        step = min(have, size - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    return low


def _fingerprint(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole word sequence."""
    if not len(h):
        return 0, 0
    return int(kernels.windows(h, len(h))[0].view(np.int64)), int(kernels.windows(kernels.mix(h ^ _TOP), len(h))[0].view(np.int64))


def codes(h: np.ndarray, phrase: int) -> np.ndarray:
    """A 20-bit code of each run of ``phrase`` - 2 words."""
    return (kernels.windows(h, phrase - 2) >> np.uint64(44)).astype(np.int64)


def phrase_keys(c: np.ndarray) -> np.ndarray:
    """Three codes each, packed."""
    return (c[:-2] << 40) | (c[1:-1] << 20) | c[2:]


def spelled(c: np.ndarray) -> str:
    """Four characters for each code, each place with 32 characters of its own: few edges a node, and no match across codes."""
    return ((c[:, None] >> _BITS & 31) + _PLACE).astype(np.uint8).tobytes().decode("ascii")


def _order(keys: np.ndarray) -> np.ndarray:
    return kernels.mix(keys.view(np.uint64))


def _phrases(h: np.ndarray, width: int, phrase: int) -> np.ndarray:
    """The sampled phrases of a word sequence, packed."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    keys = phrase_keys(codes(h, phrase))
    g = _order(keys)
    low = _lowest(g, width - phrase + 1)
    return np.unique(keys[np.isin(g, low[np.concatenate(([True], low[1:] != low[:-1]))])])


def _words_of(w: kernels.Words, r: int) -> bytes:
    a, b = w.rows[r], w.rows[r + 1]
    return w.data[w.start[a] : w.end[b - 1]].tobytes() if b > a else b""


def sequences(documents: DataFrame, *, width: int = WIDTH, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, text_key, n_words, fp_a, fp_b, whole_sha256, phrases) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in kernels.words(batch.column(2)):
                n = w.last - w.first
                prints, shas, lists = [], [], []
                for r in range(n):
                    h = w.hash[w.rows[r] : w.rows[r + 1]]
                    prints.append(_fingerprint(h))
                    shas.append(hashlib.sha256(b" ".join(_words_of(w, r).split())).hexdigest())
                    lists.append(_phrases(h, width, phrase))
                yield pa.record_batch(
                    [batch.column(0).slice(w.first, n), batch.column(1).slice(w.first, n), pa.array(np.diff(w.rows), pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                    [*_KEY, "n_words", "fp_a", "fp_b", "whole_sha256", "phrases"],
                )

    return documents.select("doc_id", text_key().alias("text_key"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind_of(documents, 'doc_id')}, text_key long, n_words long, fp_a long, fp_b long, whole_sha256 string, phrases array<long>")


def automaton(keys: np.ndarray):
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    text = spelled(np.stack((keys >> 40, keys >> 20 & 0xFFFFF, keys & 0xFFFFF), axis=1).reshape(-1))
    for i in range(0, len(text), 12):
        machine.add_word(text[i : i + 12])
    machine.make_automaton()
    return machine


def _runs(machine, h: np.ndarray, width: int, phrase: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs whose sampled phrase the automaton locates."""
    c = codes(h, phrase)
    place = (np.fromiter((end for end, _ in machine.iter(spelled(c))), dtype=np.int64) + 1) // 4 - 3
    if not len(place):
        return place, place
    g = _order(phrase_keys(c))
    # a run is around a located phrase if that is its smallest one
    low, reach = _lowest(g, width - phrase + 1), width - phrase
    known = np.zeros(len(g), dtype=bool)
    known[place] = True
    last = np.maximum.accumulate(np.where(known, np.arange(len(g)), -1))
    near = np.flatnonzero(last[reach:] >= np.arange(len(low)))
    located = np.unique(g[place])
    at = np.minimum(np.searchsorted(located, low[near]), len(located) - 1)
    starts = near[located[at] == low[near]]
    return starts, kernels.windows(h, width)[starts].view(np.int64)


def occurrences(phrases: DataFrame, texts: DataFrame, *, width: int = WIDTH, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, text_key, starts, hashes) of the runs around the phrases that the automata locate.

    ``phrases`` has (shard, chunk, phrase) and ``texts`` (shard, chunk,
    doc_id, text_key, text): a task compiles the automaton of a shard and
    streams a chunk of the documents through it.
    """
    kind = kind_of(texts, "doc_id")

    def run(held: pa.Table, docs: pa.Table) -> pa.Table:
        found = []
        if held.num_rows and docs.num_rows:
            machine = automaton(held.column("phrase").to_numpy())
            for w in kernels.words(docs.column("text")):
                for r in range(w.last - w.first):
                    h = w.hash[w.rows[r] : w.rows[r + 1]]
                    if len(h) >= width:
                        starts, hashes = _runs(machine, h, width, phrase)
                        if len(starts):
                            found.append((w.first + r, starts, hashes))
        rows = pa.array([f[0] for f in found], pa.int64())
        cuts = pa.array(np.concatenate(([0], np.cumsum([len(f[1]) for f in found], dtype=np.int64))), pa.int32())
        as_list = lambda i, t: pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([f[i] for f in found]) if found else [], t))
        return pa.table({"doc_id": docs.column("doc_id").take(rows), "text_key": docs.column("text_key").take(rows), "starts": as_list(1, pa.int32()), "hashes": as_list(2, pa.int64())})

    return phrases.groupBy("shard", "chunk").cogroup(texts.groupBy("shard", "chunk")).applyInArrow(run, f"doc_id {kind}, text_key long, starts array<int>, hashes array<long>")


def _cut(marked: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, n_removed, kept_text) of rows (doc_id, text_key, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(3)
            for w in kernels.words(batch.column(2)):
                n, removed, texts = w.last - w.first, [], []
                for r in range(n):
                    gone = kernels.covered(starts[w.first + r].values.to_numpy().astype(np.int64), width, int(w.rows[r + 1] - w.rows[r]))
                    kept = [x for x, g in zip(_words_of(w, r).split(), gone, strict=True) if not g]
                    removed.append(int(gone.sum()))
                    texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                yield pa.record_batch([batch.column(0).slice(w.first, n), batch.column(1).slice(w.first, n), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], [*_KEY, "n_removed", "kept_text"])

    return marked.select(*_KEY, "text", "starts").mapInArrow(run, f"doc_id {kind_of(marked, 'doc_id')}, text_key long, n_removed long, kept_text string")


def _texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` joined with the written table ``wanted`` (doc_id, text_key, ...); the others are left out before anything is shuffled."""
    keys = small(written(wanted.select(*_KEY).distinct(), "wanted"), KEY_BYTES)
    return texts.join(keys, _KEY, "left_semi").join(wanted, _KEY)


def _located(texts: DataFrame, own: DataFrame, width: int, phrase: int) -> DataFrame:
    """The written ``occurrences`` of all confirmed phrases; ``own`` has (doc_id, text_key, n_words, phrases)."""
    each = own.select(*_KEY, "n_words", F.explode("phrases").alias("phrase"))
    confirmed = each.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    confirmed = written(confirmed.select("phrase", F.xxhash64("a").alias("first")), "confirmed")
    shards = max(1, -(-confirmed.count() // SHARD_PHRASES))
    sharded = confirmed.select("phrase", F.pmod("first", F.lit(shards)).cast("int").alias("shard"))
    routes = written(each.join(sharded, "phrase").select(*_KEY, "n_words", "shard").distinct(), "routes")
    sizes = written(routes.groupBy("shard").agg(F.ceil(F.sum("n_words") / CHUNK_WORDS).cast("int").alias("chunks")), "shards")
    chunk = F.pmod(F.xxhash64(*_KEY), F.col("chunks")).cast("int").alias("chunk")
    dealt = written(routes.join(small(sizes), "shard").select(*_KEY, "shard", chunk), "chunks")
    phrases = sharded.join(small(sizes), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "phrase")
    streamed = _texts(texts, dealt).select("shard", "chunk", *_KEY, "text")
    runs = written(occurrences(phrases, streamed, width=width, phrase=phrase), "runs")
    forget(confirmed, routes, sizes, dealt)
    return runs


def _lost(runs: DataFrame) -> DataFrame:
    """(doc_id, text_key, starts) of the runs that also start in a document with a smaller id.

    Rows of a run are counted before they are shuffled, and runs that very
    many documents hold are joined by broadcast, not by their hash.
    """
    each = runs.select(*_KEY, F.explode(F.arrays_zip("starts", "hashes")).alias("x")).select(*_KEY, F.col("x.starts").alias("start"), F.col("x.hashes").alias("hash"))
    owners = each.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("owner < last")
    owners = written(owners.select("hash", "owner", "n"), "owners")
    hot = small(written(owners.where(F.col("n") > HOT).select("hash", "owner"), "hot-runs"))
    often = each.join(hot, "hash").where("doc_id > owner").select(*_KEY, "start")
    rest = each.join(hot.select("hash"), "hash", "left_anti").join(owners.where(F.col("n") <= HOT).select("hash", "owner"), "hash").where("doc_id > owner").select(*_KEY, "start")
    lost = written(often.unionByName(rest).groupBy(*_KEY).agg(F.collect_set("start").alias("starts")), "lost")
    forget(owners, hot)
    return lost


def dedup(documents: DataFrame, *, width: int = WIDTH, phrase: int = PHRASE) -> tuple[DataFrame, DataFrame]:
    """(all, cut): ``all`` has (doc_id, n_words, n_removed, kept_sha256) for every row.

    ``cut`` has the texts of the documents that lose some words but are no
    copies: (doc_id, text_key, n_removed, kept_text), their words joined by
    one space.  A null text has no words.  A null id is never a smaller id and
    its row loses nothing; rows of one id do not remove each other's words.
    """
    rows = written(sequences(documents, width=width, phrase=phrase), "sequences")
    long = F.col("n_words") >= width
    copies = rows.where(long).groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = small(written(copies, "copies"))
    own = rows.where(long & F.col("doc_id").isNotNull()).join(copies, ["fp_a", "fp_b"], "left").where("first is null or doc_id = first")
    texts = documents.select("doc_id", text_key().alias("text_key"), text_of().alias("text"))
    runs = _located(texts, own, width, phrase)
    lost = _lost(runs)
    cut = written(_cut(_texts(texts, lost), width), "cut")
    part = written(cut.select(*_KEY, F.col("n_removed"), F.sha2(F.col("kept_text"), 256).alias("part_sha256")).dropDuplicates(_KEY), "part")
    joined = rows.drop("phrases").join(copies, ["fp_a", "fp_b"], "left").join(small(part), _KEY, "left")
    copy = F.coalesce((F.col("doc_id") > F.col("first")) & long, F.lit(False))
    everything = joined.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("part_sha256", "whole_sha256")).alias("kept_sha256"),
    )
    forget(runs, lost)
    return everything, cut


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row."""
    return dedup(documents)[0]
