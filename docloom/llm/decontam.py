"""Benchmark decontamination by a distributed positional inverted index.

1. The benchmark's windows become a table of term lists; terms are 64-bit
   hashes of words.
2. One pass over the documents counts how often each test term occurs in the
   corpus; a window with an absent term is done.
3. A second pass builds the index: for the ``KEYS`` rarest terms of each
   window (by the counts of the whole corpus) the positions of all their
   occurrences, stored as postings (term, document, positions) by ranges of
   terms and documents, so that a frequent term is several parts.
4. The postings of a window's rarest term, less its offset, are its candidate
   starts; they are intersected with the offset-adjusted postings of the next
   rare terms of the same document, with ``slop`` words of tolerance.
5. What is left is compared with the whole text, all terms of the window: an
   exact phrase match, or a proximity match if every term stands within
   ``slop`` words of its place.

Work follows the documents and the postings of rare terms, not documents
times benchmark, and neither side is collected.  Only the sorted hashes of
test terms are broadcast, up to ``TERMS`` of them; a larger vocabulary is
joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import kernels
from docloom.llm.common import forget, kind_of, small, text_key, text_of, written

WIDTH = 10
#: Words that a term may stand from its place in a proximity match.
SLOP = 1
KEYS = 2
#: Most terms that are broadcast (8 bytes each), and bytes of keys of documents with candidates.
TERMS = 2_000_000
KEY_BYTES = 32 << 20
COUNT_CHUNK = 2_000_000
_KEY = ["doc_id", "text_key"]


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, item_id, terms) of every window of every item; null ids and texts without a word have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in kernels.words(batch.column(1), kernels.ALNUM_WORD, lower=True):
                for r in range(w.last - w.first):
                    h = w.hash[w.rows[r] : w.rows[r + 1]]
                    if not len(h):
                        continue
                    size = min(width, len(h))
                    ids, first = np.unique(kernels.windows(h, size), return_index=True)
                    lists = np.lib.stride_tricks.sliding_window_view(h, size)[first]
                    cuts = pa.array(np.arange(len(ids) + 1) * size, pa.int32())
                    terms = pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(lists).reshape(-1).view(np.int64)))
                    yield pa.record_batch([pa.array(ids.view(np.int64)), batch.column(0).slice(w.first + r, 1).take(pa.array(np.zeros(len(ids), np.int64))), terms], ["window", "item_id", "terms"])

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), text_of().alias("text"))
    return items.mapInArrow(run, "window long, item_id string, terms array<long>")


def _shared(terms: DataFrame):
    """The sorted terms of a written one-column table as a broadcast, or None if there are too many."""
    if terms.count() > TERMS:
        return None
    values = terms.toPandas().iloc[:, 0].to_numpy(dtype=np.int64).view(np.uint64)
    return terms.sparkSession.sparkContext.broadcast(np.sort(values))


def _among(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(h), dtype=bool)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return vocabulary[at] == h


def rarity(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of ``terms`` (term) occurs in all documents; absent ones have no row."""
    shared = _shared(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value if shared is not None else None
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(t.view(np.int64)), pa.array(n)], ["term", "n"])

        for batch in batches:
            for w in kernels.words(batch.column(0), kernels.ALNUM_WORD, lower=True):
                held.append(w.hash if vocabulary is None else w.hash[_among(w.hash, vocabulary)])
                size += len(held[-1])
                if size > COUNT_CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    counts = documents.select(text_of().alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return counts if shared is not None else counts.join(terms, "term", "left_semi")


def index(documents: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, postings), both stored: (doc_id, text_key, n_words) of every row, and (term, doc_id, text_key, positions) of ``terms``.

    Equal rows have equal postings, which are stored once.
    """
    shared = _shared(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value if shared is not None else None
        for batch in batches:
            for w in kernels.words(batch.column(2), kernels.ALNUM_WORD, lower=True):
                n = w.last - w.first
                at = np.arange(len(w.hash)) if vocabulary is None else np.flatnonzero(_among(w.hash, vocabulary))
                row = np.searchsorted(w.rows, at, side="right") - 1
                term = w.hash[at]
                order = np.lexsort((at, term, row))
                at, row, term = at[order], row[order], term[order]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
                begin = np.flatnonzero(new)
                inner = pa.array(np.append(begin, len(at)), pa.int32())
                outer = pa.array(np.searchsorted(row[begin], np.arange(n + 1)), pa.int32())
                places = pa.ListArray.from_arrays(inner, pa.array(at - w.rows[row], pa.int32()))
                held = pa.StructArray.from_arrays([pa.array(term[begin].view(np.int64)), places], ["term", "positions"])
                yield pa.record_batch([batch.column(0).slice(w.first, n), batch.column(1).slice(w.first, n), pa.array(np.diff(w.rows), pa.int64()), pa.ListArray.from_arrays(outer, held)], [*_KEY, "n_words", "held"])

    kind = kind_of(documents, "doc_id")
    rows = documents.select("doc_id", text_key().alias("text_key"), text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, held array<struct<term:long,positions:array<int>>>")
    docs = written(rows, "indexed")
    each = docs.select(*_KEY, F.explode("held").alias("h")).select("h.term", *_KEY, "h.positions")
    twice = written(docs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_KEY), "repeated")
    if not twice.isEmpty():
        a, b = each.alias("a"), small(twice).alias("b")
        each = a.join(b, _same_row("a", "b"), "left_anti").unionByName(a.join(b, _same_row("a", "b"), "left_semi").dropDuplicates(["term", *_KEY]))
    postings = each if shared is not None else each.join(terms, "term", "left_semi")
    return docs.select(*_KEY, "n_words"), written(postings.repartitionByRange("term", "text_key").sortWithinPartitions("term"), "postings")


def _same_row(kind_a: str, kind_b: str):
    return F.col(f"{kind_a}.doc_id").eqNullSafe(F.col(f"{kind_b}.doc_id")) & (F.col(f"{kind_a}.text_key") == F.col(f"{kind_b}.text_key"))


def _candidates(keys: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """(window, doc_id, text_key, starts): offset-adjusted postings intersected from the rarest term on.

    ``keys`` has (window, keys array<struct<at, term>>), rarest first.
    """
    columns = ["window", *_KEY, "starts", "rest"]
    first = keys.select("window", F.slice("keys", 2, KEYS).alias("rest"), F.col("keys")[0]["at"].alias("at"), F.col("keys")[0]["term"].alias("term"))
    found = first.join(postings, "term").withColumn("starts", F.transform("positions", lambda p: p - F.col("at"))).select(*columns)
    for _ in range(1, KEYS):
        asked = found.where(F.size("rest") > 0).select("window", *_KEY, "starts", F.col("rest")[0]["term"].alias("term"), F.col("rest")[0]["at"].alias("at"), F.slice("rest", 2, KEYS).alias("rest")).alias("a")
        other = asked.join(postings.alias("b"), (F.col("a.term") == F.col("b.term")) & _same_row("a", "b"))
        allowed = F.flatten(F.transform(F.sequence(F.lit(-slop), F.lit(slop)), lambda d: F.transform("b.positions", lambda p: p - F.col("a.at") + d)))
        left = other.select("window", F.col("a.doc_id").alias("doc_id"), F.col("a.text_key").alias("text_key"), F.array_intersect("starts", allowed).alias("starts"), "rest")
        found = found.where(F.size("rest") == 0).unionByName(left.where(F.size("starts") > 0))
    return found.select("window", *_KEY, "starts")


def _confirmed(documents: DataFrame, candidates: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
    """(doc_id, text_key, window, start, end, exact) of the candidates that the whole text holds, all terms of the window."""
    candidates = written(candidates, "candidates")
    wanted = small(written(candidates.select(*_KEY).distinct(), "candidate-rows"), KEY_BYTES).alias("b")
    texts = documents.select("doc_id", text_key().alias("text_key"), text_of().alias("text")).alias("a").join(wanted, _same_row("a", "b"), "left_semi").alias("a")
    asked = candidates.join(small(lists), "window").groupBy(*_KEY).agg(F.collect_list(F.struct("window", "starts", "terms")).alias("asked")).alias("b")
    rows = texts.join(asked, _same_row("a", "b")).select("a.doc_id", "a.text_key", "a.text", "b.asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in kernels.words(batch.column(2), kernels.ALNUM_WORD, lower=True):
                asked = batch.column(3).slice(w.first, w.last - w.first)
                row, window, start, end, exact = _places(w, asked, slop)
                take = pa.array(w.first + row)
                yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(window), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(exact)], [*_KEY, "window", "start", "end", "exact"])

    return rows.mapInArrow(run, f"doc_id {kind_of(documents, 'doc_id')}, text_key long, window long, start int, end int, exact boolean")


def _places(w: kernels.Words, asked: pa.ListArray, slop: int) -> tuple[np.ndarray, ...]:
    """(row, window, start, end, exact) of the asked starts around which all terms stand; proximity matches reach ``slop`` further."""
    one = asked.flatten()
    starts, terms = one.field("starts"), one.field("terms")
    n_starts, sizes = (x.value_lengths().to_numpy().astype(np.int64) for x in (starts, terms))
    flat = terms.flatten().to_numpy().view(np.uint64)
    first = np.cumsum(sizes) - sizes
    which = np.repeat(np.arange(len(one)), n_starts)
    row = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())[which]
    at = starts.flatten().to_numpy().astype(np.int64)
    begin, limit = w.rows[row], w.rows[row + 1]
    exact, near = np.ones(len(at), dtype=bool), np.ones(len(at), dtype=bool)
    for o in range(int(sizes.max(initial=0))):
        has = sizes[which] > o
        term = flat[np.minimum(first[which] + o, max(0, len(flat) - 1))]
        seen = ~has
        for d in range(-slop, slop + 1):
            place = begin + at + o + d
            here = (place >= begin) & (place < limit)
            here &= w.hash[np.where(here, place, 0)] == term
            seen |= here
            if d == 0:
                exact &= here | ~has
        near &= seen
    hit = np.flatnonzero(near)
    reach = np.where(exact, 0, slop)[hit]
    start = np.maximum(at[hit] - reach, 0)
    end = np.minimum(at[hit] + sizes[which[hit]] + reach, (limit - begin)[hit])
    return row[hit], one.field("window").to_numpy()[which[hit]], start, end, exact[hit]


def find_matches(documents: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, slop: int = SLOP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, matches, items).

    ``docs`` has (doc_id, text_key, n_words) of every row; ``matches`` (doc_id,
    text_key, window, start, end, exact), word positions with the end
    exclusive, once for equal rows; ``items`` (window, item_id).  A null text
    has no words; an empty benchmark gives no matches; a null id is an id.
    """
    all_windows = written(windows(benchmark, width), "windows")
    lists = written(all_windows.select("window", "terms").dropDuplicates(["window"]), "window-terms")
    each = lists.select("window", F.posexplode("terms").alias("at", "term"))
    terms = written(each.select("term").distinct(), "terms")
    counts = written(rarity(documents, terms), "rarity")
    ranked = each.join(small(counts), "term").groupBy("window").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("keys"))
    ranked = ranked.join(lists.select("window", F.size("terms").alias("size")), "window").where(F.size("keys") == F.col("size"))
    keys = written(ranked.select("window", F.transform(F.slice("keys", 1, KEYS), lambda k: F.struct(k["at"].alias("at"), k["term"].alias("term"))).alias("keys")), "keys")
    wanted = written(keys.select(F.explode("keys.term").alias("term")).distinct(), "key-terms")
    docs, postings = index(documents, wanted)
    candidates = _candidates(small(keys), postings, slop)
    matches = written(_confirmed(documents, candidates, lists, slop).distinct(), "matches")
    forget(terms, counts, keys, wanted, postings, lists)
    return docs, matches, all_windows.select("window", "item_id").distinct()


def _found(matches: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_hit, exact_items, near_items) of the documents with matches."""
    spans = F.array_sort(F.collect_set(F.when(F.col("exact"), F.struct("start", "end"))))
    # spans are in order of their start, so each adds the words beyond the furthest end so far
    hit = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
        lambda acc, m: F.struct((acc["n"] + F.greatest(m["end"] - F.greatest(acc["reach"], m["start"]), F.lit(0))).alias("n"), F.greatest(acc["reach"], m["end"]).alias("reach")),
        lambda acc: acc["n"].cast("long"),
    )
    words = matches.groupBy(*_KEY).agg(spans.alias("spans")).select(*_KEY, hit.alias("n_hit")).alias("a")
    named = matches.select(*_KEY, "window", "exact").distinct().join(small(written(items, "items")), "window")
    by_item = named.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("exact_items"), F.size(F.collect_set("item_id")).cast("long").alias("near_items")).alias("b")
    return words.join(by_item, _same_row("a", "b")).select("a.doc_id", "a.text_key", "n_hit", "exact_items", "near_items")


def hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) for every row.

    The first six are of exact matches; ``n_near_items`` counts the items with
    an exact or a proximity match.
    """
    docs, matches, items = find_matches(documents, benchmark)
    found = small(written(_found(matches, items), "found")).alias("b")
    rows = docs.alias("a").join(found, _same_row("a", "b"), "left")
    none = F.expr("cast(array() as array<string>)")
    return rows.select(
        "a.doc_id",
        "a.n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("exact_items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("exact_items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("near_items", F.lit(0)).cast("long").alias("n_near_items"),
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    _, matches, _ = find_matches(documents, benchmark)
    gone = small(written(matches.where("exact").select(*_KEY).distinct(), "contaminated")).alias("b")
    keyed = documents.withColumn("_docloom_key", text_key()).alias("a")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("_docloom_key") == F.col("b.text_key"))
    return keyed.join(gone, same, "left_anti").drop("_docloom_key")
