"""Token counts under a public tokenizer, huge texts by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in overlapping chunks with
offsets.  Two neighbours are spliced where both have a token boundary at the
same character and agree on all tokens from there on up to a guard before the
first one's end: pre-tokenisation runs from left to right, so after a common
boundary both scans are in the same state.  Without such a boundary the
overlap is doubled, in the end up to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import kind_of, text_of, written

CHUNK = 1 << 16
OVERLAP = 1 << 11
GUARD = 256
BATCH = 256
MEMO = 500_000
_loaded: dict[str, object] = {}


class _Memo:
    """Token counts of the space-separated pieces of short texts.

    A space between two characters that are no white space always begins a
    pre-token, so a text's count is the sum over its pieces, each with its
    space before it.  That holds for pre-tokenizers of the byte-level kind
    only; texts with other pieces (or other tokenizers) are encoded whole.
    """

    def __init__(self, tokenizer):
        self.tokenizer, self.counts = tokenizer, {}
        self.fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        kind = type(tokenizer.pre_tokenizer).__name__
        self.usable = kind == "ByteLevel" and tokenizer.normalizer is None and len(tokenizer.encode("a b a", add_special_tokens=False).ids) == 3

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.usable:
            return self.whole(texts)
        split = [x.split(" ") for x in texts]
        new = list(set().union(*[x[1:] for x in split]) - self.counts.keys())
        if len(self.counts) + len(new) > MEMO:
            self.counts.clear()
            new = list(set().union(*[x[1:] for x in split]))
        good = [p for p in new if p and _solid(p[0]) and _solid(p[-1])]
        self.counts.update(dict.fromkeys(new))
        for i in range(0, len(good), 4096):
            part = good[i : i + 4096]
            self.counts.update(zip(part, self.whole([" " + p for p in part]), strict=True))
        out, left = [0] * len(texts), []
        heads = self.whole([x[0] for x in split])
        for i, x in enumerate(split):
            if len(x) > 1 and not (x[0] and _solid(x[0][-1])):
                left.append(i)
                continue
            try:
                out[i] = heads[i] + sum(map(self.counts.__getitem__, x[1:]))
            except TypeError:
                left.append(i)
        for i, n in zip(left, self.whole([texts[i] for i in left]), strict=True):
            out[i] = n
        return out


def _solid(c: str) -> bool:
    """A letter, a number, or ASCII punctuation: never white space to any library."""
    return "!" <= c <= "~" or c.isalnum()


def load(path: str):
    """The tokenizer at ``path``, loaded once a worker."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def _boundaries(enc, at: int) -> dict[int, int]:
    """Character position -> index of the token that begins there, where no earlier token reaches beyond."""
    found, reach = {}, at
    for i, (a, b) in enumerate(enc.offsets):
        if a + at >= reach and a + at not in found:
            found[a + at] = i
        reach = max(reach, b + at)
    return found


def spliced_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, guard: int = GUARD) -> int:
    """Number of tokens of a text of any length, encoded chunk by chunk."""
    encode = lambda a, b: tokenizer.encode(text[a:b], add_special_tokens=False)
    at, end = 0, min(len(text), chunk)
    left, skip, total = encode(at, end), 0, 0
    while end < len(text):
        width, joined = overlap, False
        while not joined:
            back = max(at, end - width)
            until = min(len(text), end + chunk)
            right = encode(back, until)
            mine, theirs = _boundaries(left, at), _boundaries(right, back)
            safe = end - guard
            last = max((i for p, i in mine.items() if p <= safe), default=-1)
            for p in sorted(mine.keys() & theirs.keys()):
                i, j = mine[p], theirs[p]
                if i < skip or i > last or p <= back or p > safe:
                    continue
                if last > i and left.ids[i:last] == right.ids[j : j + last - i]:
                    total += i - skip
                    left, at, end, skip, joined = right, back, until, j, True
                    break
            if not joined:
                if back == at:
                    # nothing aligned in all of it: one longer chunk takes the place of both
                    end, left, joined = until, encode(at, until), True
                width *= 2
    return total + len(left.ids) - skip


def count_tokens(documents: DataFrame, tokenizer_path: str, *, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for every row; a null text is empty and has no tokens.

    ``tokenizer_path`` is a file that every worker has.  Repeated rows and
    null ids are counted like any other row; other columns are not read; an
    empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load(tokenizer_path)
        memo = _Memo(tokenizer)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, BATCH):
                texts = [x or "" for x in column.slice(start, BATCH).to_pylist()]
                counts = [0] * len(texts)
                short = [i for i, x in enumerate(texts) if 0 < len(x) <= chunk]
                for i, n in zip(short, memo.count([texts[i] for i in short]), strict=True):
                    counts[i] = n
                for i, x in enumerate(texts):
                    if len(x) > chunk:
                        counts[i] = spliced_count(tokenizer, x, chunk, overlap)
                sizes = [len(x.encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.record_batch([ids.slice(start, BATCH), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = kind_of(documents, "doc_id")
    rows = documents.select("doc_id", text_of().alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return written(rows.withColumn("over_limit", F.col("n_tokens") > limit), "tokens")
