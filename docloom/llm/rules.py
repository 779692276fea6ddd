"""Quality rules with host verdicts, in DataFrame functions only.

Documents fail base rules (too few words, too much repetition) or soft rules
(symbols, duplicate lines).  Failures are added up by host
(``source``), each host's failure rate is shrunk by a beta prior fitted to all
hosts by moments, and a host whose shrunk rate is above ``HOST_RATE`` loses
all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE, small, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Soft rules, percent: symbols by words, duplicate lines by lines.
MAX_SYMBOL_PERCENT = 30
MAX_DUP_LINE_PERCENT = 50
#: A host above this shrunk failure rate is rejected.
HOST_RATE = 0.5


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words that lie in windows of five found twice or more; windows are compared by their hash."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def spread(keys: Column) -> Column:
        order = F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(order: Column) -> Column:
            twice = F.filter(order, lambda x, j: (F.get(order, j - 1)["h"] == x["h"]) | (F.get(order, j + 1)["h"] == x["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(
                at,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(acc["reach"], i)).alias("n"), (i + WINDOW).alias("reach")),
                lambda acc: acc["n"],
            )

        return _let(_let(order, starts), total)

    some = _let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(spread(k)))
    return F.when(n < WINDOW + 1, 0).otherwise(some)


def base(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """(row, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) for every row.

    ``row`` is a struct of the columns ``keep``, so that other columns may have
    any names; a null text has no words and fails; repeated rows count each;
    an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACE, "")) > 0)
    df = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.col("source").cast("string").alias("host"),
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words"))).alias("w"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("l"),
    )
    df = df.select("row", "host", "w.n_words", "w.word_chars", "n_symbols", F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    return df.withColumn("base_failed", failed).withColumn("rule_failed", failed | soft)


def hosts(rows: DataFrame, max_rate: float = HOST_RATE) -> DataFrame:
    """(host, n_docs, n_failed, rate, host_kept): rates shrunk by the empirical beta prior.

    The prior's mean is the rate of all documents and its strength comes from
    the spread of the hosts' rates beyond that of a binomial; hosts without
    such a spread share one rate.  A null host is a host.
    """
    by = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("k"))
    total, k, n_hosts, squares, sizes = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum("k"), F.lit(0)),
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")), F.lit(0.0)),
        F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0)),
    ).first()
    # moments for unequal sizes: sum n (k/n - p)^2 = squares - total p^2
    p = k / total if total else 0.0
    room = total - sizes / total if total else 0.0
    spread = (squares - total * p * p - (n_hosts - 1) * p * (1 - p)) / room if room > 0 else 0.0
    strength = max(p * (1 - p) / max(spread, 1e-9) - 1, 1e-3)
    rate = (F.col("k") + F.lit(strength * p)) / (F.col("n") + F.lit(strength))
    return by.select("host", F.col("n").alias("n_docs"), F.col("k").alias("n_failed"), rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def judge(documents: DataFrame, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The rows of ``base`` with ``host_rate`` and ``kept``, for every row.

    Rules are evaluated once: rows are written with their counts, hosts and
    verdicts come from there.
    """
    rows = written(base(documents, keep), "rules")
    verdicts = small(written(hosts(rows).select(F.col("host").alias("verdict_host"), "rate", "host_kept"), "hosts"))
    joined = rows.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    return joined.select(*rows.columns, F.col("rate").alias("host_rate"), (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"))


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    return judge(documents).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def clean(documents: DataFrame) -> DataFrame:
    """The kept documents with all their columns."""
    return judge(documents, tuple(documents.columns)).where("kept").select("row.*")
