"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a share of all words by weight, at most ``MAX_EPOCHS`` times
its own; the excess is shared anew by weight.  A source's documents are dealt
to blocks by hash; whole passes take all blocks, the last pass takes blocks in
permuted order up to the word that meets the target.  The exact number of
blocks that each source gives is split among the output shards by a tree of
multivariate-hypergeometric draws: first pools of sources, then the sources of
each pool within what the pool gives a shard, so the quotas are exact for any
number of sources.  Each shard takes its next blocks of the source's
permutation, and ``places`` orders its documents by a local shuffle.

All state besides the documents is one row a source or block (at most
``MAX_BLOCKS`` blocks a source; larger sources have larger blocks, and one
block of each is ordered to find the cut), so a hot source is many small
groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.llm.common import n_words, small, written

BLOCK_WORDS = 1 << 14
MAX_BLOCKS = 1 << 16
MAX_EPOCHS = 3
#: Sources of a pool and pools of the first tree, for up to the square of it in arrays of this length.
POOLS = 1024
SHARDS = 16
SEED = "docloom"


def _hash(*parts: Column | str) -> Column:
    """A 60-bit number from the MD5 of the parts, which other SQL engines can repeat."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _rows(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return documents.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source_key"),
        F.col("doc_id").cast("string").alias("id"),
        n_words(F.col("text").cast("string")).alias("size"),
        _hash("doc", F.col("doc_id")).alias("key"),
    )


def _targets(sources: DataFrame) -> DataFrame:
    """Water-filling over (source_key, source_size, weight): adds target, in a few passes over one row a source."""
    total, _ = sources.agg(F.sum("source_size"), F.count(F.lit(1))).first()
    capped, level = -1, 0.0
    while True:
        over = F.col("weight") * F.lit(level) > MAX_EPOCHS * F.col("source_size")
        n, fixed, weight = sources.agg(F.count_if(over), F.sum(F.when(over, MAX_EPOCHS * F.col("source_size")).otherwise(0)), F.sum(F.when(~over, F.col("weight")).otherwise(0))).first()
        if n == capped:
            break
        capped = n
        level = ((total or 0) - (fixed or 0)) / weight if weight else level
    over = F.col("weight") * F.lit(level) > MAX_EPOCHS * F.col("source_size")
    return sources.withColumn("target", F.when(over, (MAX_EPOCHS * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level)))


def _hypergeometric(whole: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """A draw of the marked among ``drawn`` of ``whole``, by inversion around the mean (12 standard deviations)."""
    N, K, n = (c.cast("double") for c in (whole, marked, drawn))
    mean = F.when(N > 0, K * n / N).otherwise(0.0)
    wide = 12 * F.sqrt(F.greatest(F.when(N > 1, mean * (1 - K / N) * (N - n) / (N - 1)).otherwise(0.0), F.lit(0.0))) + 8
    low = F.greatest(F.lit(0), drawn - (whole - marked), F.floor(mean - wide)).cast("long")
    high = F.greatest(low, F.least(marked, drawn, F.ceil(mean + wide))).cast("long")
    # p(x + 1) / p(x); logarithms of the ratios keep the far tail finite
    def step(acc: Column, x: Column) -> Column:
        x = x.cast("double")
        ratio = (K - x) * (n - x) / ((x + 1) * (N - K - n + x + 1))
        return F.struct((acc["p"] * ratio).alias("p"), (acc["sum"] + acc["p"]).alias("sum"), (acc["pick"] + F.when(acc["sum"] + acc["p"] <= acc["aim"], 1).otherwise(0)).alias("pick"), acc["aim"].alias("aim"))

    def run(aim: Column, out):
        start = F.struct(F.lit(1e-200).alias("p"), F.lit(0.0).alias("sum"), F.lit(0).alias("pick"), aim.alias("aim"))
        return F.aggregate(F.sequence(low, high), start, step, out)

    weight = run(F.lit(0.0), lambda acc: acc["sum"])
    return F.least(low + run(u * weight, lambda acc: acc["pick"]), high)


def even_rooms(counts: Column, shards: int) -> Column:
    """Blocks that each shard gets if all get alike, as an array by shard."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.floor(total * (i + 1) / shards).cast("long") - F.floor(total * i / shards).cast("long"))


def splitting_tree(counts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(pool, shard, stratum, quota) from rows (pool, counts array<long> by stratum, rooms array<long> by shard).

    Each node halves its shards; the left half gets the blocks that its shards
    have room for, drawn stratum after stratum without replacement.
    """
    tree = counts.select("pool", F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "counts", "rooms")
    depth = max(shards - 1, 0).bit_length()
    for _ in range(depth):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        node = tree.select("pool", "lo", "hi", "counts", "rooms", total.alias("total"), mid.alias("mid"))
        room = F.aggregate(F.slice("rooms", F.col("lo") + 1, F.col("mid") - F.col("lo")), F.lit(0).cast("long"), lambda a, x: a + x)

        def draw(acc: Column, item: Column) -> Column:
            u = _hash("split", F.col("pool"), F.col("lo"), F.col("hi"), item["i"]) / F.lit(float(1 << 60))
            x = _hypergeometric(acc["whole"], item["k"], acc["room"], u)
            return F.transform(F.array(x), lambda x: F.struct((acc["whole"] - item["k"]).alias("whole"), (acc["room"] - x).alias("room"), F.concat(acc["left"], F.array(x)).alias("left")))[0]

        left = F.aggregate(
            F.transform("counts", lambda k, i: F.struct(i.alias("i"), k.alias("k"))),
            F.struct(F.col("total").alias("whole"), room.alias("room"), F.expr("cast(array() as array<bigint>)").alias("left")),
            draw,
            lambda acc: acc["left"],
        )
        node = node.select("pool", "lo", "mid", "hi", "counts", "rooms", left.alias("left"))
        halves = F.array(
            F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("counts")),
            F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), F.zip_with("counts", "left", lambda k, x: k - x).alias("counts")),
        )
        single = F.array(F.struct("lo", "hi", "counts"))
        tree = node.select("pool", "rooms", F.explode(F.when(F.col("hi") - F.col("lo") > 1, halves).otherwise(single)).alias("n")).select("pool", "rooms", "n.*")
    return tree.select("pool", F.col("lo").alias("shard"), F.posexplode("counts").alias("stratum", "quota"))


def quotas(per: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(rank, ends): for each source (rank, k) the running numbers of its blocks that shards 0, 1, ... take."""
    placed = per.select((F.col("rank") % POOLS).cast("int").alias("pool"), F.floor(F.col("rank") / POOLS).cast("int").alias("stratum"), "k")
    in_order = lambda name: F.transform(F.array_sort(F.collect_list(F.struct(name, "k"))), lambda x: x["k"])
    pools = placed.groupBy("pool").agg(F.sum("k").alias("k")).agg(in_order("pool").alias("counts")).where(F.size("counts") > 0)
    top = written(splitting_tree(pools.select(F.lit(-1).alias("pool"), "counts", even_rooms(F.col("counts"), shards).alias("rooms")), shards), "pool-quotas")
    rooms = top.groupBy(F.col("stratum").alias("pool")).agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("rooms"))
    strata = placed.groupBy("pool").agg(in_order("stratum").alias("counts")).join(rooms, "pool")
    # the array of a pool is by stratum, its strata are consecutive ranks
    leaves = splitting_tree(strata, shards).select((F.col("stratum").cast("long") * POOLS + F.col("pool")).alias("rank"), "shard", "quota")
    ends = leaves.withColumn("end", F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")))
    return ends.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "end"))), lambda x: x["end"]).alias("ends"))


def ranked(by_source: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in code point order of source_key, without gathering the sources in one task."""
    ranges = written(by_source.repartitionByRange("source_key").select("*", F.spark_partition_id().alias("range")), "ranges")
    before = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("source_key")) - 1
    return ranges.withColumn("place", place).join(F.broadcast(before), "range").select(*by_source.columns, (F.col("before") + F.col("place")).alias("rank"))


def mix(documents: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), shards: int = SHARDS) -> DataFrame:
    """(row, size, source_size, target, taken, shards, places) for every row; ``row`` is a struct of the columns ``keep``.

    ``shards`` lists the output shard of each pass that takes the document
    (the last one may take only its first words), ``places`` its place in the
    local shuffle of each of them.  A null text has size 0 and
    gives no words; a null source comes last and is a source; repeated rows
    are dealt alike, and at a cut inside equal rows each gives an equal part.
    """
    rows = _rows(documents, keep)
    light = written(_rows(documents, ()).drop("row"), "sizes")
    by_source = light.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # one row a source; "=" sorts before "null", so null comes last
    sources = written(ranked(by_source).withColumn("weight", F.col("rank") % 3 + 1), "sources")
    sources = _targets(sources)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(quota / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    n_blocks = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long")
    sources = sources.select("source_key", "rank", "source_size", "target", passes.alias("passes"), (quota - passes * F.col("source_size")).alias("rest"), n_blocks.alias("n_blocks"))
    sources = small(written(sources, "targets"))

    block = (F.col("key") % F.col("n_blocks")).cast("long").alias("block")
    placed = light.join(sources.select("source_key", "n_blocks"), "source_key").select("source_key", "id", "size", "key", block)
    blocks = placed.groupBy("source_key", "block").agg(F.sum("size").alias("words")).join(sources, "source_key")
    order = Window.partitionBy("source_key").orderBy("turn", "block")
    blocks = blocks.withColumn("turn", _hash("block", F.col("source_key"), F.col("block")))
    blocks = blocks.withColumn("at", F.row_number().over(order) - 1).withColumn("cum", F.sum("words").over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_key")))
    before = F.col("cum") - F.col("words")
    blocks = blocks.withColumn("part", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - before)))
    draws = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    blocks = written(blocks.select("source_key", "block", "rank", "words", "part", "passes", "at", "n", draws.alias("draws")), "blocks")

    # the one block of a source that is taken in part: its documents in key order up to the cut
    split = small(written(blocks.where("part > 0 and part < words").select("source_key", "block", "part"), "split"))
    inside = placed.join(split, ["source_key", "block"]).groupBy("source_key", "block", "part", "key", "id", "size").agg(F.count(F.lit(1)).alias("equal"))
    along = Window.partitionBy("source_key", "block").orderBy("key", F.col("id").asc_nulls_first(), "size")
    inside = inside.withColumn("end", F.sum(F.col("size") * F.col("equal")).over(along)).withColumn("begin", F.col("end") - F.col("size") * F.col("equal"))
    cuts = inside.where("begin < part and part <= end").select("source_key", "block", F.struct("key", "id", "size").alias("cut"), F.floor((F.col("part") - F.col("begin")) / F.col("equal")).cast("long").alias("cut_words"))

    # shards: exact quotas by the tree, then consecutive draws of each source's permutation
    per = written(blocks.groupBy("source_key", "rank").agg(F.sum("draws").alias("k")), "draws")
    ends = small(written(per.join(quotas(per, shards), "rank").select("source_key", "ends"), "ends"))
    dealt = blocks.join(ends, "source_key").join(cuts, ["source_key", "block"], "left")
    place = F.transform(
        F.when(F.col("draws") > 0, F.sequence(F.lit(0).cast("long"), F.col("draws") - 1)).otherwise(F.expr("cast(array() as array<bigint>)")),
        lambda p: F.size(F.filter("ends", lambda e: e <= p * F.col("n") + F.col("at"))),
    )
    dealt = dealt.select("source_key", "block", "passes", "cut", "cut_words", (F.col("part") == F.col("words")).alias("all"), (F.col("part") > 0).alias("some"), place.alias("shards"))
    dealt = small(written(dealt, "dealt"))

    joined = rows.join(sources.select("source_key", "source_size", "target", "n_blocks"), "source_key").withColumn("block", block).join(dealt, ["source_key", "block"])
    own = F.struct("key", "id", "size")
    last = F.when(~F.col("some"), 0).when(F.col("all"), F.col("size")).when(own < F.col("cut"), F.col("size")).when(own == F.col("cut"), F.col("cut_words")).otherwise(0)
    extra = last.cast("long")
    taken = F.col("passes") * F.col("size") + extra
    mine = F.slice("shards", 1, F.when(F.col("size") > 0, F.col("passes") + F.when(extra > 0, 1).otherwise(0)).otherwise(0).cast("int"))
    joined = joined.select("row", "id", "size", "source_size", "target", taken.alias("taken"), mine.alias("shards"))
    places = F.transform("shards", lambda shard, turn: _hash("local", shard, turn, F.col("id")))
    return joined.select("row", "size", "source_size", "target", "taken", "shards", places.alias("places"))


def digest(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shards, places) for every row."""
    return mix(documents).select("row.doc_id", "size", "source_size", "target", "taken", "shards", "places")


def draws(mixed: DataFrame) -> DataFrame:
    """One row for each time a document is drawn, by shard and in the order of the shard's local shuffle.

    Takes the rows of ``mix``; the words of the last draw are what is left.
    Shards are ranges of the result, so a large one is several tasks.
    """
    pieces = mixed.select("row", "size", "taken", F.posexplode(F.arrays_zip("shards", "places")).alias("turn", "draw"))
    words = F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size"))
    pieces = pieces.select(F.col("draw.shards").alias("shard"), F.col("draw.places").alias("place"), "turn", words.alias("words"), "row")
    return pieces.repartitionByRange("shard", "place", "turn").sortWithinPartitions("shard", "place", "turn")
