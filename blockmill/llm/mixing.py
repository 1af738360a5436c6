"""Mixing sources to target weights: exact quotas of blocks, dealt to shards by a tree.

The words of a source, document after document in the order of a hash, are cut
into blocks of equal size, and each source has a quota of blocks that follows
from its weight. A full pass takes every block once; what is left over takes the
first blocks of a permutation. The quotas are split over the shards of the output
by a binary tree: a node holds how many blocks of each source its shards get,
and hands its left half a multivariate hypergeometric draw, so that the shards
are what cutting one great shuffle of all blocks into equal parts would give,
yet nothing of the size of the data is shuffled to find them. A shard then takes
its run of every source's permuted blocks, which no other shard has, and
shuffles its blocks by itself.

Everything is made of built-in functions. Draws invert the distribution at a
hash of the node; permutations of 0..n-1 are made of steps that each swap some
pairs (x, K - x mod n), so they need no table and no sort; both are the same in
every run and after the loss of an executor.

What grows with the corpus is split: running counts of words are taken within
stripes of a source, so one that holds a third of all rows is counted by many
tasks, and blocks are joined by (source, block). Only the list of sources is ever
in one row; weights belong to sources, so it is part of the recipe, and more
than ``MAX_SOURCES`` of them are refused.

Nulls and odd rows: a null text has no words; a null source is a source of its
own, the last; null and repeated keys are allowed, rows stay one to one. Sources
without words have the target 0. Of an empty table the result is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.llm.tables import store, text_of
from blockmill.runtime import store_counted

#: Words of a block, and how many blocks a source has at least while it has the words.
BLOCK_WORDS = 1024
SOURCE_BLOCKS = 256
#: Words of an output shard, about 100 MB of text.
SHARD_WORDS = 16 << 20
#: Rows of one stripe of running counts.
STRIPE_ROWS = 5_000
#: Sources of one mix.
MAX_SOURCES = 10_000
#: Swapping steps of a permutation.
ROUNDS = 32
#: Positions that one row stands for before they are spread over the cluster.
CHUNK = 256
#: Such rows of one task.
TASK_CHUNKS = 16
#: Nodes of the tree at which its rows are spread over the cluster.
SPREAD_NODES = 64

_WORD = r"[^\x20\x09-\x0D]++"
#: A word with the space behind it; the first one also has what stands before it.
_PIECE = r"^[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+|[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def hashed(digits: int, *parts: Column | str | int) -> Column:
    """A number below ``16 ** digits`` from the MD5 of the parts."""
    listed = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws(":", *(p.cast("string") for p in listed))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def permuted(position: Column, size: Column, *name: Column | str | int) -> Column:
    """``position`` in [0, size) moved by the permutation called ``name``."""

    def swap(x: Column, step: Column) -> Column:
        other = F.pmod(hashed(12, "key", *name, step) - x, size)
        return F.when(hashed(1, "bit", *name, step, F.greatest(x, other)) < 8, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), position, swap)


def hypergeometric(total: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``marked`` among ``total`` are in a draw of ``drawn``.

    Inverts the distribution at ``uniform`` (0 up to 1). Relative weights follow
    from each other, so no factorials are needed; nine standard deviations and
    nine more on either side hold all that a double can tell from 0.
    """
    n, m, d = (c.cast("double") for c in (total, marked, drawn))
    least = F.greatest(F.lit(0), drawn - (total - marked))
    most = F.least(drawn, marked)
    mean = d * m / F.greatest(n, F.lit(1.0))
    spread = 9 * F.sqrt(
        F.greatest(mean * (1 - m / F.greatest(n, F.lit(1.0))) * (n - d) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0))
    ) + 9
    low = F.greatest(least, F.floor(mean - spread)).cast("long")
    high = F.least(most, F.ceil(mean + spread)).cast("long")

    def follow(weight: Column, k: Column) -> Column:
        return weight * (m - k) * (d - k) / ((k + 1.0) * (n - m - d + k + 1.0))

    def add(state: Column, k: Column) -> Column:
        return F.struct(follow(state["w"], k).alias("w"), (state["sum"] + state["w"]).alias("sum"))

    def walk(state: Column, k: Column) -> Column:
        on = (state["k"] == k) & (state["left"] >= state["w"])
        return F.struct(
            F.when(on, follow(state["w"], k)).otherwise(state["w"]).alias("w"),
            F.when(on, state["left"] - state["w"]).otherwise(state["left"]).alias("left"),
            F.when(on, state["k"] + 1).otherwise(state["k"]).alias("k"),
        )

    steps = F.sequence(low, high)
    everything = F.aggregate(steps, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), add)["sum"]
    start = F.struct(F.lit(1.0).alias("w"), (uniform * everything).alias("left"), low.alias("k"))
    return F.least(F.aggregate(steps, start, walk)["k"], high)


def _split(counts: Column, slots: Column, *name: Column | str | int) -> Column:
    """The left half's blocks per source: ``slots`` of all ``counts``, source by source
    from what the sources before have left."""
    numbered = F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    everything = F.aggregate(counts, F.lit(0).cast("long"), lambda total, c: total + c)
    start = F.struct(
        everything.alias("total"), slots.alias("slots"), F.array().cast("array<bigint>").alias("left")
    )

    def take(state: Column, one: Column) -> Column:
        uniform = hashed(12, "draw", *name, one["i"]) / F.lit(float(16**12))
        k = hypergeometric(state["total"], one["c"], state["slots"], uniform)
        return F.struct(
            (state["total"] - one["c"]).alias("total"),
            (state["slots"] - k).alias("slots"),
            F.concat(state["left"], F.array(k)).alias("left"),
        )

    # One value is worked out once: a struct in an array that is taken apart again.
    return F.aggregate(numbered, start, take)["left"]


def deal(plan: DataFrame, shards: int) -> DataFrame:
    """(shard, counts, starts): per source, how many of the blocks of ``plan(counts)``
    each shard gets and the place in the source's permuted blocks where they begin.

    All shards get equally many blocks, give or take one.
    """
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c)
    nodes = plan.select(
        F.lit(0).cast("long").alias("lo"),
        F.lit(shards).cast("long").alias("hi"),
        "counts",
        F.transform("counts", lambda c: F.lit(0).cast("long")).alias("starts"),
        total.alias("all"),
    )

    def slots(shard: Column) -> Column:
        # shard * all / shards without leaving the range of a long.
        whole, rest = F.expr("`all` div %d" % shards), F.col("all") % shards
        return shard * whole + F.floor(shard * rest / F.lit(shards)).cast("long")

    # The left half is always the larger power of two, so all leaves are met in time.
    for level in reversed(range(max(shards - 1, 0).bit_length())):
        middle = F.col("lo") + (1 << level)
        cut = F.when(
            middle < F.col("hi"), _split(F.col("counts"), slots(middle) - slots(F.col("lo")), "node", F.col("lo"), F.col("hi"))
        )
        halves = nodes.withColumn("left", cut)
        parts = F.when(F.col("left").isNull(), F.array(F.struct("lo", "hi", "counts", "starts"))).otherwise(
            F.array(
                F.struct("lo", middle.alias("hi"), F.col("left").alias("counts"), "starts"),
                F.struct(
                    middle.alias("lo"),
                    "hi",
                    F.zip_with("counts", "left", lambda c, x: c - x).alias("counts"),
                    F.zip_with("starts", "left", lambda s, x: s + x).alias("starts"),
                ),
            )
        )
        nodes = halves.select(F.explode(parts).alias("node"), "all").select("node.*", "all")
        made = shards >> level
        if level and made >= SPREAD_NODES and made < 2 * SPREAD_NODES:
            nodes = store(nodes.repartition("lo"), "mix-tree")
    return nodes.select(F.col("lo").alias("shard"), "counts", "starts")


def measured(df: DataFrame, key: str, source: str, text: str, keep: Sequence[Column] = ()) -> DataFrame:
    """(key, source, size, place) per row: its words, and a hash to order rows by."""
    whole = text_of(text)
    return df.select(
        F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"),
        F.regexp_count(whole, F.lit(_WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.md5(whole))).alias("place"),
        *keep,
    )


def recipe(sources: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """One row: ``words`` of all sources and ``listed``, the sources by code point
    with their targets and blocks.

    ``sources`` has source and source_size, ``MAX_SOURCES`` rows at most. Targets
    share out all words by weight; one that exceeds ``limit`` times its source's
    words is cut to that, and the excess is shared out again until none does.
    """
    one = sources.agg(
        F.sort_array(
            F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "source_size"))
        ).alias("listed"),
        F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"),
    )
    weight = F.array(*(F.lit(float(w)) for w in weights))
    weighed = one.select(
        "words",
        F.transform(
            "listed",
            lambda s, i: F.struct(
                s["source"].alias("source"),
                s["source_size"].alias("source_size"),
                i.cast("long").alias("rank"),
                F.get(weight, i % len(weights)).alias("weight"),
                (s["source_size"] * float(limit)).alias("most"),
            ),
        ).alias("listed"),
    )

    def added(value, among):
        return F.aggregate(
            "listed", F.lit(0.0), lambda t, s: t + F.when(among(s), value(s)).otherwise(F.lit(0.0))
        )

    def raised(level: Column, _: Column) -> Column:
        over = lambda s: s["weight"] * level > s["most"]
        left = F.col("words") - added(lambda s: s["most"], over)
        return F.coalesce(F.try_divide(left, added(lambda s: s["weight"], lambda s: ~over(s))), level)

    # Each round but the last cuts one source more at least.
    level = F.aggregate(F.sequence(F.lit(0), F.size("listed")), F.lit(0.0), raised)
    levelled = weighed.select("words", "listed", level.alias("level"))
    target = lambda s: F.least(s["most"], s["weight"] * F.col("level"))

    def quota(s: Column) -> Column:
        block = F.least(F.lit(BLOCK_WORDS), F.greatest(F.lit(1), F.floor(s["source_size"] / SOURCE_BLOCKS)))
        return F.struct(
            *(s[c].alias(c) for c in ("source", "source_size", "rank")), target(s).alias("target"), block.alias("block")
        )

    def counted(s: Column) -> Column:
        # In doubles sizes are exact up to 2 ** 53 words.
        blocks = F.ceil(s["source_size"] / s["block"])
        passes = F.coalesce(F.floor(F.try_divide(s["target"], s["source_size"])), F.lit(0))
        rest = s["target"] - passes * s["source_size"]
        extra = F.least(blocks, F.floor(rest / s["block"] + 0.5))
        return F.struct(
            *(s[c].alias(c) for c in ("source", "source_size", "rank", "target", "block")),
            blocks.alias("blocks"),
            (passes * blocks + extra).alias("quota"),
        )

    return levelled.select("words", F.transform(F.transform("listed", quota), counted).alias("listed"))


class Mix:
    """The mix of one table: its recipe, its placed rows, and what the shards draw."""

    def __init__(
        self,
        df: DataFrame,
        key: str = "doc_id",
        source: str = "source",
        text: str = "text",
        weights: Sequence[int] = (1, 2, 3),
        limit: int = 3,
        keep_text: bool = False,
    ):
        light = measured(df, key, source, text, [text_of(text).alias("text")] if keep_text else [])
        self.rows, n_rows = store_counted(light, "mix-rows")
        totals = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        sources, n_sources = store_counted(totals, "mix-sources")
        if n_sources > MAX_SOURCES:
            raise ValueError(f"{n_sources} sources; weights are given to {MAX_SOURCES} at most")
        self.plan = store(recipe(sources, weights, limit), "mix-recipe")
        self.sources = self.plan.select(F.inline("listed"))
        words = self.plan.first()["words"]
        self.stripes = max(1, -(-n_rows // STRIPE_ROWS))
        self.shards = max(1, -(-words // SHARD_WORDS))
        # Told by number: rows this small would be put together into one task.
        self.draw_tasks = max(1, -(-words // (BLOCK_WORDS * CHUNK * TASK_CHUNKS)))

    def placed(self) -> DataFrame:
        """The rows with their source's recipe and ``start``, the words of the source before them."""
        stripe = F.floor(
            F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * self.stripes / F.lit(2**32)
        ).cast("long")
        known = self.rows.join(
            F.broadcast(self.sources), self.rows["source"].eqNullSafe(self.sources["source"])
        ).drop("source").withColumn("stripe", stripe)
        before = Window.partitionBy("rank").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
        begun = known.groupBy("rank", "stripe").agg(F.sum("size").alias("_n")).select(
            "rank", "stripe", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begun")
        )
        within = Window.partitionBy("rank", "stripe").orderBy("place", "key", "size").rowsBetween(
            Window.unboundedPreceding, -1
        )
        return (
            known.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(begun, ["rank", "stripe"])
            .withColumn("start", F.col("_begun") + F.col("_within"))
            .drop("stripe", "_begun", "_within")
        )

    def pieces(self, placed: DataFrame) -> DataFrame:
        """Rows with words, cut at the borders of blocks: ``number`` of the block,
        ``first`` word in the row and ``words``."""
        numbers = F.sequence(
            F.expr("start div block"), F.expr("(start + size - 1) div block")
        )
        cut = placed.where("size > 0").withColumn("number", F.explode(numbers))
        low = F.greatest(F.col("start"), F.col("number") * F.col("block"))
        high = F.least(F.col("start") + F.col("size"), (F.col("number") + 1) * F.col("block"))
        return cut.withColumns({"first": low - F.col("start"), "words": high - low})

    def draws(self) -> DataFrame:
        """(shard, rank, number, place): the blocks of every shard in its order."""
        dealt = deal(self.plan.select(F.transform("listed", lambda s: s["quota"]).alias("counts")), self.shards)
        runs = dealt.select(
            "shard",
            F.posexplode(F.arrays_zip("counts", "starts")).alias("rank", "run"),
        ).where("run.counts > 0")
        last = F.col("run.starts") + F.col("run.counts") - 1
        chunks = runs.select(
            "shard",
            F.col("rank").cast("long").alias("rank"),
            last.alias("last"),
            F.explode(F.sequence(F.col("run.starts"), last, F.lit(CHUNK).cast("long"))).alias("from"),
        ).repartition(self.draw_tasks, "shard", "rank", "from")
        taken = chunks.select(
            "shard",
            "rank",
            F.explode(F.sequence("from", F.least(F.col("last"), F.col("from") + (CHUNK - 1)))).alias("j"),
        ).join(F.broadcast(self.sources.select("rank", "blocks")), "rank")
        turn = F.expr("j div blocks")
        return taken.select(
            "shard",
            "rank",
            permuted(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("rank"), turn).alias("number"),
            hashed(15, "place", F.col("shard"), F.col("rank"), F.col("j")).alias("place"),
        )

    def taken(self) -> DataFrame:
        """(key, size, source_size, target, taken) per row of the table."""
        placed = self.placed()
        times = self.draws().groupBy("rank", "number").agg(F.count(F.lit(1)).alias("times"))
        own = ["key", "size", "source_size", "target"]
        some = (
            self.pieces(placed)
            .join(times, ["rank", "number"], "left")
            # A row with words has a start of its own, so equal rows stay apart.
            .groupBy("rank", "start", *own)
            .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
            .select(*own, "taken")
        )
        rows = self.rows.where("size = 0")
        none = rows.join(
            F.broadcast(self.sources), rows["source"].eqNullSafe(self.sources["source"])
        ).select(*own, F.lit(0).cast("long").alias("taken"))
        return some.unionByName(none)

    def texts(self) -> DataFrame:
        """(shard, place, key, first, words, text): the mix itself, shard by shard in
        shuffled order. Pieces of one block follow each other, as they did in their
        source; ``text`` has the words with the space between and behind them.

        Needs ``keep_text``. Write it partitioned by shard.
        """
        piece = F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))
        cut = self.pieces(self.placed().withColumn("_parts", piece).drop("text"))
        text = F.array_join(F.slice("_parts", F.col("first") + 1, F.col("words")), "")
        drawn = cut.select("rank", "number", "start", "key", "first", "words", text.alias("text")).join(
            self.draws(), ["rank", "number"]
        )
        order = Window.partitionBy("shard").orderBy("place", "rank", "number", "start")
        return drawn.select(
            "shard", F.row_number().over(order).alias("place"), "key", "first", "words", "text"
        )


def mix_digest(df: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of all ``documents``, with the
    weights 1, 2, 3 by turns and at most three times each source."""
    return Mix(df).taken().withColumnRenamed("key", "doc_id")
