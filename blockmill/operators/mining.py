"""Frequent itemset mining: all blocks at once, then merged by vote.

The local miner grows patterns level by level. Its working rows are
``(block_id, prefix, rest, weight)``: ``weight`` baskets of the block contain
``prefix`` and, after it in item order, the items ``rest``. A level counts
``prefix + one item of rest`` with a partial aggregate, keeps what reaches the
block's threshold, and cuts every row down to the surviving extensions. Rows
only ever meet the (small, size-checked) table of frequent extensions, so the
baskets are not shuffled again after equal ones have been folded together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.functions.itemsets import support
from blockmill.operators.blocks import BLOCK
from blockmill.runtime import join_checked, store_counted


@dataclass(frozen=True)
class LocalItemsets:
    """What the blocks found, and the blocks themselves.

    ``itemsets``: block_id, items (canonical order), freq (count in the block).
    ``blocks``: block_id, n_rows, min_count, one row per non-empty block, also
    for blocks in which nothing is frequent.
    """

    itemsets: DataFrame
    blocks: DataFrame
    n_blocks: int

    def with_support(self) -> DataFrame:
        """``itemsets`` with n_rows and support, the share of the block's rows."""
        rows = self.blocks.select(BLOCK, "n_rows")
        joined = join_checked(self.itemsets, rows, [BLOCK], self.n_blocks, F.col("items"))
        return joined.withColumn("support", support(F.col("freq"), F.col("n_rows")))


def _threshold(min_support: float | None, min_count: int | None, rounding: str) -> Column:
    if (min_support is None) == (min_count is None):
        raise ValueError("give exactly one of min_support and min_count")
    if min_count is not None:
        return F.lit(min_count).cast("bigint")
    share = F.col("n_rows").cast("double") * F.lit(float(min_support))
    if rounding not in ("floor", "ceil"):
        raise ValueError(f"rounding must be floor or ceil, not {rounding!r}")
    whole = F.floor(share) if rounding == "floor" else F.ceil(share)
    return F.greatest(F.lit(1).cast("bigint"), whole.cast("bigint"))


def mine_blocks(
    baskets: DataFrame,
    min_support: float | None = None,
    min_count: int | None = None,
    max_len: int | None = None,
    rounding: str = "floor",
) -> LocalItemsets:
    """Exact frequent itemsets of every block, of every length up to ``max_len``.

    ``baskets`` holds ``block_id`` and ``items``; it is read three times, so
    pass stored baskets rather than a long plan. An itemset is kept when at
    least ``max(1, floor(min_support * rows of the block))`` baskets of the
    block hold it (``rounding="ceil"`` rounds up), or ``min_count`` baskets.
    """
    rows = baskets.select(BLOCK, F.array_distinct("items").alias("rest"))
    blocks, n_blocks = store_counted(
        rows.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("min_count", _threshold(min_support, min_count, rounding)),
        "blocks",
    )
    item_type = dict(rows.dtypes)["rest"]
    state = rows.select(
        BLOCK, F.lit(None).cast(item_type).alias("prefix"), "rest", F.lit(1).alias("weight")
    ).withColumn("prefix", F.coalesce("prefix", F.array().cast(item_type)))

    levels: list[DataFrame] = []
    held: list[DataFrame] = []
    while True:
        counted = (
            state.select(BLOCK, "prefix", F.explode("rest").alias("item"), "weight")
            .groupBy(BLOCK, "prefix", "item")
            .agg(F.sum("weight").alias("freq"))
        )
        limits = blocks.select(BLOCK, "min_count")
        frequent, n_frequent = store_counted(
            join_checked(counted, limits, [BLOCK], n_blocks, F.col("item"))
            .where("freq >= min_count")
            .select(BLOCK, "prefix", "item", "freq"),
            f"level{len(levels) + 1}",
        )
        if n_frequent:
            levels.append(frequent)
        if not n_frequent or len(levels) == max_len:
            break
        state = _extend(state, frequent, n_frequent, first=len(levels) == 1)
        if len(levels) + 1 != max_len:
            # Read by the count of this level and again to make the next one.
            held.append(state.persist(StorageLevel.MEMORY_AND_DISK))
        if len(held) > 2:
            held.pop(0).unpersist()
    for rows_held in held:
        rows_held.unpersist()

    found = [
        level.select(
            BLOCK, F.concat("prefix", F.array("item")).alias("items"), F.col("freq").cast("bigint")
        )
        for level in levels
    ]
    if not found:
        found = [
            frequent.select(BLOCK, F.col("prefix").alias("items"), F.col("freq").cast("bigint"))
        ]
    return LocalItemsets(reduce(DataFrame.union, found), blocks, n_blocks)


def mine_groupings(
    baskets: DataFrame,
    key: str,
    sizes: DataFrame,
    place: Column,
    min_support: float,
    max_len: int | None = None,
) -> LocalItemsets:
    """``mine_blocks`` for baskets that lie in one block of each of several groupings.

    ``baskets`` holds ``key`` and ``items``; ``place`` makes the block, a struct that
    begins with its grouping ``n``, from ``key`` and ``n``; ``sizes`` has the block of
    every basket in every grouping. A level counts its itemsets over all baskets
    first. Only those that reach the least threshold of a grouping's blocks are
    counted by its blocks: no block holds more of them than the table.
    """
    blocks, n_blocks = store_counted(
        sizes.groupBy(BLOCK)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("min_count", _threshold(min_support, None, "floor")),
        "blocks",
    )
    least = blocks.groupBy(F.col(f"{BLOCK}.n").alias("n")).agg(F.min("min_count").alias("least"))
    item_type = dict(baskets.dtypes)["items"]
    state = baskets.select(key, F.array().cast(item_type).alias("prefix"), F.col("items").alias("rest"))
    levels: list[DataFrame] = []
    held: list[DataFrame] = []
    while True:
        found = state.select(key, F.explode("rest").alias("item"), "prefix").select(
            key, F.concat("prefix", F.array("item")).alias("items")
        )
        total = found.groupBy("items").agg(F.count(F.lit(1)).alias("total"))
        wanted, n_wanted = store_counted(
            total.join(F.broadcast(least), F.col("total") >= F.col("least"))
            .groupBy("items")
            .agg(F.collect_list("n").alias("groupings"))
            .withColumn("id", F.monotonically_increasing_id()),
            f"wanted{len(levels) + 1}",
        )
        counted = (
            join_checked(found, wanted, ["items"], n_wanted, F.col(key))
            .select(key, "id", F.explode("groupings").alias("n"))
            .groupBy(place.alias(BLOCK), "id")
            .agg(F.count(F.lit(1)).alias("freq"))
        )
        limits = blocks.select(BLOCK, "min_count")
        enough = join_checked(counted, limits, [BLOCK], n_blocks, F.col("id")).where("freq >= min_count")
        frequent, n_frequent = store_counted(
            join_checked(enough, wanted.select("id", "items"), ["id"], n_wanted, F.col("freq"))
            .select(BLOCK, "items", "freq"),
            f"level{len(levels) + 1}",
        )
        levels.append(frequent)
        if not n_frequent or len(levels) == max_len:
            break
        several = frequent.select(
            F.slice("items", 1, len(levels) - 1).alias("prefix"), F.element_at("items", -1).alias("item")
        ).distinct()
        # In any block: each block's own are told by the count of the next level.
        allowed = several.groupBy("prefix").agg(F.sort_array(F.collect_list("item")).alias("allowed"))
        cut = join_checked(state, allowed, ["prefix"], n_frequent, F.col(key)).select(
            key, "prefix", F.array_intersect("allowed", "rest").alias("rest")
        )
        state = _longer(cut, [key])
        held.append(state.persist(StorageLevel.MEMORY_AND_DISK))
        if len(held) > 2:
            held.pop(0).unpersist()
    for rows_held in held:
        rows_held.unpersist()
    return LocalItemsets(reduce(DataFrame.union, levels), blocks, n_blocks)


def _extend(state: DataFrame, frequent: DataFrame, n_frequent: int, first: bool) -> DataFrame:
    """Working rows of the next level.

    ``array_intersect`` hashes its second array and walks the first one: with
    the short basket second it never builds a table of all frequent items, and
    what it returns has the order of the first, so baskets need no sorting.
    """
    allowed = frequent.groupBy(BLOCK, "prefix").agg(
        F.sort_array(F.collect_list("item")).alias("allowed")
    )
    cut = join_checked(state, allowed, [BLOCK, "prefix"], n_frequent, F.col("rest")).select(
        BLOCK, "prefix", F.array_intersect("allowed", "rest").alias("rest"), "weight"
    )
    if first:
        # Baskets that agree on their frequent items count as one from here on.
        cut = cut.groupBy(BLOCK, "prefix", "rest").agg(F.sum("weight").alias("weight"))
    return _longer(cut, [BLOCK, "weight"])


def _longer(cut: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Every prefix with each item of ``rest`` that others follow, and these."""
    # The outer form, as the inner one has Spark work out ``rest`` once more for
    # a filter on its size; the condition on pos drops what it adds.
    exploded = F.posexplode_outer("rest").alias("pos", "item")
    return (
        cut.select(*kept, "prefix", "rest", exploded)
        .where(F.col("pos") < F.size("rest") - 1)
        .select(
            *kept,
            F.concat("prefix", F.array("item")).alias("prefix"),
            F.slice("rest", F.col("pos") + 2, F.size("rest")).alias("rest"),
        )
    )


def fit_exact(
    baskets: DataFrame,
    min_support: float,
    min_confidence: float = 0.6,
    num_partitions: int | None = None,
) -> FPGrowthModel:
    """Spark's own parallel FP-growth over all baskets (threshold rounded up).

    Reads ``baskets`` several times, and again whenever the model's tables are
    used, so pass stored baskets. The conditional trees are shared out over
    ``num_partitions`` tasks, by default one per core of the cluster.
    """
    spark = baskets.sparkSession
    return FPGrowth(
        itemsCol="items",
        minSupport=min_support,
        minConfidence=min_confidence,
        numPartitions=num_partitions or spark.sparkContext.defaultParallelism,
    ).fit(baskets.select(F.array_distinct("items").alias("items")))


def exact_itemsets(model: FPGrowthModel, min_size: int = 2) -> DataFrame:
    """(items, freq) of a fitted model in canonical order, singles left out."""
    return model.freqItemsets.where(F.size("items") >= min_size).select(
        F.sort_array("items").alias("items"), "freq"
    )


def exact_by_levels(baskets: DataFrame, min_support: float, min_size: int = 2) -> DataFrame:
    """What ``exact_itemsets(fit_exact(..))`` gives, level by level: equal baskets count
    as one after the first level, where FP-growth carries every basket into its trees."""
    whole = baskets.select(F.lit(0).cast("bigint").alias(BLOCK), "items")
    found = mine_blocks(whole, min_support=min_support, rounding="ceil").itemsets
    return found.where(F.size("items") >= min_size).select(F.sort_array("items").alias("items"), "freq")


def exact_rules(model: FPGrowthModel) -> DataFrame:
    """(antecedent, consequent, confidence) of a fitted model."""
    return model.associationRules.select(
        F.sort_array("antecedent").alias("antecedent"), "consequent", "confidence"
    )


def rules_from_itemsets(
    itemsets: DataFrame, min_confidence: float, by: Sequence[str] = ()
) -> DataFrame:
    """Rules with one item on the right, from mined itemsets, per group ``by``."""
    whole = itemsets.where(F.size("items") > 1).select(
        *by,
        F.explode("items").alias("consequent"),
        "items",
        F.col("freq").alias("freq_both"),
    )
    whole = whole.select(
        *by,
        F.array_except("items", F.array("consequent")).alias("antecedent"),
        "consequent",
        "freq_both",
    )
    left = itemsets.select(
        *by, F.col("items").alias("antecedent"), F.col("freq").alias("freq_left")
    )
    confidence = F.col("freq_both") / F.col("freq_left")
    return (
        whole.join(left, [*by, "antecedent"])
        .select(*by, "antecedent", "consequent", confidence.alias("confidence"))
        .where(F.col("confidence") >= F.lit(min_confidence))
    )


def confidence_stats(rules: DataFrame, groups: DataFrame, by: str = BLOCK) -> DataFrame:
    """Average confidence (null without rules) and number of rules per group."""
    stats = rules.groupBy(by).agg(
        F.avg("confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("n_rules")
    )
    return groups.select(by).join(stats, by, "left").select(
        by, "avg_confidence", F.coalesce("n_rules", F.lit(0)).alias("n_rules")
    )


def tally(itemsets: DataFrame, by: Sequence[str] = (), min_size: int = 2) -> DataFrame:
    """Sum, maximum and number of votes per itemset over the blocks."""
    return (
        itemsets.where(F.size("items") >= min_size)
        .groupBy(*by, "items")
        .agg(
            F.sum("freq").alias("total"),
            F.max("freq").alias("highest"),
            F.count(F.lit(1)).alias("votes"),
        )
    )


def merge_by_vote(
    itemsets: DataFrame, min_votes: float | Column, by: Sequence[str] = ()
) -> DataFrame:
    """Keep itemsets found by ``min_votes`` blocks; ``freq`` is the whole-number
    mean over the blocks that found them."""
    return (
        tally(itemsets, by)
        .where(F.col("votes") >= min_votes)
        .select(*by, "items", F.expr("total div votes").alias("freq"))
    )


def merge_half(local: LocalItemsets) -> DataFrame:
    """The usual merge: at least half of the blocks must agree."""
    return merge_by_vote(local.itemsets, 0.5 * local.n_blocks)


def merge_sum(itemsets: DataFrame) -> DataFrame:
    """(items, total, votes), nothing filtered."""
    return tally(itemsets).select("items", "total", "votes")


def merge_max(itemsets: DataFrame) -> DataFrame:
    """(items, freq) with the highest count any block reports."""
    return tally(itemsets).select("items", F.col("highest").alias("freq"))


def distinct_items(baskets: DataFrame) -> DataFrame:
    """Every item that occurs in any basket."""
    return baskets.select(F.explode("items").alias("item")).distinct()
