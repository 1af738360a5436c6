"""How many rows a sample needs for a stated error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.operators.blocks import BLOCK
from blockmill.operators.mining import LocalItemsets, merge_max


def itemset_stats(local: LocalItemsets) -> DataFrame:
    """One row: r_max and n_itemsets over all blocks, and both without singles.

    r_max is the largest support any block reports, n_itemsets the number of
    distinct itemsets found in any block.
    """
    per_set = local.with_support().groupBy("items").agg(F.max("support").alias("support"))
    several = F.size("items") > 1
    return per_set.agg(
        F.max("support").alias("r_max"),
        F.max(F.when(several, F.col("support"))).alias("r_max_multi"),
        F.count(F.lit(1)).alias("n_itemsets"),
        F.count_if(several).alias("n_itemsets_multi"),
    )


def sample_size(r_max: Column, n_itemsets: Column, eps: Column | float, delta: Column | float) -> Column:
    """``r_max^2 / (2 eps^2) * ln(2 n_itemsets / delta)``"""
    eps = eps if isinstance(eps, Column) else F.lit(eps)
    delta = delta if isinstance(delta, Column) else F.lit(delta)
    return r_max * r_max / (2 * eps * eps) * F.log(2 * n_itemsets / delta)


def merged_sample_size(
    local: LocalItemsets, total_rows: int, eps: tuple[float, ...], delta: float
) -> DataFrame:
    """Sample sizes per ``eps`` from itemsets merged by their highest count.

    Support is taken over a fixed number of rows, as the merged counts come
    from blocks of different size.
    """
    stats = merge_max(local.itemsets).agg(
        (F.max("freq") / F.lit(total_rows)).alias("r_max"), F.count(F.lit(1)).alias("n_itemsets")
    )
    size = sample_size(F.col("r_max"), F.col("n_itemsets"), F.col("eps"), delta)
    return stats.withColumn("eps", F.explode(F.array(*map(F.lit, eps)))).select(
        "eps",
        "r_max",
        "n_itemsets",
        size.alias("sample_size"),
        size.cast("bigint").alias("sample_rows"),
    )


def block_r_max(local: LocalItemsets) -> DataFrame:
    """Largest support per block, 0 where nothing is frequent."""
    highest = local.with_support().groupBy(BLOCK).agg(F.max("support").alias("r_max"))
    return local.blocks.select(BLOCK).join(highest, BLOCK, "left").select(
        BLOCK, F.coalesce("r_max", F.lit(0.0)).alias("r_max")
    )


def r_max_quantile(local: LocalItemsets, q: float = 0.95) -> DataFrame:
    """The ``floor(q (n - 1))``-th smallest r_max, counted from 0.

    Brings one number per sampled block together, nothing else.
    """
    ordered = block_r_max(local).agg(F.sort_array(F.collect_list("r_max")).alias("all"))
    index = F.floor(F.lit(q) * (F.size("all") - 1)).cast("int")
    return ordered.select(F.get("all", index).alias("r_max"))


def merged_by_support(local: LocalItemsets) -> DataFrame:
    """Itemsets of all blocks with the highest support any block reports."""
    return local.with_support().groupBy("items").agg(F.max("support").alias("support"))
