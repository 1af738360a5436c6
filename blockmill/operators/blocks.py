"""Random sample blocks: a ``block_id`` column, and ways to pick blocks.

A block is a subset of rows named by a column, never a physical partition, so
every operator here is an ordinary projection, filter or semi join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.hashing import HASH_RANGE, bucket_hash, draw_order
from blockmill.functions.ranking import split_row_number
from blockmill.runtime import BROADCAST_ROWS

BLOCK = "block_id"


def assign_blocks(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Every row to one of ``n`` blocks, uniformly and independently.

    ``key`` must be unique per row: equal keys would always share a block.
    """
    return df.withColumn(BLOCK, bucket_hash(seed, F.col(key)) % F.lit(n))


def deal_blocks(
    df: DataFrame,
    n: int,
    key: str,
    source: str,
    seed: int = 42,
    rows_per_stripe: int = 1_000_000,
) -> DataFrame:
    """Deal the rows of each source round-robin over ``n`` blocks.

    The dealing order is random and each source starts at a random block, so
    block sizes differ by at most one row per source. A large source is dealt
    by many tasks: it is cut along the hash into stripes of about
    ``rows_per_stripe`` rows.
    """
    # In a struct, a null source is equal to itself and survives the join.
    hashed = df.withColumn("_hash", bucket_hash(seed, F.col(key))).withColumn(
        "_source", F.struct(source)
    )
    sizes = hashed.groupBy("_source").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_stripe)).alias("_stripes")
    )
    stripe = F.floor(F.col("_hash") * F.col("_stripes") / F.lit(HASH_RANGE))
    numbered = split_row_number(
        hashed.join(sizes, "_source"), [source], stripe, [F.col("_hash"), F.col(key)], "_row"
    )
    start = bucket_hash(seed, F.col(source))
    return numbered.withColumn(BLOCK, (F.col("_row") + start) % F.lit(n)).drop(
        "_hash", "_source", "_stripes", "_row"
    )


def block_order(df: DataFrame, order: Column, n_blocks: int | None = None) -> DataFrame:
    """(block_id, pos, n_blocks): every block once, counted from 0 along ``order``.

    With ``n_blocks`` the ids are 0 to ``n_blocks - 1``, as ``assign_blocks`` gave
    them, and the table is not read for them. Gathers the block *ids* in one place,
    which is catalogue-sized: one entry per block, whatever the number of rows.
    """
    if n_blocks is None:
        ids = df.select(BLOCK).distinct()
    else:
        ids = df.sparkSession.range(n_blocks).select(F.col("id").alias(BLOCK))
    listed = ids.agg(
        F.sort_array(F.collect_list(F.struct(order.alias("k"), F.col(BLOCK)))).alias("all")
    )
    return listed.select(
        F.posexplode("all").alias("pos", "entry"), F.size("all").alias("n_blocks")
    ).select(F.col(f"entry.{BLOCK}").alias(BLOCK), "pos", "n_blocks")


def _few(picked: DataFrame, n: int) -> DataFrame:
    """``picked`` has at most ``n`` rows; broadcast it if that is few."""
    return F.broadcast(picked) if n <= BROADCAST_ROWS else picked


def first_blocks(df: DataFrame, n: int = 1, n_blocks: int | None = None) -> DataFrame:
    """Rows of the first ``n`` blocks; no rows when there are fewer blocks.

    ``n_blocks``, where known, saves reading the table for its ids; blocks
    without rows then count as blocks.
    """
    ranked = block_order(df, F.col(BLOCK), n_blocks)
    picked = ranked.where((F.col("n_blocks") >= n) & (F.col("pos") < n)).select(BLOCK)
    return df.join(_few(picked, n), BLOCK, "left_semi")


def blocks_at(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Rows of the named blocks; prunes directories on stored blocks."""
    return df.where(F.col(BLOCK).isin(list(ids)))


def pick_blocks(df: DataFrame, n: int, seed: int = 42, n_blocks: int | None = None) -> DataFrame:
    """Ids of ``n`` blocks drawn without replacement; none if there are fewer."""
    ranked = block_order(df, draw_order(seed, F.col(BLOCK)), n_blocks)
    return ranked.where((F.col("n_blocks") >= n) & (F.col("pos") < n)).select(BLOCK)


def random_blocks(df: DataFrame, n: int, seed: int = 42, n_blocks: int | None = None) -> DataFrame:
    """Rows of ``n`` blocks drawn without replacement (``n_blocks`` as in ``first_blocks``)."""
    return df.join(_few(pick_blocks(df, n, seed, n_blocks), n), BLOCK, "left_semi")


def two_random_blocks(
    df: DataFrame, n1: int, n2: int, seed: int = 42, n_blocks: int | None = None
) -> DataFrame:
    """Two disjoint draws, told apart by ``side`` (1 or 2).

    Both are empty when ``n1 + n2`` exceeds the number of blocks.
    """
    total = n1 + n2
    ranked = block_order(df, draw_order(seed, F.col(BLOCK)), n_blocks)
    picked = ranked.where((F.col("n_blocks") >= total) & (F.col("pos") < total)).select(
        BLOCK, F.when(F.col("pos") < n1, 1).otherwise(2).alias("side")
    )
    return df.join(_few(picked, total), BLOCK)


def train_predict_blocks(
    df: DataFrame, ids: Sequence[int], train_index: int, predict_index: int
) -> tuple[DataFrame, DataFrame | None]:
    """Blocks ``ids[:train_index]`` and ``ids[train_index:predict_index]``.

    The second part is ``None`` unless ``predict_index > train_index``.
    """
    train = blocks_at(df, ids[:train_index])
    if predict_index <= train_index:
        return train, None
    return train, blocks_at(df, ids[train_index:predict_index])


def draw_block_ids(
    spark: SparkSession, total: int, n: int, n_blocks: int, seed: int = 42
) -> DataFrame:
    """Draw ``n`` distinct ids from ``[0, total)`` and fold them onto the blocks."""
    drawn = spark.range(total).orderBy(bucket_hash(seed, F.col("id")), "id").limit(n)
    return drawn.select((F.col("id") % F.lit(n_blocks)).alias(BLOCK)).distinct()


def random_split(df: DataFrame, key: str, weights: Sequence[int], seed: int = 42) -> DataFrame:
    """Add ``split``, the index of the part a row falls into, by integer weights."""
    ticket = bucket_hash(seed, F.col(key)) % F.lit(sum(weights))
    part, upper = F.lit(len(weights) - 1), sum(weights)
    for index in range(len(weights) - 1, 0, -1):
        upper -= weights[index]
        part = F.when(ticket < upper, index - 1).otherwise(part)
    return df.withColumn("split", part)


def reblock_chain(df: DataFrame, key: str, a: int, keep: int, c: int, seed: int = 42) -> DataFrame:
    """Block into ``a``, keep the first ``keep`` blocks, block those into ``c``.

    The second blocking has a seed of its own: with the same seed a row's new
    block would follow from its old one.
    """
    kept = first_blocks(assign_blocks(df, a, key, seed), keep, a)
    return assign_blocks(kept.drop(BLOCK), c, key, seed + 1)
