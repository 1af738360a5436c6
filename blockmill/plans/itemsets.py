"""Itemset workloads from blocked baskets to merged itemsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockmill.operators.blocks import BLOCK, assign_blocks, random_blocks
from blockmill.operators.mining import LocalItemsets, merge_half, mine_blocks
from blockmill.runtime import store
from blockmill.sources.readers import random_stored_blocks


def sampled_local_itemsets(
    table: DataFrame,
    n_blocks: int,
    min_support: float,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    m: int | None = None,
    key: str = "txn_id",
    seed: int = 42,
    max_len: int | None = None,
    of_blocks: int | None = None,
) -> LocalItemsets:
    """Draw ``n_blocks`` blocks of a blocked table and mine them.

    ``of_blocks``, where known, is the number of blocks of the table, and saves
    reading it for their ids. ``prepare`` turns the drawn rows into baskets, so that whatever it takes to
    build baskets is only done for the sample; it must keep ``block_id``.
    With ``m`` the drawn rows are blocked again into ``n_blocks * m`` blocks
    under a seed of their own. The sample is stored once: it is read several
    times, and only it is ever mined.
    """
    sample = random_blocks(table, n_blocks, seed, of_blocks)
    if prepare is not None:
        sample = prepare(sample)
    if m is not None:
        sample = assign_blocks(sample.drop(BLOCK), n_blocks * m, key, seed + 1)
    sample = store(sample.select(BLOCK, "items"), "sample")
    return mine_blocks(sample, min_support=min_support, max_len=max_len)


def sampled_itemsets(table: DataFrame, n_blocks: int, min_support: float, **options) -> DataFrame:
    """Approximate frequent itemsets of the whole table from a few of its blocks."""
    return merge_half(sampled_local_itemsets(table, n_blocks, min_support, **options))


def stored_itemsets(
    spark: SparkSession, path: str, n_blocks: int, min_support: float, seed: int = 42
) -> DataFrame:
    """Approximate frequent itemsets of baskets stored by block: the ids come from
    the directory names, and only the ``n_blocks`` directories drawn are read."""
    sample = random_stored_blocks(spark, path, n_blocks, seed)
    return merge_half(mine_blocks(sample.select(BLOCK, "items"), min_support=min_support))


def full_itemsets(
    baskets: DataFrame, min_support: float, max_len: int | None = None
) -> DataFrame:
    """All blocks mined and merged, nothing left out by sampling."""
    return merge_half(mine_blocks(baskets, min_support=min_support, max_len=max_len))
