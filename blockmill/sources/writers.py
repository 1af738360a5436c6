"""Writing blocks, itemsets and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.functions.itemsets import itemset_key
from blockmill.operators.blocks import BLOCK, assign_blocks


def write_blocks(df: DataFrame, path: str) -> None:
    """One directory per block, replacing what is there.

    Rows are brought together by block, but a block too large for one task is
    split over several files rather than written by one task.
    """
    df.hint("rebalance", BLOCK).write.mode("overwrite").partitionBy(BLOCK).parquet(path)


def reblock(df: DataFrame, n: int, key: str, path: str, seed: int = 42) -> None:
    """Rewrite a table as ``n`` random blocks."""
    write_blocks(assign_blocks(df, n, key, seed), path)


def write_parquet(df: DataFrame, path: str) -> None:
    """Write as Parquet, replacing what is there."""
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Write as CSV. ``single_file`` is meant for merged results, which are small."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").csv(path)


def write_itemset_csv(itemsets: DataFrame, path: str, single_file: bool = False) -> None:
    """Merged itemsets as (key, count) CSV."""
    write_csv(itemsets.select(itemset_key(F.col("items")).alias("fim"), "freq"), path, single_file)
