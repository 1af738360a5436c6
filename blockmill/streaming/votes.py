"""Merging the itemsets of blocks that arrive over time.

State is one row per itemset (sum, maximum, votes) and one per itemset of a block
already counted, so a block that is sent again changes nothing. Each block also
sends a row without items: its votes say how many blocks have come, also those in
which nothing is frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockmill.operators.blocks import BLOCK
from blockmill.operators.mining import LocalItemsets
from blockmill.streaming.folder import arriving, run_once


def block_rows(local: LocalItemsets) -> DataFrame:
    """(block_id, items, freq): what blocks send. Without items: their rows."""
    itemsets = local.itemsets.select(BLOCK, "items", "freq")
    kind = itemsets.schema["items"].dataType
    bare = F.array().cast(kind).alias("items")
    return itemsets.unionByName(local.blocks.select(BLOCK, bare, F.col("n_rows").cast("long").alias("freq")))


def vote_totals(rows: DataFrame) -> DataFrame:
    """(items, total, highest, votes) over what has come; of an itemset that a
    block sends again the first count stays."""
    return (
        rows.dropDuplicates([BLOCK, "items"])
        .groupBy("items")
        .agg(F.sum("freq").alias("total"), F.max("freq").alias("highest"), F.count(F.lit(1)).alias("votes"))
    )


def advance(spark: SparkSession, schema: StructType, source: str, root: str) -> None:
    """Take the blocks that have arrived in ``source``; write the totals after each
    batch to a folder of its own below ``root``, which a repeated batch writes over."""

    def keep(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{root}/totals/step={batch}")

    totals = vote_totals(arriving(spark, schema, source))
    run_once(totals.writeStream.outputMode("complete").foreachBatch(keep), f"{root}/state")


def merged_steps(spark: SparkSession, root: str, share: float = 0.5, min_size: int = 2) -> DataFrame:
    """(blocks_seen, items, freq) after each number of blocks: itemsets found by
    ``share`` of the blocks so far, with their mean count."""
    totals = spark.read.parquet(f"{root}/totals")
    # One row per step, so of the size of a list of batches.
    seen = totals.where(F.size("items") == 0).groupBy(F.col("votes").alias("blocks_seen")).agg(F.max("step").alias("step"))
    return (
        totals.where(F.size("items") >= min_size)
        .join(seen, "step")
        .where(F.col("votes") >= share * F.col("blocks_seen"))
        .select("blocks_seen", "items", F.expr("total div votes").alias("freq"))
    )
