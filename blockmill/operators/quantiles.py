"""Quantiles of blocks that merge: local summaries of bounded size, and one global answer.

A summary of a block holds ``points`` of its values at equal steps of rank, each
with the number of steps that end in it. A rank read off a block's summary is
wrong by one step at most, 1 / points of the block's rows; merging adds up the
errors and the rows alike, so 1 / points of all rows bounds the error of the
merged answer too, however many blocks there are. Equal values are folded
before anything is sorted, and sums run over stripes of the range of values, so
neither a hot value nor a large block is sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.functions.ranking import split_running_sum
from blockmill.operators.blocks import BLOCK
from blockmill.runtime import join_checked, store, store_counted

#: Stripes of the range of a block's values.
STRIPES = 1_000


def _summed(counts: DataFrame, name: str) -> DataFrame:
    """(g, value, c) with the running sum of c and its ``total`` per g."""
    spans, n = store_counted(counts.groupBy("g").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")), "spans")
    known = join_checked(counts, spans, ["g"], n, F.col("value"))
    place = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    stripe = F.coalesce(F.floor(place * STRIPES), F.lit(0))
    return split_running_sum(known, ["g"], stripe, [F.col("value")], F.col("c"), name, total="total").drop("_lo", "_hi")


def block_summaries(df: DataFrame, value: str, points: int = 1_000, group: str = BLOCK) -> DataFrame:
    """(block, value, steps, n): at most ``points`` rows per block; ``steps`` of the
    ``points`` equal steps of rank end in ``value``, and the block has ``n`` values.

    Null and NaN values and null blocks take no part; a block without values has no
    summary.
    """
    known = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("value")).where(
        "g IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)"
    )
    counts = known.groupBy("g", "value").agg(F.count(F.lit(1)).alias("c"))
    run = _summed(counts, "upto")

    def ended(rank: Column) -> Column:
        # rank * points / total in whole numbers.
        return F.floor(rank * points / F.col("total"))

    steps = (ended(F.col("upto")) - ended(F.col("upto") - F.col("c"))).cast("bigint")
    return run.select(F.col("g").alias(group), "value", steps.alias("steps"), F.col("total").alias("n")).where("steps > 0")


def merged_quantiles(summaries: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, value): the least value with at least ``share`` of all rows of all
    blocks at or below it, give or take 1 / points of the rows. Nulls without summaries."""
    # A step of a block stands for n / points of its rows; times points it is whole.
    counts = summaries.groupBy("value").agg(F.sum(F.col("steps") * F.col("n")).alias("c"))
    # Written with its one group, which Spark would otherwise take for no key at all.
    run = _summed(store(counts.withColumn("g", F.lit(0)), "merged"), "upto")
    found = run.agg(*(F.min(F.when(F.col("upto") >= s * F.col("total"), F.col("value"))).alias(f"q{i}") for i, s in enumerate(shares)))
    rows = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("value")) for i, s in enumerate(shares)))
    return found.select(F.inline(rows))


def block_quantiles(summaries: DataFrame, shares: Sequence[float], group: str = BLOCK) -> DataFrame:
    """(block, share, value): the same for every block by itself."""
    run = _summed(summaries.select(F.col(group).alias("g"), "value", F.col("steps").alias("c")), "upto")
    found = run.groupBy("g").agg(
        *(F.min(F.when(F.col("upto") >= s * F.col("total"), F.col("value"))).alias(f"q{i}") for i, s in enumerate(shares))
    )
    rows = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("value")) for i, s in enumerate(shares)))
    return found.select(F.col("g").alias(group), F.inline(rows))
