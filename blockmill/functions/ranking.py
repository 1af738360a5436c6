"""Exact row numbers that no single task has to sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_row_number(
    df: DataFrame,
    by: Sequence[str],
    stripe: Column,
    order: Sequence[Column],
    name: str,
    size: str | None = None,
) -> DataFrame:
    """Add ``row_number() over (partition by BY order by ORDER)`` as ``name``,
    and the size of the group as ``size`` if named.

    ``stripe`` must not be null nor decrease along ``order``: it cuts every
    group into consecutive stripes. Each stripe is sorted by its own task and starts at the
    number of rows in the stripes before it, so a group holding much of the data
    is shared out instead of sorted in one place.
    """
    # In a struct, null group keys are equal to each other and survive the join.
    group = ["_group"] if by else []
    keys = [*group, "_stripe"]
    striped = df.withColumn("_stripe", stripe)
    if by:
        striped = striped.withColumn("_group", F.struct(*by))
    before = Window.partitionBy(*group).orderBy("_stripe").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = striped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*group)).alias(size)] if size else []),
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        striped.withColumn("_within", within)
        .join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_group", "_stripe", "_within", "_start")
    )


def split_running_sum(
    df: DataFrame,
    by: Sequence[str],
    stripe: Column,
    order: Sequence[Column],
    value: Column,
    name: str,
    peers: bool = False,
    total: str | None = None,
) -> DataFrame:
    """Add ``sum(VALUE) over (partition by BY order by ORDER rows unbounded preceding)``
    as ``name``, and the sum of the group as ``total`` if named.

    With ``peers`` the frame is by RANGE: rows equal in ``order`` share their sum.
    ``stripe`` as in ``split_row_number``; with ``peers`` it must be a function of
    ``order``, so that equal rows share a stripe.
    """
    group = ["_group"] if by else []
    keys = [*group, "_stripe"]
    striped = df.withColumns({"_stripe": stripe, "_value": value})
    if by:
        striped = striped.withColumn("_group", F.struct(*by))
    before = Window.partitionBy(*group).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    starts = striped.groupBy(*keys).agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("_n")).select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(Window.partitionBy(*group)).alias(total)] if total else []),
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    frame = (within.rangeBetween if peers else within.rowsBetween)(Window.unboundedPreceding, Window.currentRow)
    return (
        striped.withColumn("_within", F.coalesce(F.sum("_value").over(frame), F.lit(0)))
        .join(starts, keys)
        .withColumn(name, F.col("_start") + F.col("_within"))
        .drop("_group", "_stripe", "_value", "_within", "_start")
    )
