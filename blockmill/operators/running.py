"""Running sums over a whole table, which no single task has to sort.

The table is cut along its order into stripes of about equal size; each stripe is
sorted by its own task and starts at the sum of the stripes before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockmill.runtime import join_checked, store, store_counted

#: Rows of a stripe, about.
STRIPE_ROWS = 100_000


def _striped(df: DataFrame, order: str) -> DataFrame:
    """``df`` stored with ``_stripe``: consecutive ranges of the order, null first, as
    Spark cuts it by a sample. Rows that are equal in ``order`` share a stripe."""
    stored, n = store_counted(df, "running")
    parts = min(10_000, -(-n // STRIPE_ROWS))
    if parts <= 1:
        return stored.withColumn("_stripe", F.lit(0))
    ranges = stored.repartitionByRange(parts, F.col(order).asc_nulls_first())
    return store(ranges.withColumn("_stripe", F.spark_partition_id()), "running")


def running_totals(
    df: DataFrame, order: str, key: str, value: str, rows: str = "running", peers: str | None = None,
    last: Sequence[int] = (),
) -> DataFrame:
    """Add running sums of ``value`` along ``order``, ties by ``key``, nulls first:

    ``rows``: from the first row to this one; ``peers``, if named: to the last
    row of the same ``order`` (a RANGE frame); ``last_N`` for each N of ``last``: over
    this row and the N - 1 before it. ``order`` is a number or a time, ``key`` unique; a
    null value adds nothing.
    """
    striped = _striped(df, order)
    amount = F.coalesce(F.col(value), F.lit(0))
    first = [F.col(order).asc_nulls_first()]
    within = Window.partitionBy("_stripe").orderBy(*first, F.col(key))
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per stripe: what the stripes before it hold.
    before = Window.orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = striped.groupBy("_stripe").agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"))
    starts, n_stripes = store_counted(
        stripes.select(
            "_stripe", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"),
        ),
        "starts",
    )
    # All sums of a stripe come from one sort.
    sums = {rows: F.sum(amount).over(upto)}
    if peers:
        by_range = Window.partitionBy("_stripe").orderBy(*first)
        sums[peers] = F.sum(amount).over(by_range.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    if last:
        sums["_within"] = F.row_number().over(within)
    found = join_checked(striped.withColumns(sums), starts, ["_stripe"], n_stripes, F.col(key))
    found = found.withColumns({name: F.col("_before") + F.col(name) for name in sums if name != "_within"})
    if not last:
        return found.drop("_stripe", "_rows_before", "_before")
    # The sum up to this row less that up to N rows before, which lies in the stripe
    # itself but for the first N rows of each; theirs are joined by number.
    lags = {f"_lag_{n}": F.lag(rows, n).over(within) for n in last}
    found = found.withColumn("_row", F.col("_rows_before") + F.col("_within")).withColumns(lags)
    found = store(found, "running")
    for n in last:
        edge = found.where((F.col("_within") <= n) & (F.col("_row") > n)).select((F.col("_row") - n).alias("_row"))
        edge, n_edge = store_counted(edge, "edge")
        reached, n_reached = store_counted(
            join_checked(found.select("_row", F.col(rows).alias("_then")), edge, ["_row"], n_edge, F.col("_row"))
            .select((F.col("_row") + n).alias("_row"), "_then"),
            "reached",
        )
        found = join_checked(found, reached, ["_row"], n_reached, F.col("_row"), "left").withColumn(
            f"last_{n}", F.col(rows) - F.coalesce(f"_lag_{n}", "_then", F.lit(0))
        ).drop("_then", f"_lag_{n}")
    return found.drop("_stripe", "_rows_before", "_before", "_within", "_row")
