"""How close approximate itemsets are to exact ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(approx: DataFrame, exact: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    keys = [*by, "items"]
    left = approx.select(*by, F.sort_array("items").alias("items"), F.col("freq").alias("est"))
    right = exact.select(*by, F.sort_array("items").alias("items"), F.col("freq").alias("real"))
    return left.join(right, keys, how)


def evaluate_itemsets(approx: DataFrame, exact: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hits, misses, precision and recall; itemsets are compared as sets."""
    counts = (
        _sides(approx, exact, by, "full_outer")
        .groupBy(*by)
        .agg(
            F.count("est").alias("n_approx"),
            F.count("real").alias("n_exact"),
            F.count_if(F.col("est").isNotNull() & F.col("real").isNotNull()).alias("tp"),
        )
    )
    return counts.select(
        *by,
        "n_approx",
        "n_exact",
        "tp",
        (F.col("n_approx") - F.col("tp")).alias("fp"),
        (F.col("n_exact") - F.col("tp")).alias("fn"),
        F.try_divide("tp", "n_approx").alias("precision"),
        F.try_divide("tp", "n_exact").alias("recall"),
    )


def support_error(
    approx: DataFrame,
    exact: DataFrame,
    n_blocks: int | Column,
    total_rows: int | Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean absolute error of the scaled-up counts over the hits.

    ``error`` is in rows, ``ase`` as a share of all rows. A block's count is
    scaled up by the number of blocks the table is cut into.
    """
    blocks = n_blocks if isinstance(n_blocks, Column) else F.lit(n_blocks)
    rows = total_rows if isinstance(total_rows, Column) else F.lit(total_rows)
    miss = F.abs(F.col("real") - F.col("est") * blocks)
    return (
        _sides(approx, exact, by, "inner")
        .groupBy(*by)
        .agg(F.avg(miss).alias("error"), F.avg(miss / rows).alias("ase"))
    )
