"""Per-block functions and statistics.

Functions written in Python are handed *pieces* of a block, never a block as a
whole: a block may hold a third of the table. What they return per piece is
merged by ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockmill.operators.blocks import BLOCK, first_blocks

#: Maps (block id, piece of that block) to rows; must not depend on how the
#: block is cut into pieces.
PieceFn = Callable[[int, pd.DataFrame], pd.DataFrame]

#: The statistics reported when none are named.
DEFAULT_STATISTICS = ("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")


def block_collect(df: DataFrame, n: int = 1, n_blocks: int | None = None) -> DataFrame:
    """Rows of the first ``n`` blocks; a known ``n_blocks`` saves reading for ids."""
    return first_blocks(df, n, n_blocks)


def block_min(df: DataFrame, column: str, n_blocks: int | None = None) -> DataFrame:
    """Minimum over the first block only: a local estimate."""
    return first_blocks(df, 1, n_blocks).agg(F.min(column).alias("local_min"))


def block_max(df: DataFrame, column: str, n_blocks: int | None = None) -> DataFrame:
    """Maximum over the first block only: a local estimate."""
    return first_blocks(df, 1, n_blocks).agg(F.max(column).alias("local_max"))


def block_describe(
    df: DataFrame, columns: Sequence[str] = (), n: int = 1, n_blocks: int | None = None
) -> DataFrame:
    """count, mean, stddev, min and max over the first ``n`` blocks, as strings;
    of all numeric and string columns unless some are named."""
    return first_blocks(df, n, n_blocks).describe(*columns)


def block_summary(df: DataFrame, statistics: Sequence[str] = ()) -> DataFrame:
    """Named statistics of all numeric and string columns, as strings.

    Any ``p%`` between 0% and 100% is a percentile. Names Spark does not know
    and percentiles out of range are errors.
    """
    chosen = list(statistics or DEFAULT_STATISTICS)
    for name in chosen:
        if name.endswith("%"):
            try:
                share = float(name[:-1])
            except ValueError:
                raise ValueError(f"cannot read {name!r} as a percentile") from None
            if not 0 <= share <= 100:
                raise ValueError(f"percentile {name} is not between 0% and 100%")
        elif name.lower() not in ("count", "mean", "stddev", "min", "max"):
            raise ValueError(f"{name!r} is not a statistic")
    return df.summary(*chosen)


def _pieces(fn: PieceFn) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, piece in batch.groupby(BLOCK, sort=False):
                yield fn(int(block), piece)

    return run


def block_map(
    df: DataFrame, n: int, fn: PieceFn, schema: str, n_blocks: int | None = None
) -> DataFrame:
    """Rows made by ``fn`` from each of the first ``n`` blocks; nothing is moved."""
    return first_blocks(df, n, n_blocks).mapInPandas(_pieces(fn), schema)


def block_reduce(
    df: DataFrame, n: int, *values: Column, n_blocks: int | None = None
) -> DataFrame:
    """One row per block for the first ``n`` blocks, from aggregate expressions."""
    return first_blocks(df, n, n_blocks).groupBy(BLOCK).agg(*values)


def block_fold(
    df: DataFrame, fn: PieceFn, schema: str, *merge: Column
) -> DataFrame:
    """One row per block: ``fn`` sums up each piece, ``merge`` adds up the pieces.

    ``schema`` describes the rows of ``fn`` and must hold ``block_id``.
    """
    return df.mapInPandas(_pieces(fn), schema).groupBy(BLOCK).agg(*merge)


def block_lo(
    df: DataFrame, fn: PieceFn, schema: str, merge: Sequence[Column], *model: Column
) -> DataFrame:
    """One local model per block: fold the pieces, then work out ``model``."""
    return block_fold(df, fn, schema, *merge).select(BLOCK, *model)


def block_go(df: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a merge or reshape to the table of local results."""
    return df.transform(fn)
