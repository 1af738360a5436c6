"""From one row per (transaction, item) to one row per transaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def form_baskets(lines: DataFrame, by: Sequence[str], item: str = "item") -> DataFrame:
    """``by`` and ``items``, the distinct items in natural order.

    Lines are made distinct before they are gathered: repeats are folded on the
    map side, and a basket never holds more than the distinct items.
    """
    return (
        lines.select(*by, item)
        .distinct()
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
