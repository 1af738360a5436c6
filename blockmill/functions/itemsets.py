"""Expressions over baskets and itemsets (arrays of ints or strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(items: Column) -> Column:
    """Distinct items in natural order: numeric for ints, lexical for strings."""
    return F.sort_array(F.array_distinct(items))


def itemset_key(items: Column) -> Column:
    """``{a,b,c}`` for an itemset that is already in canonical order."""
    return F.concat(F.lit("{"), F.array_join(items.cast("array<string>"), ","), F.lit("}"))


def parse_key(key: Column, item_type: str = "string") -> Column:
    """Items of a ``{a,b,c}`` key, in canonical order."""
    inner = F.regexp_replace(key, "[{}]", "")
    return canonical(F.split(inner, ",").cast(f"array<{item_type}>"))


def support(freq: Column, rows: Column) -> Column:
    """Share of the rows that contain the itemset."""
    return freq.cast("double") / rows.cast("double")
