"""Reproducible randomness: a hash of (seed, unique key) instead of a random draw.

A random draw would change whenever a lost partition is computed again; the
hash gives every row the same place on every attempt. Spark's Murmur3 ``hash``
stays inside generated code and costs a few nanoseconds per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash is uniform on [0, HASH_RANGE).
HASH_RANGE = 2**32

#: Keeps the draw of blocks apart from the placing of rows under one seed.
DRAW_SEED = 1_000_000


def bucket_hash(seed: int, key: Column) -> Column:
    """32-bit hash of (seed, key) as a non-negative bigint."""
    return F.hash(F.lit(seed), key).cast("bigint").bitwiseAND(F.lit(HASH_RANGE - 1))


def draw_order(seed: int, block: Column) -> Column:
    """Sort key that puts block ids in a random but repeatable order."""
    return bucket_hash(seed + DRAW_SEED, block.cast("bigint"))
