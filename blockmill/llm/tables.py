"""Reading the given tables, and graph components shared by the duplicate finders."""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from blockmill.runtime import scratch_path, store

#: Bytes of text a Python worker takes out of a record batch at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


class Compressed:
    """A model made small for a broadcast; opened once per Python worker."""

    _open: ClassVar[dict[str, object]] = {}

    def __init__(self, value: object):
        self._name = uuid.uuid4().hex
        self._data = zlib.compress(pickle.dumps(value, protocol=5), 1)

    def open(self):
        known = Compressed._open
        if self._name not in known:
            if len(known) >= 2:
                known.clear()
            known[self._name] = pickle.loads(zlib.decompress(self._data))
        return known[self._name]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A record batch in consecutive parts of about ``size`` bytes of text each,
    one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // size
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for low, high in pairwise(cuts):
        if high > low:
            yield batch.slice(low, high - low)


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the
    smallest node of its component.

    Alternating large and small stars: each round is two grouped minima (partial
    on the map side) and two equi-joins, and is written to the shared folder, so
    no component is ever in one task and a lost executor costs one round. Ends
    when a round changes no edge. Self loops are allowed, nulls are not.
    """
    spark = edges.sparkSession
    last = None
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = current.union(current.select("b", "a")).filter("a != b")
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        large = (
            both.join(smallest, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .filter("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", "m"))
            .distinct()
        )
        seen = Observation()
        marked = small.observe(
            seen,
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(2**40 - 1))), F.lit(0)).alias("s"),
        )
        path = scratch_path(spark, "stars")
        marked.write.parquet(path)
        current = spark.read.schema("a long, b long").parquet(path)
        state = (seen.get["n"], seen.get["s"])
        if state == last:
            break
        last = state
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b"), F.col("b")).distinct()
    )


__all__ = ["Compressed", "connected", "slices", "store", "table", "text_of"]
