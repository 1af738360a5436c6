"""Session helpers: the shared scratch folder, stored intermediates, and joins
whose broadcast side is only broadcast after its size has been looked at."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Most rows a table may have before we stop asking Spark to broadcast it; the
#: tables in question have rows of about 100 bytes, so this is some 100 MB.
BROADCAST_ROWS = 1_000_000

#: Into how many parts the large side of a join is spread when the small side
#: turned out too big to broadcast.
JOIN_SPREAD = 32


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder of its own; a
    cluster session without it is an error, as a machine-local folder would be
    lost together with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="blockmill-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{scratch_root(spark)}/blockmill/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Cuts the lineage like a checkpoint, survives the loss of any executor, and
    leaves Catalyst with the true size of the table. ``path`` names a place to
    write over, for loops that only need their last state.
    """
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``store``, and the number of rows written, taken while writing."""
    seen = Observation()
    stored = store(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return stored, seen.get["rows"]


def join_checked(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    small_rows: int,
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Join on ``on`` with a side whose row count is known.

    Up to ``BROADCAST_ROWS`` rows the side is broadcast and ``large`` is not
    moved. Beyond that the keys of ``large`` are spread with ``spread`` (any
    expression that varies within one key) so that a key holding a large share
    of the rows is still joined by ``JOIN_SPREAD`` tasks; ``small`` is repeated
    once per part.
    """
    if small_rows <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), list(on), how)
    parts = F.sequence(F.lit(0), F.lit(JOIN_SPREAD - 1))
    spread_large = large.withColumn(
        "_part", F.pmod(F.xxhash64(spread), F.lit(JOIN_SPREAD)).cast("int")
    )
    spread_small = small.withColumn("_part", F.explode(parts))
    return spread_large.join(spread_small, [*on, "_part"], how).drop("_part")
