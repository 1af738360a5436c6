"""Totals per event-time window over a table that grows by files.

Rows may come late and more than once. The watermark is the latest time of all
earlier batches less ``delay``. A row at or before it is late: it is counted in a
table beside the windows and changes none of them. All others are counted once,
by ``key`` and time. A window is written, once and for all, when the watermark
has passed its end, so state is held for open windows and recent keys only.

Rows are dropped as late before they are folded into windows (by the
deduplication, which sees rows), so that the number of late ones is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockmill.streaming.folder import arriving, run_once

_BATCH = "run long, batch_id long, watermark string, n_rows long, n_late long"


def window_totals(
    rows: DataFrame, time: str, delay: str, width: str, by: Sequence[str], key: Sequence[str], totals: Sequence[Column]
) -> DataFrame:
    """``window_start``, ``by`` and ``totals`` of each window, as a stream or a batch.

    Rows without a time belong to no window and are left out. Null keys are equal
    to each other.
    """
    timed = rows.where(F.col(time).isNotNull()).withWatermark(time, delay)
    return (
        timed.dropDuplicates([*key, time])
        .groupBy(F.window(time, width).alias("_window"), *by)
        .agg(*totals)
        .select(F.col("_window.start").alias("window_start"), "*")
        .drop("_window")
    )


@dataclass(frozen=True)
class ClosingWindows:
    """Windows over the files of ``source``, kept below ``root`` (a folder that all
    executors share): the closed windows, counts of the batches, and the state."""

    spark: SparkSession
    schema: StructType
    source: str
    root: str
    time: str
    delay: str
    width: str
    by: Sequence[str]
    key: Sequence[str]
    totals: Sequence[Column]

    def _totals(self, rows: DataFrame) -> DataFrame:
        return window_totals(rows, self.time, self.delay, self.width, self.by, self.key, self.totals)

    def advance(self, run: int) -> None:
        """Take all files that have arrived since the run before; an ended or
        failed run may be called again."""
        totals = self._totals(arriving(self.spark, self.schema, self.source))
        writer = totals.writeStream.format("parquet").outputMode("append").option("path", f"{self.root}/closed")
        batches = [
            (
                run,
                p["batchId"],
                p["eventTime"].get("watermark"),
                p["numInputRows"],
                sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"] if s["operatorName"] == "dedupe"),
            )
            for p in run_once(writer, f"{self.root}/state")
        ]
        # A folder of its own per run: calling a run again writes over its counts.
        self.spark.createDataFrame(batches, _BATCH).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/batches/of_run={run}"
        )

    def closed(self) -> DataFrame:
        """The windows that can no longer change."""
        schema = self._totals(self.spark.createDataFrame([], self.schema)).schema
        return self.spark.read.schema(schema).parquet(f"{self.root}/closed")

    def runs(self) -> DataFrame:
        """Per run: ``n_rows`` read and ``n_late`` among them."""
        batches = self.spark.read.schema(_BATCH).parquet(f"{self.root}/batches")
        return batches.groupBy("run").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_late").alias("n_late"))
