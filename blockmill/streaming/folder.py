"""One run of a stream over all files that have arrived in a folder."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType


def arrive(rows: DataFrame, folder: str) -> None:
    """Add rows to a folder as new Parquet files."""
    rows.write.mode("append").parquet(folder)


def arriving(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run_once(writer: DataStreamWriter, checkpoint: str) -> list[dict[str, Any]]:
    """Take what has arrived and end; a later run with the same checkpoint goes on
    from there. Returns the progress of the batches."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return list(query.recentProgress)
