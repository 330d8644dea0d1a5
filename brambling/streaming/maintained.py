"""Counts kept up to date from a stream: a table of deltas, one folder for each batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.postings import posting_table


def windowed_counts(stream: DataFrame, time: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    """Counts in event-time windows; rows later than ``late`` are left out, state is dropped behind it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def maintain_counts(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's counts under ``path/batch=<id>``; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The counts of all batches so far."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def maintain_postings(stream: DataFrame, columns: Sequence[str], row_id: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append bitmaps of each batch's rows; readers merge them by ``bitmap_or_agg``."""

    def write(batch: DataFrame, number: int) -> None:
        posting_table(batch, columns, row_id).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
