"""The same substring filters on a streaming frame, and windowed counts of what passes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablespan.operators.filters import filter_rows


def filter_stream(stream: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows of a stream that pass; stateless, so it runs in append mode."""
    return filter_rows(stream, filters)


def passing_counts(stream: DataFrame, filters: Mapping[str, object], time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Passing rows per time window and group; rows later than ``late`` are dropped by the watermark."""
    kept = filter_stream(stream, filters).withWatermark(time, late)
    return kept.groupBy(F.window(time, window).alias("window"), *by).agg(F.count("*").alias("n_rows"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write what the stream holds now as Parquet, exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
