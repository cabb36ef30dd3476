"""Aggregates of timings and other measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def percentiles(df: DataFrame, value: str, by: list[str], points: tuple[float, ...] = (0.5, 0.75, 0.95)) -> DataFrame:
    """Exact percentiles with linear interpolation, a row per group; a group without values gets 0."""
    names = [f"p{round(100 * p):d}" for p in points]
    return df.groupBy(*by).agg(*(F.coalesce(F.percentile(value, p), F.lit(0.0)).alias(n) for p, n in zip(points, names)))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Runs, total and mean per group; a group without values has mean 0."""
    return df.groupBy(*by).agg(F.count(value).alias("runs"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
