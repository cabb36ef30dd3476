"""Cutting a plan at a written stage, and dense positions over a global order."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint into spark.checkpoint.dir; a folder of our own only in local mode, as in tests, where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint(eager=True)


def with_positions(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Number rows from 0 in the given order without gathering them in one partition.

    The sort is by ranges. Each range numbers its own rows; the counts of the
    ranges, one row a partition, give the offsets and are broadcast.
    """
    ordered = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + inside).drop("_at", "_part", "_offset")
