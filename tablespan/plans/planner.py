"""The order of filter conjuncts, from needle lengths or from hits in a systematic sample."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablespan.functions.text import needle, normalised

#: Below this many rows sampling does not pay; a sample has at most SAMPLE rows.
SAMPLE_FROM, SAMPLE = 5000, 2048


def active(filters: Mapping[str, object]) -> dict[str, str]:
    """Normalised needles; blank ones are not active."""
    return {c: n for c, v in filters.items() if (n := needle(v))}


def by_length(filters: Mapping[str, str]) -> list[str]:
    """Columns by needle length, longest first; ties stay in the given order."""
    return sorted(filters, key=lambda c: -len(filters[c]))


def systematic_sample(df: DataFrame, key: str, rows: int, size: int = SAMPLE) -> DataFrame:
    """At most ``size`` rows at the midpoints of equal stretches of a dense 0-based key."""
    k = min(size, rows)
    if k == 0 or k == rows:
        return df
    # row r is a midpoint floor((i + 0.5) * rows / k) of some i
    i = F.ceil((F.col(key) * 2 * k - rows) / F.lit(2.0 * rows)).cast("long")
    middle = F.floor((2 * i + 1) * F.lit(rows) / F.lit(2.0 * k)).cast("long")
    return df.where((i >= 0) & (i < k) & (middle == F.col(key)))


def sample_hits(df: DataFrame, filters: Mapping[str, object], key: str, rows: int, size: int = SAMPLE) -> DataFrame:
    """(column_name, hits) of each active filter over a systematic sample: one aggregate job."""
    chosen = active(filters)
    sampled = systematic_sample(df, key, rows, size)
    hits = [F.struct(F.lit(c).alias("column_name"), F.coalesce(F.sum(F.when(F.contains(normalised(sampled, c), F.lit(n)), 1).otherwise(0)), F.lit(0)).cast("long").alias("hits")).alias(f"h{k}") for k, (c, n) in enumerate(chosen.items())]
    if not hits:
        return df.sparkSession.createDataFrame([], "column_name string, hits long")
    one = sampled.agg(*hits)
    return one.select(F.explode(F.array(*(F.col(f"h{k}") for k in range(len(hits))))).alias("h")).select("h.column_name", "h.hits")


def by_sample(df: DataFrame, filters: Mapping[str, object], key: str, rows: int) -> list[str]:
    """Columns by fewest sample hits, then longer needle, then given order; by length for small tables."""
    chosen = active(filters)
    if rows < SAMPLE_FROM or len(chosen) < 2:
        return by_length(chosen)
    hits = {r["column_name"]: r["hits"] for r in sample_hits(df, filters, key, rows).collect()}
    return sorted(chosen, key=lambda c: (hits[c], -len(chosen[c])))


def stricter(before: Mapping[str, object], after: Mapping[str, object]) -> bool:
    """Whether every row that passes ``after`` passes ``before``: each old needle starts the new one."""
    old, new = active(before), active(after)
    return bool(old) and old != new and all(c in new and new[c].startswith(n) for c, n in old.items())
