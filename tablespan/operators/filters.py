"""Substring filters: case-insensitive, literal, combined with AND, compiled to one predicate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablespan.functions.text import normalised
from tablespan.plans.planner import active, by_length


def check_columns(df: DataFrame, names, on_unknown: str = "raise") -> list[str]:
    """The names that exist; others raise, or are dropped with on_unknown="ignore"."""
    if on_unknown not in ("raise", "ignore"):
        raise ValueError(f"on_unknown is raise or ignore, not {on_unknown}")
    unknown = [n for n in names if n not in df.columns]
    if unknown and on_unknown == "raise":
        raise ValueError(f"unknown columns: {', '.join(map(str, unknown))}")
    return [n for n in names if n in df.columns]


def matches(df: DataFrame, name: str, text: str) -> Column:
    """Whether a column's cell text holds an already normalised needle; null holds none."""
    return F.contains(normalised(df, name), F.lit(text))


def predicate(df: DataFrame, filters: Mapping[str, object], order: list[str] | None = None, on_unknown: str = "raise") -> Column | None:
    """All active filters as one column, longest needle first or in the given order; None if none is active."""
    chosen = active(filters)
    known = check_columns(df, chosen, on_unknown)
    chosen = {c: chosen[c] for c in known}
    names = [c for c in (order or by_length(chosen)) if c in chosen]
    return reduce(lambda a, b: a & b, (matches(df, c, chosen[c]) for c in names)) if names else None


def filter_rows(df: DataFrame, filters: Mapping[str, object], order: list[str] | None = None, on_unknown: str = "raise") -> DataFrame:
    """The rows that pass every filter; without an active filter the frame itself."""
    found = predicate(df, filters, order, on_unknown)
    return df if found is None else df.where(found)


def filter_within(df: DataFrame, base: DataFrame, key: str, filters: Mapping[str, object]) -> DataFrame:
    """The rows that pass the filters and whose key is in ``base``."""
    return filter_rows(df, filters).join(base.select(key), key, "left_semi")


def search_keys(dictionary: DataFrame, name: str, text: str) -> DataFrame:
    """The dictionary's keys of a column that hold a normalised needle."""
    return dictionary.where((F.col("column_name") == name) & F.contains("key_lower", F.lit(text)))


def filter_by_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose cell is one of the keys; Spark broadcasts them only if they turn out small."""
    return df.join(keys.select(F.col("key_lower").alias("_key")), normalised(df, name) == F.col("_key"), "left_semi")


def filter_by_dictionary(df: DataFrame, dictionary: DataFrame, name: str, text: object) -> DataFrame:
    """Search the distinct values, then keep the rows of those that match: a semi join on the value."""
    wanted = active({name: text})
    return filter_by_keys(df, search_keys(dictionary, name, wanted[name]), name) if wanted else df
