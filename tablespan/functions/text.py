"""Text rules shared by filters and indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space that is trimmed from needles.
NEEDLE_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NORM_SUFFIX = "_norm"


def needle(value: object) -> str:
    """A filter value as it is searched for: text, trimmed, lower case; None is empty."""
    return "" if value is None else str(value).strip(NEEDLE_SPACE).lower()


def double_text(c: Column) -> Column:
    """A double as text: 20 for 20.0, plain digits from 1e-6 up to 1e21, e+21 beyond."""
    plain = F.regexp_replace(c.cast("string"), r"\.0$", "")
    size = F.abs(c)
    large = F.regexp_replace(c.cast("decimal(38,10)").cast("string"), r"\.?0+$", "")
    small = F.regexp_replace(c.cast("decimal(38,30)").cast("string"), r"0+$", "")
    beyond = F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"\.0e", "e"), r"e(\d)", "e+$1")
    return (
        F.when(F.isnan(c) | (size == float("inf")) | (size == 0.0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when((size >= 1e7) & (size < 1e21), large)
        .when((size >= 1e-6) & (size < 1e-3), small)
        .otherwise(beyond)
    )


def cell_text(df: DataFrame, name: str) -> Column:
    """The text of a column's cells; null stays null. Nested and binary columns have none."""
    kind, c = df.schema[name].dataType, df[name]
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return double_text(c.cast("double"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
        raise ValueError(f"column {name} of type {kind.simpleString()} has no cell text")
    return c.cast("string")


def normalised(df: DataFrame, name: str) -> Column:
    """Lower-case cell text; a stored ``<name>_norm`` column is used as it is, so that filters reach the scan."""
    stored = name + NORM_SUFFIX
    return df[stored] if stored in df.columns else F.lower(cell_text(df, name))


def with_normalised(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Add a ``<name>_norm`` column for each named column (default: all that have cell text)."""
    chosen = names if names is not None else [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    return df.withColumns({n + NORM_SUFFIX: F.lower(cell_text(df, n)) for n in chosen if n + NORM_SUFFIX not in df.columns})


def display(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns as shown in a grid: text, null as the empty string."""
    return df.select(*(F.coalesce(cell_text(df, n), F.lit("")).alias(n) for n in names))


def number_of(c: Column) -> Column:
    """Text to number; what is no number becomes null."""
    return c.try_cast("double")
