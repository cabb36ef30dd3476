"""Index tables as DataFrames: dictionaries, postings, ranks, and set operations on row ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablespan.functions.text import normalised
from tablespan.operators.sorting import ordering
from tablespan.plans.stages import with_positions

#: A column is worth a dictionary up to this many distinct values and this share of the rows.
MAX_VALUES, MAX_SHARE = 65_535, 0.2


def dictionary(df: DataFrame, name: str, key: str) -> DataFrame:
    """(column_name, key_lower, value_id, value, first_row): distinct values by first appearance.

    Values that differ by case only are one entry; it shows the first of them.
    """
    text = normalised(df, name)
    firsts = df.where(text.isNotNull()).groupBy(text.alias("key_lower")).agg(F.min_by(name, key).alias("value"), F.min(key).alias("first_row"))
    return with_positions(firsts, [F.col("first_row")], "value_id").select(F.lit(name).alias("column_name"), "key_lower", "value_id", "value", "first_row")


def distinct_keys(df: DataFrame, name: str) -> DataFrame:
    """(column_name, key_lower): the distinct cell texts, without ids or order, for searches."""
    return df.select(F.lit(name).alias("column_name"), normalised(df, name).alias("key_lower")).where("key_lower is not null").distinct()


def sort_index(df: DataFrame, name: str, key: str) -> DataFrame:
    """(key, rank): dense ranks from 0 in the sort order of the column; descending is the same ranks from the top."""
    values = with_positions(df.select(F.col(name).alias("_value")).distinct(), ordering(df.select(F.col(name).alias("_value")), ["_value"], []), "rank")
    return df.select(key, F.col(name).alias("_own")).join(values, F.col("_own").eqNullSafe(F.col("_value"))).select(key, "rank")


def dictionary_stats(df: DataFrame, names: list[str], key: str) -> DataFrame:
    """(column_name, n_rows, n_values, share, choice): whether a dictionary pays, for each column; one pass."""
    counts = [F.countDistinct(normalised(df, n)).alias(f"v{k}") for k, n in enumerate(names)]
    one = df.agg(F.count("*").alias("n_rows"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"v{k}").alias("n_values")) for k, n in enumerate(names))))
    shaped = one.select("n_rows", rows.alias("r")).select("r.column_name", "n_rows", "r.n_values")
    share = F.when(F.col("n_rows") > 0, F.col("n_values") / F.col("n_rows")).otherwise(0.0)
    kinds = {f.name for f in df.schema if f.dataType.simpleString() == "string"}
    text = F.col("column_name").isin(*kinds) if kinds else F.lit(False)
    choice = F.when(F.col("n_values") > MAX_VALUES, "plain").when(share <= MAX_SHARE, "compact").when(text, "wide").otherwise("plain")
    return shaped.withColumn("share", share).withColumn("choice", choice)


def postings(df: DataFrame, name: str, key: str) -> DataFrame:
    """(column_name, key_lower, row_id): the inverted index, one row per posting, so that no key is gathered."""
    text = normalised(df, name)
    return df.where(text.isNotNull()).select(F.lit(name).alias("column_name"), text.alias("key_lower"), F.col(key).alias("row_id"))


def posting_lengths(index: DataFrame) -> DataFrame:
    """(column_name, key_lower, n_rows, first_row, last_row)."""
    return index.groupBy("column_name", "key_lower").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


def matching_rows(index: DataFrame, text: str) -> DataFrame:
    """(row_id) of every key that holds a normalised needle: the union of their postings."""
    return index.where(F.contains("key_lower", F.lit(text))).select("row_id")


def matched_keys(index: DataFrame, text: str) -> DataFrame:
    """(n_keys): how many distinct keys hold the needle."""
    return index.where(F.contains("key_lower", F.lit(text))).agg(F.countDistinct("column_name", "key_lower").alias("n_keys"))


def intersect(parts: list[DataFrame]) -> DataFrame:
    """Row ids that are in every part."""
    return reduce(lambda a, b: a.join(b, "row_id", "left_semi"), parts).distinct()


def union(parts: list[DataFrame]) -> DataFrame:
    """Row ids that are in any part, once each."""
    return reduce(DataFrame.unionByName, parts).distinct()


def gather(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of the given ids."""
    return df.join(ids.select(F.col("row_id").alias(key)), key, "left_semi")


def encode(df: DataFrame, name: str, values: DataFrame, key: str) -> DataFrame:
    """(key, value_id): the column as dictionary ids; null stays null."""
    keys = values.select(F.col("key_lower").alias("_key"), "value_id")
    return df.select(key, normalised(df, name).alias("_text")).join(keys, F.col("_text") == F.col("_key"), "left").select(key, "value_id")


def decode(encoded: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, value): dictionary ids as values again."""
    return encoded.join(values.select("value_id", "value"), "value_id", "left").select(key, "value")


def dense_ranks(df: DataFrame, name: str, key: str, case_sensitive: bool = True) -> DataFrame:
    """(key, rank_asc, rank_desc) from 0: the distinct values are ranked and joined back.

    So the global order is over distinct values, in ranges, and never in one
    partition. Without case sensitivity values that differ by case share a rank.
    Null ranks last ascending.
    """
    value = F.lower(name) if not case_sensitive else F.col(name)
    values = with_positions(df.select(value.alias("_value")).distinct(), [F.col("_value").asc_nulls_last()], "rank_asc")
    top = values.agg(F.max("rank_asc")).first()[0]
    ranked = values.withColumn("rank_desc", F.lit(top).cast("long") - F.col("rank_asc"))
    rows = df.select(key, value.alias("_own"))
    return rows.join(ranked, F.col("_own").eqNullSafe(F.col("_value"))).select(key, "rank_asc", "rank_desc")


def rank_columns(df: DataFrame, names: list[str], key: str) -> DataFrame:
    """(key, column_name, rank_asc, rank_desc) for several columns, each ranked over its own distinct values."""
    return reduce(DataFrame.unionByName, (dense_ranks(df, n, key).select(key, F.lit(n).alias("column_name"), "rank_asc", "rank_desc") for n in names))


def row_numbers(df: DataFrame, name: str, key: str) -> DataFrame:
    """(key, pos): the sorted index of a column, ascending, ties by key."""
    return with_positions(df.select(key, name), ordering(df, [name], [key], case_sensitive=True)).select(key, "pos")


def order_by_ranks(ranked: DataFrame, ranks: list[tuple[str, str]], key: str) -> DataFrame:
    """(key, pos): positions by a tuple of rank columns instead of the values themselves."""
    order = [F.col(c).asc() if direction == "asc" else F.col(c).desc() for c, direction in ranks]
    return with_positions(ranked, [*order, F.col(key)]).select(key, "pos")
