"""Saving and loading tables with their indexes as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tablespan.functions.text import NORM_SUFFIX, with_normalised
from tablespan.operators import index
from tablespan.plans.stages import with_positions
from tablespan.schema import TableSchema

INDEXES = ("dictionary", "postings", "order")


def from_rows(spark: SparkSession, rows: list, schema: TableSchema) -> DataFrame:
    """A frame from local rows under a declared schema."""
    return spark.createDataFrame(rows, schema.struct)


def with_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Add a dense 0-based row id by the given, unique order: files have no row positions of their own."""
    return with_positions(df, [df[c].asc_nulls_last() for c in order], name)


def save(df: DataFrame, path: str, key: str, normalise: list[str] | None = None, indexed: list[str] | None = None, mode: str = "errorifexists", ordered: list[str] | None = None) -> None:
    """Write the rows, with normalised columns for pushed-down filters, and index tables and sort indexes for the named columns."""
    with_normalised(df, normalise or []).write.mode(mode).parquet(f"{path}/rows")
    for name in indexed or []:
        index.dictionary(df, name, key).write.mode(mode).parquet(f"{path}/dictionary/{name}")
        index.postings(df, name, key).repartitionByRange("key_lower", "row_id").sortWithinPartitions("key_lower", "row_id").write.mode(mode).parquet(f"{path}/postings/{name}")


    for name in ordered or []:
        index.sort_index(df, name, key).write.mode(mode).parquet(f"{path}/order/{name}")


def load(spark: SparkSession, path: str, schema: TableSchema | None = None, normalised: bool = False) -> DataFrame:
    """Read saved rows; with a schema they must fit it. Normalised columns are left out unless asked for."""
    df = spark.read.parquet(f"{path}/rows")
    plain = df.select(*(c for c in df.columns if not c.endswith(NORM_SUFFIX)))
    if schema is not None:
        schema.check(plain)
    return df if normalised else plain


def load_index(spark: SparkSession, path: str, kind: str, name: str) -> DataFrame:
    if kind not in INDEXES:
        raise ValueError(f"an index is one of {', '.join(INDEXES)}, not {kind}")
    return spark.read.parquet(f"{path}/{kind}/{name}")


def load_or_build_index(spark: SparkSession, path: str, kind: str, name: str, key: str) -> DataFrame:
    """A stored index, or one made from the saved rows where none was written."""
    try:
        return load_index(spark, path, kind, name)
    except AnalysisException:
        make = {"dictionary": index.dictionary, "postings": index.postings, "order": index.sort_index}[kind]
        return make(load(spark, path, normalised=True), name, key)


def preset_path(folder: str, rows: int, base: str | None = None) -> str:
    """Where a preset of so many rows lies."""
    if rows < 0:
        raise ValueError("a preset has no negative number of rows")
    return f"{folder.rstrip('/')}/{base or f'grid-{rows}'}"


def load_preset(spark: SparkSession, folder: str, rows: int, schema: TableSchema | None = None, base: str | None = None) -> DataFrame:
    """Load a preset and check its number of rows."""
    df = load(spark, preset_path(folder, rows, base), schema)
    if (found := df.count()) != rows:
        raise ValueError(f"the preset has {found} rows, not {rows}")
    return df
