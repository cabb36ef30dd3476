"""The fifteen-column grid and checks of a frame against a schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The grid's columns in order; the first is 1-based and unique.
GRID = ("index", "firstName", "lastName", "age", *(f"column{n}" for n in range(5, 16)))
TEXT_COLUMNS = ("firstName", "lastName")


def grid_schema() -> T.StructType:
    """Row id, then the grid's columns."""
    kinds = {"firstName": T.StringType(), "lastName": T.StringType(), "age": T.IntegerType()}
    return T.StructType([T.StructField("row_id", T.LongType()), *(T.StructField(n, kinds.get(n, T.LongType())) for n in GRID)])


def sort_types(df: DataFrame) -> dict[str, str]:
    """string or number for each column."""
    return {f.name: "string" if isinstance(f.dataType, T.StringType) else "number" for f in df.schema}


@dataclass(frozen=True)
class TableSchema:
    """A table's columns and the column that identifies a row."""

    struct: T.StructType
    key: str

    @classmethod
    def of(cls, df: DataFrame, key: str) -> TableSchema:
        if key not in df.columns:
            raise ValueError(f"no key column {key}")
        return cls(df.schema, key)

    def check(self, df: DataFrame) -> None:
        """Raise unless the frame has these columns, by name and type, in this order."""
        want, have = ([(f.name, f.dataType.simpleString()) for f in s] for s in (self.struct, df.schema))
        if len(want) != len(have):
            raise ValueError(f"expected {len(want)} columns, found {len(have)}")
        for w, h in zip(want, have):
            if w != h:
                raise ValueError(f"expected column {w[0]} of type {w[1]}, found {h[0]} of type {h[1]}")
