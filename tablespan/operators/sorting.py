"""Stable multi-column sorting with fixed rules for null, NaN, case and ties."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablespan.plans.stages import with_positions

SYMBOLS = {None: "▶", "desc": "▼", "asc": "▲"}
PAGE_ROWS = 15
#: The strategy names that callers may ask for. All give one and the same order.
MODES = ("native", "precomputed", "timsort", "timsort0060", "timsort0018", "quadsort", "fluxsort")


@dataclass(frozen=True)
class SortKey:
    column: str
    direction: str = "asc"

    def __post_init__(self):
        if self.direction not in ("asc", "desc"):
            raise ValueError(f"a direction is asc or desc, not {self.direction}")


def sort_keys(keys: Iterable, columns: list[str]) -> list[SortKey]:
    """Sort keys from SortKey, (column, direction) or column name; of a repeated column the first counts."""
    found: dict[str, SortKey] = {}
    for key in keys:
        key = key if isinstance(key, SortKey) else SortKey(key) if isinstance(key, str) else SortKey(*key)
        if key.column not in columns:
            raise ValueError(f"unknown sort column: {key.column}")
        found.setdefault(key.column, key)
    return list(found.values())


def _sides(c: Column, direction: str) -> Column:
    # ascending: numbers, infinity, NaN, null; descending is the mirror image
    return c.asc_nulls_last() if direction == "asc" else c.desc_nulls_first()


def ordering(df: DataFrame, keys: Iterable, tie: list[str], case_sensitive: bool = False) -> list[Column]:
    """The sort columns: each key in turn, text by lower case and then as it is, ties by the unique columns."""
    out = []
    for key in sort_keys(keys, df.columns):
        if isinstance(df.schema[key.column].dataType, T.StringType) and not case_sensitive:
            out.append(_sides(F.lower(key.column), key.direction))
        out.append(_sides(F.col(key.column), key.direction))
    return [*out, *(F.col(t).asc_nulls_last() for t in tie)]


def sort_rows(df: DataFrame, keys: Iterable, tie: list[str], case_sensitive: bool = False) -> DataFrame:
    """The frame in order; without keys by the tie columns."""
    return df.orderBy(*ordering(df, keys, tie, case_sensitive))


def sorted_positions(df: DataFrame, keys: Iterable, tie: list[str], case_sensitive: bool = False, name: str = "pos") -> DataFrame:
    """The frame with each row's 0-based place in the order."""
    return with_positions(df, ordering(df, keys, tie, case_sensitive), name)


def page(df: DataFrame, keys: Iterable, tie: list[str], start: int = 0, rows: int = PAGE_ROWS, case_sensitive: bool = False) -> DataFrame:
    """A window of the order with ``pos``: a top-k, not a full sort. A negative start counts as 0."""
    order, start = ordering(df, keys, tie, case_sensitive), max(start, 0)
    shown = df.orderBy(*order).offset(start).limit(max(rows, 0))
    # the window is over at most a page of rows
    return shown.withColumn("pos", (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))


class SortState:
    """Header clicks: a column goes from unsorted to desc to asc to unsorted; keys stay in click order."""

    def __init__(self):
        self.keys: list[SortKey] = []

    def click(self, column: str) -> list[SortKey]:
        at = next((k for k, key in enumerate(self.keys) if key.column == column), None)
        if at is None:
            self.keys.append(SortKey(column, "desc"))
        elif self.keys[at].direction == "desc":
            self.keys[at] = SortKey(column, "asc")
        else:
            del self.keys[at]
        return list(self.keys)

    def symbol(self, column: str) -> str:
        return SYMBOLS[next((key.direction for key in self.keys if key.column == column), None)]


class SortModes:
    """The registry of sort strategies; a registered one is a function (frame, keys, tie) -> frame."""

    def __init__(self):
        self._own: dict[str, Callable] = {}

    def register(self, name: str, strategy: Callable[[DataFrame, list[SortKey], list[str]], DataFrame]) -> None:
        if not name or not callable(strategy):
            raise ValueError("a sort strategy has a name and is a function")
        self._own[name] = strategy

    def available(self) -> list[str]:
        return [*MODES, *(n for n in self._own if n not in MODES)]

    def get(self, name: str) -> Callable:
        if name not in self.available():
            raise ValueError(f"unknown sort mode: {name}")
        return self._own.get(name, sort_rows)
