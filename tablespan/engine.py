"""TableEngine: one table, its filters, its order and its pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tablespan.functions.text import NORM_SUFFIX, display
from tablespan.operators import index
from tablespan.operators.filters import check_columns, filter_by_keys, filter_rows, filter_within, search_keys
from tablespan.operators.sorting import PAGE_ROWS, SortKey, SortModes, ordering, page, sort_keys
from tablespan.plans import planner
from tablespan.plans.cache import ResultCache
from tablespan.plans.stages import stage, with_positions
from tablespan.schema import TableSchema
from tablespan.sources import generate, tables


@dataclass(frozen=True)
class EngineOptions:
    """Switches of layout and acceleration. None of them changes an answer.

    The layouts are accepted by name and reported; Spark has one columnar layout.
    ``normalised`` uses stored lower-case columns, ``dictionary_search`` the
    dictionaries of a saved table, and ``dictionary_intersection`` does so for
    several filters at once.
    """

    columnar: bool = True
    binary: bool = True
    numeric: bool = True
    normalised: bool = True
    dictionary_search: bool = True
    dictionary_intersection: bool = True
    sample_planner: bool = True
    reuse_previous: bool = False
    result_cache: bool = False

    def settled(self) -> EngineOptions:
        """Combinations that make no sense fall back: binary needs columnar, rows exclude it, intersection needs search."""
        return replace(self, binary=self.binary and self.columnar, numeric=self.numeric and not self.columnar, dictionary_intersection=self.dictionary_intersection and self.dictionary_search)

    @property
    def layout(self) -> str:
        if self.columnar:
            return "numeric-columnar" if self.binary else "object-columnar"
        return "numeric-rows" if self.numeric else "object-rows"


@dataclass
class FilterResult:
    df: DataFrame
    layout: str
    active: dict[str, str]
    seconds: float
    no_data: bool = False
    cache_event: str | None = None
    _count: int | None = None

    def count(self) -> int:
        """The number of rows; counted when first asked for."""
        if self._count is None:
            self._count = self.df.count()
        return self._count


@dataclass
class SortResult:
    df: DataFrame
    keys: list[SortKey]
    requested_mode: str
    used_mode: str
    seconds: float
    order: list = field(default_factory=list)
    key: str = "row_id"
    ranked: DataFrame | None = None  # the rows with the ranks that ``order`` is by

    def with_positions(self, columns: list[str] | None = None) -> DataFrame:
        """The rows with pos; only the named columns, of which no others but the keys are then moved."""
        source, keep = self.df if self.ranked is None else self.ranked, self.df.columns if columns is None else columns
        sorts = [k.column for k in self.keys] if self.ranked is None else [c for c in source.columns if c not in self.df.columns]
        return with_positions(source.select(*dict.fromkeys([*keep, *sorts, self.key])), self.order).select(*keep, "pos")

    def count(self) -> int:
        return self.df.count()


class TableEngine:
    """A table with a unique key column. Actions run only on count, page, positions or a cache insert."""

    def __init__(self, spark: SparkSession, options: EngineOptions | None = None, cache: ResultCache | None = None, clock: Callable[[], float] = time.perf_counter):
        self.spark, self.cache, self.modes, self._clock = spark, cache or ResultCache(), SortModes(), clock
        self.options = (options or EngineOptions()).settled()
        self.filters: dict[str, object] = {}
        self.sort_mode = "native"
        self.sort_options = {"typed_comparator": True, "index_sort": True}
        self.busy, self.last_action, self.last_error, self.last_result = False, None, None, None
        self._df: DataFrame | None = None
        self._key = "row_id"
        self._rows: int | None = None
        self._previous: tuple[dict[str, object], DataFrame] | None = None
        self._ranks: dict[str, DataFrame] = {}
        self._orders: dict[str, DataFrame] = {}
        self._saved: str | None = None
        self._matched: dict[str, tuple[str, DataFrame]] = {}
        self._listeners: list[Callable[[dict], None]] = []

    # data

    def load(self, df: DataFrame, key: str = "row_id") -> TableEngine:
        """Take a frame; results of earlier data are dropped."""
        self._schema = TableSchema.of(df, key)
        self._df, self._key, self._rows, self._previous, self._ranks, self._orders, self._saved = df, key, None, None, {}, {}, None
        self._forget_keys()
        self.cache.invalidate()
        self._tell("load")
        return self

    def load_saved(self, path: str, key: str = "row_id") -> TableEngine:
        """Take a saved table with its normalised columns, dictionaries and sort indexes; an index that is missing is made when first used."""
        self.load(tables.load(self.spark, path, normalised=True), key)
        self._saved = path
        return self

    def _forget_keys(self) -> None:
        for _, keys in self._matched.values():
            keys.unpersist()
        self._matched = {}

    def generate(self, rows: int, seed: int = 0, partitions: int | None = None) -> TableEngine:
        return self.load(generate.random_table(self.spark, rows, seed, partitions))

    @property
    def has_data(self) -> bool:
        return self._df is not None

    @property
    def schema(self) -> TableSchema:
        self._need()
        return self._schema

    @property
    def df(self) -> DataFrame:
        return self._need()

    def row_count(self) -> int:
        if self._rows is None:
            self._rows = self._need().count() if self.has_data else 0
        return self._rows

    def _need(self) -> DataFrame:
        if self._df is None:
            raise ValueError("no table is loaded")
        return self._df

    # state

    def set_options(self, **changes: bool) -> EngineOptions:
        self.options = replace(self.options, **changes).settled()
        self._previous = None
        self._forget_keys()
        self._tell("options")
        return self.options

    def set_filters(self, filters: Mapping[str, object]) -> None:
        """Remember filters as typed; blank ones are dropped."""
        self.filters = {c: v for c, v in filters.items() if v is not None and str(v).strip()}
        self._tell("filters")

    def set_filter(self, column: str, value: object) -> None:
        self.set_filters({**self.filters, column: value})

    def clear_filters(self) -> None:
        self.set_filters({})

    def set_sort_mode(self, name: str, strict: bool = True) -> str:
        """Choose a strategy by name; an unknown one raises, or is ignored without ``strict``."""
        if name in self.modes.available():
            self.sort_mode = name
        elif strict:
            raise ValueError(f"unknown sort mode: {name}")
        return self.sort_mode

    def state(self) -> dict:
        return {"busy": self.busy, "rows": self._rows, "options": asdict(self.options), "filters": dict(self.filters), "sort_mode": self.sort_mode, "sort_options": dict(self.sort_options), "last_action": self.last_action, "last_error": self.last_error}

    def restore(self, patch: Mapping) -> None:
        """Put back options, filters, sort mode and sort options from an earlier state."""
        if "options" in patch:
            self.options = EngineOptions(**patch["options"]).settled()
        if "filters" in patch:
            self.filters = dict(patch["filters"])
        if "sort_mode" in patch:
            self.set_sort_mode(patch["sort_mode"], strict=False)
        if "sort_options" in patch:
            self.sort_options |= patch["sort_options"]
        self._tell("restore")

    def listen(self, listener: Callable[[dict], None]) -> Callable[[], None]:
        """Call the listener after each change; returns a function that ends it."""
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener) if listener in self._listeners else None

    def _tell(self, action: str | None = None) -> None:
        self.last_action = action or self.last_action
        for listener in list(self._listeners):
            listener(self.state())

    def _act(self, name: str, run: Callable):
        self.busy, self.last_error = True, None
        self._tell(name)
        try:
            self.last_result = run()
            return self.last_result
        except Exception as error:
            self.last_error = str(error)
            raise
        finally:
            self.busy = False
            self._tell()

    # filter

    def filter(self, filters: Mapping[str, object] | None = None, base: DataFrame | None = None, on_unknown: str = "raise") -> FilterResult:
        """The rows that pass the filters (default: those set), within ``base`` if given."""
        return self._act("filter", lambda: self._filter(self.filters if filters is None else filters, base, on_unknown))

    def filter_one(self, column: str, value: object) -> FilterResult:
        """One filter alone; what later filters may build on stays as it was."""
        kept = self._previous
        try:
            return self.filter({column: value})
        finally:
            self._previous = kept

    def _filter(self, filters, base, on_unknown) -> FilterResult:
        began, layout, active = self._clock(), self.options.layout, planner.active(filters)
        if self._df is None:
            empty = self.spark.createDataFrame([], f"{self._key} long")
            return FilterResult(empty, layout, active, 0.0, no_data=True, _count=0)
        known = check_columns(self._df, active, on_unknown)
        active = {c: active[c] for c in known}
        if base is not None:
            return FilterResult(filter_within(self._df, base, self._key, active), layout, active, self._clock() - began)
        cache_key = (self.cache.revision, tuple(sorted(active.items())))
        if self.options.result_cache and (hit := self.cache.get(cache_key)):
            return FilterResult(hit[0], layout, active, self._clock() - began, cache_event="hit", _count=hit[1])
        source = self._df
        if not self.options.normalised:
            source = source.select(*(c for c in source.columns if not c.endswith(NORM_SUFFIX)))
        if self.options.reuse_previous and self._previous and planner.stricter(self._previous[0], active):
            source = self._previous[1]
        order = None
        if self.options.sample_planner and len(active) > 1 and self._key in source.columns and self._rows is not None and self._df.is_cached:
            order = planner.by_sample(self._df, active, self._key, self._rows)
        found, rest = source, active
        if self._saved and self.options.dictionary_search and (len(active) == 1 or self.options.dictionary_intersection):
            for name in [c for c in active if not c.endswith(NORM_SUFFIX) and isinstance(self._df.schema[c].dataType, StringType)]:
                found = filter_by_keys(found, self._keys(name, active[name]), name)
                rest = {c: n for c, n in rest.items() if c != name}
        found = filter_rows(found, rest, [c for c in order if c in rest] if order else None)
        self._previous = (active, found)
        event, count = None, None
        if self.options.result_cache and active:
            most = max(tier.rows for tier in self.cache.tiers)
            count = found.limit(most + 1).count()
            if count <= most:
                found = found.persist()
                event = self.cache.put(cache_key, found, count)
            else:
                count = None
        return FilterResult(found, layout, active, self._clock() - began, cache_event=event, _count=count)

    def _keys(self, name: str, text: str) -> DataFrame:
        """The dictionary keys that hold the needle; a longer needle searches only what the last one matched."""
        before = self._matched.get(name)
        if before and before[0] == text:
            return before[1]
        source = before[1] if before and text.startswith(before[0]) else tables.load_or_build_index(self.spark, self._saved, "dictionary", name, self._key)
        keys = search_keys(source, name, text).select("column_name", "key_lower").persist()
        self._matched[name] = text, keys
        return keys

    # sort

    def sort(self, keys: Iterable = (), base: DataFrame | None = None, mode: str | None = None, case_sensitive: bool = False) -> SortResult:
        """The table, or ``base``, in order. Ties and a missing order go by the key column."""
        return self._act("sort", lambda: self._sort(keys, base, mode, case_sensitive))

    def _sort(self, keys, base, mode, case_sensitive) -> SortResult:
        began, df = self._clock(), base if base is not None else self._need()
        if self._key not in df.columns:
            raise ValueError(f"the frame to sort has no {self._key}")
        chosen, mode = sort_keys(keys, df.columns), mode or self.sort_mode
        strategy = self.modes.get(mode)
        order = ordering(df, chosen, [self._key], case_sensitive)
        own = mode in self.modes._own
        if mode == "precomputed" and not own and not case_sensitive and chosen and all(k.column in self._orders or self._saved for k in chosen):
            return self._from_orders(df, chosen, began)
        done = strategy(df, chosen, [self._key]) if own else df.orderBy(*order)
        return SortResult(done, chosen, mode, mode if own else "spark", self._clock() - began, order, self._key)

    def _from_orders(self, df: DataFrame, chosen: list[SortKey], began: float) -> SortResult:
        """Sort by the ranks of stored sort indexes instead of the values."""
        columns, order = df.columns, []
        for k, sort_key in enumerate(chosen):
            ranks = self._order_of(sort_key.column).select(self._key, F.col("rank").alias(f"_r{k}"))
            df = df.join(ranks, self._key)
            order.append(F.col(f"_r{k}").asc() if sort_key.direction == "asc" else F.col(f"_r{k}").desc())
        order.append(F.col(self._key).asc_nulls_last())
        return SortResult(df.orderBy(*order).select(*columns), chosen, "precomputed", "precomputed", self._clock() - began, order, self._key, df)

    def _order_of(self, name: str) -> DataFrame:
        if name not in self._orders:
            self._orders[name] = tables.load_or_build_index(self.spark, self._saved, "order", name, self._key) if self._saved else stage(index.sort_index(self._need(), name, self._key))
        return self._orders[name]

    def filter_sort(self, filters: Mapping[str, object], keys: Iterable = (), case_sensitive: bool = False) -> SortResult:
        """One plan: the filter runs once, below the sort. No match gives an empty result."""
        return self.sort(keys, self.filter(filters).df, case_sensitive=case_sensitive)

    def page(self, start: int = 0, rows: int = PAGE_ROWS, filters: Mapping[str, object] | None = None, keys: Iterable = ()) -> DataFrame:
        """A page of the filtered order, with pos."""
        return page(self.filter(filters).df, keys, [self._key], start, rows)

    def shown(self, start: int = 0, rows: int = PAGE_ROWS, columns: list[str] | None = None, filters: Mapping[str, object] | None = None, keys: Iterable = ()) -> list[dict]:
        """A page as text, null as the empty string: the only call that brings rows to the driver."""
        found = page(self.filter(filters).df, keys, [self._key], start, rows).orderBy("pos")
        return [r.asDict() for r in display(found, columns or self._need().columns).collect()]

    def prewarm_sort(self, columns: list[str] | None = None) -> None:
        """Rank the named columns (default: all) now and keep the ranks; a second call does nothing."""
        for name in columns if columns is not None else self._need().columns:
            if name not in self._ranks:
                self._ranks[name] = stage(index.dense_ranks(self._need(), name, self._key))

    def prewarm_orders(self, columns: list[str]) -> None:
        """Make or read the sort indexes of the named columns now; ``precomputed`` sorts use them."""
        for name in columns:
            self._order_of(name)

    def sort_by_ranks(self, keys: Iterable) -> DataFrame:
        """(key, pos) from kept ranks; columns that are not ranked yet are ranked first."""
        chosen = sort_keys(keys, self._need().columns)
        self.prewarm_sort([k.column for k in chosen])
        ranked = self._need().select(self._key)
        for k, key in enumerate(chosen):
            ranked = ranked.join(self._ranks[key.column].select(self._key, F.col(f"rank_{key.direction}").alias(f"_r{k}")), self._key)
        return index.order_by_ranks(ranked, [(f"_r{k}", "asc") for k in range(len(chosen))], self._key)

    def reset_sort(self) -> None:
        self._ranks, self._orders = {}, {}
