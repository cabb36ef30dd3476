"""Filter and sort benchmarks with percentiles."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from tablespan.engine import EngineOptions, TableEngine

#: The needles of the filter benchmark and the key lists of the sort benchmark.
NUMBER_NEEDLES = ("50", "1", "99", "255", "6000")
FILTER_CASES = {
    **dict.fromkeys(("index", "column5", "column6", "column7", "column8"), NUMBER_NEEDLES),
    "age": ("18", "99", "40", "50", "69"),
    "firstName": ("andr", "a", "phani", "ab", "olet"),
    "lastName": ("i", "y", "lli", "righ", "derson"),
}
SORT_CASES = (
    *((c,) for c in ("index", "column5", "column6", "column7", "column8", "column9", "column10", "age", "firstName", "lastName")),
    ("firstName", "lastName"), ("lastName", "firstName"), ("age", "lastName"),
)


def percentile(values: list[float], p: float) -> float:
    """The p-th fraction by linear interpolation; 0 without values."""
    if not values:
        return 0.0
    ordered, at = sorted(values), p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


@dataclass
class BenchResult:
    lines: list[str] = field(default_factory=list)
    totals: dict[str, dict[str, float]] = field(default_factory=dict)
    seconds: float = 0.0
    error: str | None = None


def _totals(times: list[float]) -> dict[str, float]:
    return {"runs": len(times), "mean": sum(times) / len(times) if times else 0.0, **{f"p{round(100 * p)}": percentile(times, p) for p in (0.5, 0.75, 0.95)}}


def option_combinations() -> list[EngineOptions]:
    """The 48 settings of four layouts, stored text, dictionary use and sample planner."""
    layouts = [(True, True, False), (True, False, False), (False, False, True), (False, False, False)]
    dictionary = [(False, False), (True, False), (True, True)]
    return [EngineOptions(c, b, n, text, search, both, sample) for (c, b, n), text, (search, both), sample in itertools.product(layouts, (True, False), dictionary, (True, False))]


def _run(engine: TableEngine, name: str, rounds: int, work: Callable[[BenchResult], None]) -> BenchResult:
    if not engine.has_data:
        raise ValueError("no table is loaded")
    if rounds < 1:
        raise ValueError("a benchmark has at least one round")
    result, saved, began = BenchResult([f"{name} benchmark: {rounds} rounds"]), engine.state(), time.perf_counter()
    try:
        work(result)
    except Exception as error:  # a failed run is part of the report
        result.error = str(error)
    finally:
        engine.restore({k: saved[k] for k in ("options", "filters", "sort_mode", "sort_options")})
    result.seconds = time.perf_counter() - began
    result.lines += [f"{k}: " + ", ".join(f"{n} {v:.4g}" for n, v in t.items()) for k, t in result.totals.items()]
    result.lines.append(f"{name} benchmark: {'failed: ' + result.error if result.error else 'done'}")
    return result


def run_filter(engine: TableEngine, rounds: int = 3, combinations: list[EngineOptions] | None = None, cases: dict[str, tuple[str, ...]] | None = None) -> BenchResult:
    """Time each case as a count, per option combination; reuse and result cache are off meanwhile."""

    def work(result: BenchResult) -> None:
        for options in combinations or [engine.options]:
            engine.set_options(**asdict(options) | {"reuse_previous": False, "result_cache": False})
            times = []
            for _, (column, needles) in itertools.product(range(rounds), (cases or FILTER_CASES).items()):
                for text in needles:
                    began = time.perf_counter()
                    engine.filter({column: text}).count()
                    times.append(time.perf_counter() - began)
            result.totals[engine.options.layout + "".join(f" +{k}" for k in ("normalised", "dictionary_search", "dictionary_intersection", "sample_planner") if getattr(engine.options, k))] = _totals(times)

    return _run(engine, "filtering", rounds, work)


def run_sort(engine: TableEngine, rounds: int = 3, modes: tuple[str, ...] = ("native",), cases: tuple[tuple[str, ...], ...] = SORT_CASES, page_rows: int = 15) -> BenchResult:
    """Time the first page of each case in both directions over the whole table; set filters are ignored."""

    def work(result: BenchResult) -> None:
        for mode in modes:
            engine.set_sort_mode(mode)
            times = []
            for _, case, direction in itertools.product(range(rounds), cases, ("desc", "asc")):
                began = time.perf_counter()
                engine.sort([(c, direction) for c in case]).df.limit(page_rows).collect()
                times.append(time.perf_counter() - began)
            result.totals[mode] = _totals(times)

    return _run(engine, "sort", rounds, work)
