import functools
import math

import pytest
from pyspark.sql import functions as F

from tablespan.engine import TableEngine
from tablespan.operators import index, sorting
from tablespan.operators.sorting import SortKey, SortModes, SortState
from tablespan.sources import generate


def positions(df, key="row_id"):
    rows = sorted(df.select(key, "pos").collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(len(rows)))
    return [r[key] for r in rows]


def compare(a, b):
    """Numbers, infinity, NaN, null ascending."""
    place = lambda v: (2, 0) if v is None else (1, 0) if isinstance(v, float) and math.isnan(v) else (0, v)
    a, b = place(a), place(b)
    return (a > b) - (a < b)


def brute(rows, keys):
    def order(x, y):
        for c, direction in keys:
            if d := compare(x[c], y[c]):
                return d if direction == "asc" else -d
        return compare(x["row_id"], y["row_id"])

    return [r["row_id"] for r in sorted(rows, key=functools.cmp_to_key(order))]


@pytest.mark.parametrize("keys", [[("firstName", "asc"), ("age", "desc"), ("column8", "asc")], [("firstName", "desc")], [("firstName", "desc"), ("lastName", "desc")], [("index", "desc")], []])
def test_sort_equals_brute_force(spark, keys):
    table = generate.fixed_table(spark, 1500)
    rows = [r.asDict() for r in table.collect()]
    assert positions(TableEngine(spark).load(table).sort(keys).with_positions()) == brute(rows, keys)


def test_null_nan_and_infinity(spark):
    values = [1.0, None, float("nan"), float("inf"), float("-inf"), 0.0, -3.5, None, float("nan"), 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, v double")
    rows = [{"row_id": i, "v": v} for i, v in enumerate(values)]
    for direction in ("asc", "desc"):
        assert positions(sorting.sorted_positions(df, [("v", direction)], ["row_id"])) == brute(rows, [("v", direction)])


def test_case_rules(spark):
    df = spark.createDataFrame([(0, "b"), (1, "A"), (2, "a"), (3, "B"), (4, "a")], "row_id long, s string")
    assert positions(sorting.sorted_positions(df, ["s"], ["row_id"])) == [1, 2, 4, 3, 0]
    assert positions(sorting.sorted_positions(df, ["s"], ["row_id"], case_sensitive=True)) == [1, 3, 2, 4, 0]


def test_code_point_order(spark):
    df = spark.createDataFrame([(0, "\U0001f600"), (1, "")], "row_id long, s string")
    assert positions(sorting.sorted_positions(df, ["s"], ["row_id"])) == [1, 0]


def test_repeated_key_counts_once(spark):
    assert sorting.sort_keys([("a", "desc"), ("a", "asc"), "b"], ["a", "b"]) == [SortKey("a", "desc"), SortKey("b")]
    with pytest.raises(ValueError):
        sorting.sort_keys(["c"], ["a"])
    with pytest.raises(ValueError):
        SortKey("a", "up")


def test_descending_distinct_key_is_the_reverse(spark):
    engine = TableEngine(spark).load(generate.fixed_table(spark, 300))
    up, down = (positions(engine.sort([("index", d)]).with_positions()) for d in ("asc", "desc"))
    assert up == down[::-1] and sorted(up) == list(range(300))


def test_pages_join_up_to_the_full_sort(spark):
    engine = TableEngine(spark).load(generate.fixed_table(spark, 50))
    keys = [("age", "desc"), "firstName"]
    full = positions(engine.sort(keys).with_positions())
    paged = [r["row_id"] for start in range(0, 60, 15) for r in sorted(engine.page(start, keys=keys).collect(), key=lambda r: r["pos"])]
    assert paged == full
    assert [r["pos"] for r in engine.page(45, keys=keys).orderBy("pos").collect()] == list(range(45, 50))
    assert engine.page(-5, 3, keys=keys).count() == 3 and engine.page(1000).count() == 0


def test_page_is_a_top_k(spark):
    plan = sorting.page(generate.fixed_table(spark, 100), ["age"], ["row_id"], 10)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_shown_cells_are_text(spark):
    df = spark.createDataFrame([(0, None, 2.0), (1, "x", None)], "row_id long, s string, d double")
    assert TableEngine(spark).load(df).shown(columns=["s", "d"]) == [{"s": "", "d": "2"}, {"s": "x", "d": ""}]


def test_zero_matches_sort_to_nothing(spark):
    done = TableEngine(spark).load(generate.fixed_table(spark, 30)).filter_sort({"firstName": "zzz"}, ["age"])
    assert done.count() == 0 and done.with_positions().count() == 0


def test_ranks_sort_like_values(spark):
    engine = TableEngine(spark).load(generate.fixed_table(spark, 400))
    keys = [("firstName", "desc"), ("age", "asc")]
    assert positions(engine.sort_by_ranks(keys)) == positions(engine.sort(keys, case_sensitive=True).with_positions())
    engine.reset_sort()
    assert engine._ranks == {}


def test_dense_ranks(spark):
    df = spark.createDataFrame([(0, 5), (1, 3), (2, 5), (3, None), (4, 9)], "row_id long, v int")
    rows = {r["row_id"]: (r["rank_asc"], r["rank_desc"]) for r in index.dense_ranks(df, "v", "row_id").collect()}
    assert rows == {1: (0, 3), 0: (1, 2), 2: (1, 2), 4: (2, 1), 3: (3, 0)}


def test_positions_need_no_single_partition(spark):
    df = generate.fixed_table(spark, 1000, 8)
    assert positions(sorting.sorted_positions(df, [("column9", "desc")], ["row_id"])) == [r["row_id"] for r in df.orderBy(F.desc("column9"), "row_id").collect()]


def test_stored_ranks_sort_like_values(spark, tmp_path):
    from tablespan.sources import tables

    df = spark.createDataFrame([(0, "b", 1.0), (1, "B", None), (2, None, float("nan")), (3, "a", 2.0), (4, "b", 2.0), (5, "A", float("inf"))], "row_id long, s string, d double")
    path = str(tmp_path / "t")
    tables.save(df, path, "row_id", ordered=["s"])  # the sort index of d is made when it is first used
    engine = TableEngine(spark).load_saved(path)
    for keys in ([("s", "desc")], ["s"], ["d"], [("d", "desc"), "s"], ["s", ("d", "desc")]):
        done = engine.sort(keys, mode="precomputed")
        assert done.used_mode == "precomputed" and "_r0" in done.ranked.columns
        want = positions(engine.sort(keys).with_positions())
        assert positions(done.with_positions()) == want == [r["row_id"] for r in done.df.collect()]
        assert done.with_positions(["s"]).columns == ["s", "pos"]
    engine.reset_sort()
    assert engine._orders == {}
    plain = TableEngine(spark).load(df)
    assert plain.sort(["s"], mode="precomputed").used_mode == "spark"
    plain.prewarm_orders(["s"])
    assert positions(plain.sort([("s", "desc")], mode="precomputed").with_positions()) == positions(plain.sort([("s", "desc")]).with_positions())


def test_header_clicks():
    state = SortState()
    state.click("a")
    state.click("b")
    assert state.click("a") == [SortKey("a", "asc"), SortKey("b", "desc")]
    assert state.symbol("a") == "▲" and state.symbol("b") == "▼" and state.symbol("c") == "▶"
    assert state.click("a") == [SortKey("b", "desc")]


def test_modes(spark):
    modes = SortModes()
    modes.register("mine", lambda df, keys, tie: df.orderBy(F.desc("index")))
    assert "mine" in modes.available() and "timsort" in modes.available()
    with pytest.raises(ValueError):
        modes.get("none")
    engine = TableEngine(spark).load(generate.fixed_table(spark, 20))
    full = [positions(engine.sort(["age"], mode=m).with_positions()) for m in ("native", "precomputed", "quadsort")]
    assert full[0] == full[1] == full[2]
    with pytest.raises(ValueError):
        engine.set_sort_mode("none")
    assert engine.set_sort_mode("none", strict=False) == "native"
    engine.modes.register("back", lambda df, keys, tie: df.orderBy(F.desc("index")))
    done = engine.sort(["age"], mode="back")
    assert done.used_mode == "back" and done.df.first()["index"] == 20
