import itertools

import pytest
from pyspark.sql import functions as F

from tablespan.benchmark import option_combinations
from tablespan.engine import EngineOptions, TableEngine
from tablespan.functions.text import cell_text, double_text, needle
from tablespan.operators import filters, index
from tablespan.plans import planner
from tablespan.plans.cache import ResultCache
from tablespan.sources import generate


def ids(df, key="row_id"):
    return sorted(r[key] for r in df.select(key).collect())


def grid_rows(n):
    names = generate.FIRST_NAMES, generate.LAST_NAMES
    return [{"row_id": i, "index": i + 1, "firstName": names[0][i % 8], "lastName": names[1][i * 7 % 8], "age": 18 + i % 82, **{c: ((i + 1) * m + a) % k for c, (m, a, k) in generate.RULES.items()}} for i in range(n)]


def brute(rows, wanted):
    return sorted(r["row_id"] for r in rows if all(needle(v) in str(r[c]).lower() for c, v in wanted.items() if needle(v)))


def test_fixed_table_follows_its_rules(spark):
    made = [r.asDict() for r in generate.fixed_table(spark, 512).orderBy("row_id").collect()]
    assert made == grid_rows(512)


def test_random_table_does_not_depend_on_partitions(spark):
    one, many = (generate.random_table(spark, 300, 5, p).orderBy("row_id").collect() for p in (1, 7))
    assert one == many
    assert one != generate.random_table(spark, 300, 6).orderBy("row_id").collect()
    assert generate.random_table(spark, 0, 5).count() == 0


@pytest.mark.parametrize("wanted", [{"firstName": "a", "lastName": "o", "column5": "1"}, {"age": "18"}, {"index": " 99 "}, {"firstName": "ADA"}, {"firstName": "", "age": None}, {"firstName": "zzz"}])
def test_filter_equals_brute_force(spark, wanted):
    found = TableEngine(spark).load(generate.fixed_table(spark, 3000)).filter(wanted)
    assert ids(found.df) == brute(grid_rows(3000), wanted)
    assert found.count() == len(ids(found.df))


def test_no_option_changes_an_answer(spark):
    table = generate.fixed_table(spark, 600).cache()
    wanted = {"firstName": "a", "lastName": "o", "column5": "1"}
    for options in option_combinations():
        engine = TableEngine(spark, options).load(table)
        engine.row_count()
        assert ids(engine.filter(wanted).df) == brute(grid_rows(600), wanted)
    assert len(option_combinations()) == 48


def test_order_of_conjuncts_does_not_matter(spark):
    table = generate.fixed_table(spark, 200)
    wanted = {"firstName": "a", "lastName": "o", "age": "2"}
    found = {tuple(ids(filters.filter_rows(table, wanted, list(order)))) for order in itertools.permutations(wanted)}
    assert len(found) == 1


def test_null_never_matches_and_text_is_literal(spark):
    df = spark.createDataFrame([(0, None, None), (1, "100%", 1.5), (2, "a_b", 20.0), (3, "a\\b", float("nan")), (4, "null", None)], "row_id long, s string, d double")
    at = lambda c, v: ids(filters.filter_rows(df, {c: v}))
    assert at("s", "null") == [4]
    assert at("s", "%") == [1]
    assert at("s", "_") == [2]
    assert at("s", "\\") == [3]
    assert at("d", "nan") == [3]
    assert at("d", ".0") == []
    assert at("d", "20") == [2]


def test_needles_are_trimmed_and_lowered():
    assert needle(" \t\n Ab ﻿") == "ab"
    assert needle("a b") == "a b"
    assert needle(None) == "" and needle(5) == "5"


def test_mixed_case_and_unicode(spark):
    df = spark.createDataFrame([(0, "Andrew"), (1, "ANDREW"), (2, "andrew"), (3, "İx"), (4, "\U0001f600y")], "row_id long, s string")
    assert ids(filters.filter_rows(df, {"s": "dRe"})) == [0, 1, 2]
    assert ids(filters.filter_rows(df, {"s": "\U0001f600"})) == [4]
    assert len(ids(filters.filter_rows(df, {"s": "x"}))) == 1


def test_double_text(spark):
    values = {20.0: "20", 1e7: "10000000", 123456789.5: "123456789.5", 1e-6: "0.000001", 0.00015: "0.00015", 0.0: "0", 1.5e22: "1.5e+22", 1e21: "1e+21", 2.5e-7: "2.5e-7", -20.0: "-20", 1e20: "100000000000000000000", 3e7: "30000000"}
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", double_text(F.col("v")).alias("t"))
    assert {r["v"]: r["t"] for r in df.collect()} == values


def test_nested_columns_have_no_text(spark):
    df = spark.createDataFrame([([1],)], "a array<int>")
    with pytest.raises(ValueError):
        cell_text(df, "a")


def test_unknown_column(spark):
    engine = TableEngine(spark).load(generate.fixed_table(spark, 20))
    with pytest.raises(ValueError, match="nowhere"):
        engine.filter({"nowhere": "x"})
    assert engine.last_error and not engine.busy
    assert engine.filter({"nowhere": "x"}, on_unknown="ignore").count() == 20


def test_refinement_equals_a_fresh_filter(spark):
    engine = TableEngine(spark, EngineOptions(reuse_previous=True)).load(generate.fixed_table(spark, 500))
    for wanted in ({"firstName": "a"}, {"firstName": "ad"}, {"firstName": "ad", "age": "2"}, {"age": "2"}, {"age": "3"}):
        assert ids(engine.filter(wanted).df) == brute(grid_rows(500), wanted)
    assert planner.stricter({"a": "x"}, {"a": "xy"}) and planner.stricter({"a": "x"}, {"a": "x", "b": "y"})
    assert not planner.stricter({"a": "x"}, {"a": "x"}) and not planner.stricter({"a": "x"}, {"b": "x"}) and not planner.stricter({"a": "x"}, {"a": "yx"})


def test_filter_one_leaves_the_earlier_result(spark):
    engine = TableEngine(spark, EngineOptions(reuse_previous=True)).load(generate.fixed_table(spark, 100))
    engine.filter({"firstName": "a"})
    kept = engine._previous
    engine.filter_one("lastName", "o")
    assert engine._previous is kept


def test_result_cache(spark):
    engine = TableEngine(spark, EngineOptions(result_cache=True), ResultCache(small=(50, 2), medium=(100, 1))).load(generate.fixed_table(spark, 400))
    assert engine.filter({"firstName": "ada"}).cache_event == "small"
    assert engine.filter({"firstName": " ADA "}).cache_event == "hit"
    assert engine.filter({"firstName": "a"}).cache_event is None  # too large to keep
    for name in ("boris", "chloe"):
        engine.filter({"firstName": name})
    assert engine.cache.snapshot()["small"] == 2
    assert engine.filter({"firstName": "ada"}).cache_event == "small"
    engine.load(generate.fixed_table(spark, 8))
    assert engine.cache.snapshot() == {"revision": 2, "small": 0, "medium": 0}
    assert engine.filter({"firstName": "ada"}).count() == 1


def test_no_data(spark):
    found = TableEngine(spark).filter({"a": "x"})
    assert found.no_data and found.count() == 0
    with pytest.raises(ValueError):
        TableEngine(spark).sort()


def test_sampled_order_puts_the_rare_needle_first(spark):
    table = generate.fixed_table(spark, 6000)
    assert planner.by_sample(table, {"firstName": "a", "column9": "777"}, "row_id", 6000) == ["column9", "firstName"]
    assert planner.by_sample(table, {"firstName": "a", "lastName": "bergm"}, "row_id", 100) == ["lastName", "firstName"]
    sampled = planner.systematic_sample(table, "row_id", 6000)
    assert ids(sampled) == sorted({int((i + 0.5) * 6000 / 2048) for i in range(2048)})


def test_index_filters_equal_plain_ones(spark):
    table = generate.fixed_table(spark, 400)
    want = brute(grid_rows(400), {"firstName": "e", "lastName": "a"})
    parts = [index.matching_rows(index.postings(table, c, "row_id"), n) for c, n in (("firstName", "e"), ("lastName", "a"))]
    assert ids(index.intersect(parts)) == want
    assert ids(index.union(parts)) == sorted(set(brute(grid_rows(400), {"firstName": "e"})) | set(brute(grid_rows(400), {"lastName": "a"})))
    values = index.dictionary(table, "firstName", "row_id")
    assert ids(filters.filter_by_dictionary(table, values, "firstName", "E")) == brute(grid_rows(400), {"firstName": "e"})


def test_dictionary_keeps_the_first_casing(spark):
    df = spark.createDataFrame([(0, "B"), (1, "a"), (2, "A"), (3, None), (4, "b")], "row_id long, s string")
    rows = index.dictionary(df, "s", "row_id").orderBy("value_id").collect()
    assert [(r["value_id"], r["key_lower"], r["value"], r["first_row"]) for r in rows] == [(0, "b", "B", 0), (1, "a", "a", 1)]


@pytest.mark.parametrize("distinct,choice", [(19, "compact"), (21, "plain")])
def test_dictionary_choice(spark, distinct, choice):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % distinct).alias("n"), (F.col("id") % distinct).cast("string").alias("s"))
    rows = {r["column_name"]: r["choice"] for r in index.dictionary_stats(df, ["n", "s"], "row_id").collect()}
    assert rows == {"n": choice, "s": "compact" if choice == "compact" else "wide"}


def test_stored_text_reaches_the_scan(spark, tmp_path):
    from tablespan.sources import tables

    tables.save(generate.fixed_table(spark, 50), str(tmp_path / "t"), "row_id", normalise=["firstName"])
    df = tables.load(spark, str(tmp_path / "t"), normalised=True)
    plan = filters.filter_rows(df, {"firstName": "ad"})._jdf.queryExecution().toString()
    assert "StringContains(firstName_norm,ad)" in plan
    assert "Python" not in plan and "SinglePartition" not in plan


def test_saved_dictionaries_answer_and_change_the_plan(spark, tmp_path):
    from tablespan.sources import tables

    path = str(tmp_path / "t")
    tables.save(generate.fixed_table(spark, 400), path, "row_id", indexed=["firstName"])
    engine = TableEngine(spark).load_saved(path)
    plan = lambda found: found.df._jdf.queryExecution().optimizedPlan().toString()
    for wanted in ({"firstName": "e"}, {"firstName": "es"}, {"firstName": "est", "lastName": "a"}, {"firstName": "h"}):
        found = engine.filter(wanted)
        assert ids(found.df) == brute(grid_rows(400), wanted) and "LeftSemi" in plan(found)
    engine.set_options(dictionary_search=False)
    found = engine.filter({"firstName": "e"})
    assert ids(found.df) == brute(grid_rows(400), {"firstName": "e"}) and "LeftSemi" not in plan(found)


def test_a_longer_needle_searches_the_matched_keys_only(spark, tmp_path):
    from tablespan.sources import tables

    path = str(tmp_path / "t")
    tables.save(generate.fixed_table(spark, 100), path, "row_id", indexed=["firstName"])
    engine = TableEngine(spark).load_saved(path)
    first = engine._keys("firstName", "e")
    assert first.count() == 5 - sum("e" not in n.lower() for n in generate.FIRST_NAMES[:5]) + sum("e" in n.lower() for n in generate.FIRST_NAMES[5:])
    second = engine._keys("firstName", "es")
    assert "InMemoryRelation" in second._jdf.queryExecution().withCachedData().toString() and [r["key_lower"] for r in second.collect()] == ["esther"]
    assert engine._keys("firstName", "es") is second


def test_stored_text_can_be_left_unused(spark, tmp_path):
    from tablespan.sources import tables

    path = str(tmp_path / "t")
    tables.save(generate.fixed_table(spark, 50), path, "row_id", normalise=["firstName"])
    plan = lambda engine: engine.filter({"firstName": "ad"}).df._jdf.queryExecution().toString()
    engine = TableEngine(spark, EngineOptions(dictionary_search=False)).load_saved(path)
    assert "StringContains(firstName_norm,ad)" in plan(engine)
    engine.set_options(normalised=False)
    assert "firstName_norm" not in plan(engine).split("Physical Plan")[1]


def test_a_large_result_is_not_persisted(spark):
    engine = TableEngine(spark, EngineOptions(result_cache=True), ResultCache(small=(5, 2), medium=(10, 1))).load(generate.fixed_table(spark, 400))
    found = engine.filter({"firstName": "a"})
    assert found.cache_event is None and not found.df.is_cached and found.count() == len(brute(grid_rows(400), {"firstName": "a"}))


def test_listeners_and_restore(spark):
    engine, seen = TableEngine(spark).load(generate.fixed_table(spark, 10)), []
    stop = engine.listen(seen.append)
    engine.set_filters({"firstName": " Ad ", "age": "  "})
    assert engine.filters == {"firstName": " Ad "} and seen
    saved = engine.state()
    engine.clear_filters()
    engine.set_options(columnar=False)
    assert engine.options.layout == "numeric-rows" or engine.options.layout == "object-rows"
    engine.restore({k: saved[k] for k in ("options", "filters", "sort_mode")})
    assert engine.filters == {"firstName": " Ad "} and engine.options.layout == "numeric-columnar"
    stop()
    n = len(seen)
    engine.clear_filters()
    assert len(seen) == n
