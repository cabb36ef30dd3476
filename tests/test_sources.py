import json

import pytest
from pyspark.sql import functions as F

from tablespan import benchmark, cli
from tablespan.engine import TableEngine
from tablespan.functions import numbers
from tablespan.schema import TableSchema, grid_schema, sort_types
from tablespan.sources import generate, tables
from tablespan.streaming.filters import filter_stream, passing_counts


@pytest.mark.parametrize("rows", [0, 257, 1024])
def test_round_trip(spark, tmp_path, rows):
    table, path = generate.fixed_table(spark, rows), str(tmp_path / "t")
    tables.save(table, path, "row_id", normalise=["firstName"], indexed=["lastName"])
    schema = TableSchema.of(table, "row_id")
    assert sorted(tables.load(spark, path, schema).collect()) == sorted(table.collect())
    assert tables.load_index(spark, path, "postings", "lastName").count() == rows
    assert tables.load_index(spark, path, "dictionary", "lastName").count() == min(rows, 8)


def test_validation(spark, tmp_path):
    table = generate.fixed_table(spark, 5)
    schema = TableSchema.of(table, "row_id")
    assert schema.struct.fieldNames() == grid_schema().fieldNames()
    assert sort_types(table)["firstName"] == "string" and sort_types(table)["age"] == "number"
    for bad, text in ((table.drop("age"), "expected 16 columns"), (table.withColumn("age", F.col("age").cast("string")), "age"), (table.withColumnRenamed("age", "years"), "years")):
        with pytest.raises(ValueError, match=text):
            schema.check(bad)
    with pytest.raises(ValueError):
        TableSchema.of(table, "nowhere")
    with pytest.raises(ValueError):
        tables.load_index(spark, "x", "trie", "a")
    tables.save(table, tables.preset_path(str(tmp_path), 5), "row_id")
    assert tables.load_preset(spark, str(tmp_path), 5, schema).count() == 5
    tables.save(table, tables.preset_path(str(tmp_path), 6), "row_id")
    with pytest.raises(ValueError, match="5 rows"):
        tables.load_preset(spark, str(tmp_path), 6)


def test_row_ids_and_local_rows(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "s string")
    assert sorted((r["s"], r["row_id"]) for r in tables.with_row_id(df, ["s"]).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    made = tables.from_rows(spark, [(0, "x")], TableSchema.of(spark.createDataFrame([], "k long, s string"), "k"))
    assert made.collect() == [(0, "x")]


def test_stream_passes_the_same_rows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = filter_stream(stream, {"event_type": "IC"}).writeStream.format("memory").queryName("passed").option("checkpointLocation", str(tmp_path / "c1")).start()
    run.processAllAvailable()
    run.stop()
    want = events.where(F.contains(F.lower("event_type"), F.lit("ic"))).count()
    assert spark.table("passed").count() == want
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    run = passing_counts(timed, {"event_type": "ic"}, "ts", "1 day", "365 days", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c2")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counted").agg(F.sum("n_rows")).first()[0] == (want or None)


def test_benchmarks(spark):
    engine = TableEngine(spark).load(generate.fixed_table(spark, 200).cache())
    engine.set_filters({"age": "2"})
    done = benchmark.run_filter(engine, 1, cases={"age": ("18", "99"), "firstName": ("a",)})
    assert done.error is None and next(iter(done.totals.values()))["runs"] == 3
    done = benchmark.run_sort(engine, 1, ("native", "precomputed"), (("age",), ("firstName", "lastName")))
    assert done.error is None and done.totals["precomputed"]["runs"] == 4 and engine.filters == {"age": "2"}
    assert benchmark.run_filter(engine, 1, cases={"none": ("1",)}).error
    assert engine.filters == {"age": "2"}
    with pytest.raises(ValueError):
        benchmark.run_sort(engine, 0)
    with pytest.raises(ValueError):
        benchmark.run_filter(TableEngine(spark))
    assert benchmark.percentile([], 0.5) == 0 and [benchmark.percentile([1, 2, 3, 10], p) for p in (0.5, 0.75, 0.95)] == pytest.approx([2.5, 4.75, 8.95])
    assert sum(map(len, benchmark.FILTER_CASES.values())) == 40 and len(benchmark.SORT_CASES) == 13


def test_cli(spark, capsys, tmp_path):
    assert cli.main(["--op", "filter-sort", "--rows", "300", "--filters", "firstName=ad", "--sort", "age:desc,index:asc", "--json", "--out", str(tmp_path / "o")], spark) == 0
    payload = json.loads(capsys.readouterr().out)
    assert payload["filter"]["count"] == payload["sort"]["count"] > 0 and json.loads((tmp_path / "o").read_text()) == payload
    assert cli.main(["--op", "filter-sort", "--rows", "30", "--filters", "firstName=zzz", "--sort", "age:asc"], spark) == 0
    assert cli.main(["--op", "sort", "--sort", "index"], spark) == 1
    assert "CLI failed" in capsys.readouterr().err
    assert cli.main(["--op", "sort", "--sort", "index:up"], spark) == 1
    assert cli.main(["--op", "sort", "--sort-mode", "none"], spark) == 1
    assert cli.filters_of("a=1,b= x=y,a=2") == {"a": "2", "b": " x=y"}
    assert cli.main([], spark) == 1


def test_number_formats():
    assert (numbers.format_count(1234567), numbers.format_count(12)) == ("1.234.567", "12")
    assert numbers.format_ms(0.0123456) == "12.35 ms"
    assert [numbers.format_bytes(n) for n in (0, 1023, 1024, 5 << 20)] == ["0 B", "1023 B", "1.00 KB", "5.00 MB"]


def test_number_rules(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (None,), (float("nan"),), (float("-inf"),)], "v double")
    rows = df.select(numbers.is_finite(F.col("v")).alias("f"), numbers.is_whole(F.col("v")).alias("w")).collect()
    assert [tuple(r) for r in rows] == [(True, True), (True, False), (False, False), (False, False), (False, False)]
