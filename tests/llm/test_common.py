"""Working files: deleted once a result stands, also after a failure."""

import os
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from tablespan.llm import common, line_dedup, mixing


def folder(spark):
    return set(os.listdir(urlparse(common.shared_dir(spark)).path))


def test_finished_keeps_the_result_only(spark):
    before, tables = folder(spark), {t.name for t in spark.catalog.listTables()}

    def rows():
        found, _ = common.bucketed(common.materialize(spark.range(10)), "id")
        return found

    done = common.finished(spark, rows)
    assert done.count() == 10 and {t.name for t in spark.catalog.listTables()} == tables
    assert len([x for x in folder(spark) - before if x.startswith("table-")]) == 1


def test_finished_cleans_up_after_a_failure(spark):
    before = folder(spark)

    def fails():
        common.materialize(spark.range(3))
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        common.finished(spark, fails)
    assert not [x for x in folder(spark) - before if x.startswith("table-")]


def test_the_empty_source_is_not_the_null_source(spark):
    df = spark.createDataFrame([(k, "t", "" if k % 2 else None) for k in range(400)], "doc_id long, text string, source string")
    mixed = mixing.mix(df, {"": 1.0})
    assert mixed.where("source is null").count() == 0 and abs(mixed.count() - 400) < 130
    assert mixing.mix(df, {None: 1.0}).where("source is not null").count() == 0


def test_mixing_rows_follow_the_hashed_draw(spark):
    """Row by row: the quantile in plain Python of the draw that the hash gives."""
    from math import exp

    df = spark.createDataFrame([(k // 2, f"t{k // 3}", f"s{k % 40 % 7}") for k in range(3000)], "doc_id long, text string, source string").union(spark.createDataFrame([(None, None, None)] * 3, "doc_id long, text string, source string"))
    rates = {r["source"]: r["rate"] for r in mixing.rates(df).collect()}
    hashed = df.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "doc_id", "text")).collect()
    want = {}
    for r in hashed:
        u, rate = ((r["h"] & (1 << 64) - 1) >> 11) * 2.0**-53, rates[r["source"]]
        n, p = 0, exp(-rate)
        total = p
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        row = (r["doc_id"], r["text"], r["source"])
        want[row] = want.get(row, 0) + n
    got = {tuple(r)[:3]: r["count"] for r in mixing.mix(df).groupBy("doc_id", "text", "source").count().collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_rows_that_repeat_an_id_and_a_text_stay(spark):
    rows = [(1, "one two three four five six\nend", "a"), (1, "one two three four five six\nend", "b"), (2, "x\none two three four five six", "c")]
    found = sorted(map(tuple, line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, other string")).collect()))
    assert found == [*rows[:2], (2, "x", "c")]
