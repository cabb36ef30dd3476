"""What the plans of the operators hold, and that the package reaches the workers."""

from pyspark.sql import functions as F

from tablespan.llm import common, fingerprints, line_dedup, queries


def plan(df):
    return df._jdf.queryExecution().toString()


def is_native(df):
    return not any(word in plan(df) for word in ("Python", "Pandas", "Arrow"))


def test_native_operators_run_no_python(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    assert is_native(queries.op7_document_fingerprints(spark, sf_dir))
    assert is_native(line_dedup.intervals(line_dedup.lines(docs)))
    assert is_native(line_dedup.dedup(docs))
    assert is_native(fingerprints.with_next(docs))


def test_scans_read_the_columns_they_need(spark, sf_dir):
    shown = plan(queries.op10_secret_scans(spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shown and "Exchange" not in shown


def test_no_cross_joins(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for df in (queries.op7_document_fingerprints(spark, sf_dir), line_dedup.dedup(docs)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)


def test_fold_is_the_crc_of_the_id(spark):
    import zlib

    rows = spark.range(50).select("id", common.bucket5(F.col("id")).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in rows)


def test_package_is_sent_once(spark):
    common.ship(spark)
    common.ship(spark)
    assert spark.sparkContext.applicationId in common._shipped
    assert sum(name.endswith("tablespan.zip") for name in spark.sparkContext._python_includes) == 1
