import sys

import pytest

import __spark_entry__
from tablespan import catalogue


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["o_orderkey", "o_orderpriority", "o_totalprice", "pos"] and df.count() > 0


def test_table_queries_are_always_there():
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", ["tablespan.llm", "corpus_pipeline"])
def test_absent_operators_are_left_out(monkeypatch, gone):
    for name in [m for m in sys.modules if m.startswith(("tablespan.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLES)
