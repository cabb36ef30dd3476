"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablespan.llm import graph_search, queries


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), d[j]) for j in order]


def answers(df):
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(by[r["query_id"]])
    return by


def recall(found, ids, x, every=100):
    want = {int(i): brute(ids, x, q) for q, i in enumerate(ids) if i % every == 0}
    assert set(found) == set(want)
    hits = 0
    for q, rows in found.items():
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(s == pytest.approx(np.linalg.norm(x[at[v]] - x[at[q]]), rel=1e-12, abs=1e-12) for v, s in rows)
        assert rows == sorted(rows, key=lambda r: (r[1], r[0])) and len(rows) == len(want[q])
        hits += len({v for v, _ in rows} & {v for v, _ in want[q]})
    return hits / max(sum(map(len, want.values())), 1)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    assert recall(answers(queries.op9_nn_descent_search(spark, sf_dir)), ids, x) == 1.0


def test_walk_finds_what_blocks_do_not_hold(spark, monkeypatch):
    """Small blocks leave most neighbours to the descent and the walk."""
    monkeypatch.setattr(graph_search, "PROJECTIONS", 2)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(2500, 16)), rng.normal(size=(400, 16)) * 0.01 + 5])
    ids = np.arange(len(x)) * 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    codes = graph_search.encoded(graph_search.usable(df).select(F.col("id").alias("node"), "vec"), 2)
    graph = graph_search.build(codes, 12, 3, 2, 64)
    assert graph.groupBy("node").count().agg(F.max("count")).first()[0] <= 12
    monkeypatch.setattr(graph_search.build, "__defaults__", (12, 3, 2, 64))
    assert recall(answers(graph_search.search(df, neighbours=12, pool=120)), ids, x) >= 0.9


def test_recall_on_many_vectors(spark):
    """Over twenty blocks, with hubs: a dense centre that is near to everything, and near copies."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(300, 24))
    x = np.concatenate([centres[rng.integers(0, 300, 18_000)] + 0.3 * rng.normal(size=(18_000, 24)), 0.05 * rng.normal(size=(3000, 24)), centres[0] + 1e-5 * rng.normal(size=(500, 24))]).astype(np.float32).astype(float)
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(8)
    assert recall(answers(graph_search.search(df)), ids, x) >= 0.95


def test_an_id_with_many_equal_rows_hides_no_other(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(k, [1.0, 0.0]) for k in range(2, 12)] + [(100, [1.0, 0.1])]
    found = answers(graph_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert [v for v, _ in found[100]] == list(range(1, 11))


def test_equal_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(0, 300, 3)] + [(k, [0.0, 1.0 + k]) for k in range(1, 300, 30)] + [(100, [1.0, 1.0])]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash")).withColumn("node", F.lit(1))
    assert recall(answers(graph_search.search(df)), ids, x) == 1.0


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 2.0]), (200, [1.0, 2.5]), (8, [-1e30, 3.0]), (9, [1e200, 0.0]), (200, [1.0, 2.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = answers(graph_search.search(df))
    assert [v for v, _ in found[0]] == [200, 8, 9] and [v for v, _ in found[200]] == [0, 8, 9] and set(found) == {0, 200}
    assert graph_search.search(df.limit(0)).count() == 0
    assert graph_search.search(df.where("vec_id = 0")).count() == 0


def test_codes_keep_the_distances():
    x = np.random.default_rng(1).normal(size=(50, 64)) * np.logspace(-20, 20, 50)[:, None]
    back = graph_search._decode(graph_search._encode(x))
    assert np.abs(back / np.abs(x).max(1)[:, None] - x / np.abs(x).max(1)[:, None]).max() < 1e-3
