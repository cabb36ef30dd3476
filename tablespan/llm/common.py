"""Shared helpers: reading tables, shared-folder checkpoints, graph components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they may not have it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(package):
            for file in files:
                if file.endswith(".py"):
                    out.write(os.path.join(folder, file), os.path.join(name, os.path.relpath(os.path.join(folder, file), package)))
    context.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode, as in tests, where it is unset."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return context.getCheckpointDir()


#: What was written since a call of ``finished`` began, innermost call last: paths, and names of tables.
_written: list[list[tuple[str, str]]] = []


def _note(kind: str, name: str) -> None:
    if _written:
        _written[-1].append((kind, name))


def finished(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialize what ``build`` returns, then delete all that was materialized for it, also if it fails."""
    _written.append([])
    try:
        done = materialize(build())
        result = _written[-1].pop()
    finally:
        for kind, name in _written.pop():
            if kind == "table":
                spark.sql(f"drop table if exists {name}")
            else:
                _delete(spark, name)
    _note(*result)
    return done


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small iterative frame through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps start from files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _note("path", path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        _delete(df.sparkSession, path)


def bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A frame written to the warehouse, laid out by a key, and its name: joins on the key move the other side only."""
    spark = df.sparkSession
    parts, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"working_{uuid.uuid4().hex}"
    _note("table", name)
    df.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), name


def drop_table(spark: SparkSession, name: str) -> None:
    """Drop a working table that nothing reads any more."""
    spark.sql(f"drop table if exists {name}")


def neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The frame under column names that clash with nothing, and the new name of each column."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Back to the columns' own names."""
    return df.select(*(F.col(inner).alias(name) for name, inner in names.items()))


def bucket5(doc_id):
    """crc32 of the id as text, modulo 5: the fold that labels and held-out rows go by."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _forest(batches):
    """Union-find over the links of one partition; one link per node to its smallest peer."""
    parent: dict[int, int] = {}

    def root(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], names=["node", "peer"])


#: A dense group's links from many places meet in a few, so that most drop out before the joins.
FOREST_LINKS = 500_000


def spread_join(rows: DataFrame, values: DataFrame, key: str, own: Column, salts: int = 8) -> DataFrame:
    """Join rows with one value row per key; values are repeated per salt, so the rows of a frequent key spread by a hash of ``own``."""
    salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(own), F.lit(salts)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (two long columns): (node, component), component the smallest node.

    Links are first reduced to spanning forests, about FOREST_LINKS in one place.
    Large-star and small-star rounds then run as joins until no link changes;
    every round is checkpointed. Nodes without links do not appear. Null ends are ignored.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).alias("node"), F.col(b).alias("peer")).where("node is not null and peer is not null and node <> peer")
    links = checkpoint(links)
    together = max(1, -(-links.count() // FOREST_LINKS))
    links = checkpoint(links.coalesce(together).mapInArrow(_forest, "node long, peer long").distinct())
    if links.isEmpty():
        return links.select("node", F.col("peer").alias("component"))
    seen = None
    for _ in range(rounds):
        both = links.union(links.select("peer", "node"))
        least = both.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("least"))
        large = spread_join(both, least, "node", F.col("peer")).where("peer > node").select(F.col("peer").alias("node"), F.col("least").alias("peer")).where("node <> peer").distinct()
        down = large.select(F.greatest("node", "peer").alias("node"), F.least("node", "peer").alias("peer"))
        least = down.groupBy("node").agg(F.min("peer").alias("least"))
        links = checkpoint(
            spread_join(down, least, "node", F.col("peer"))
            .select(F.explode(F.array(F.struct(F.col("peer").alias("node"), F.col("least").alias("peer")), F.struct("node", F.col("least").alias("peer")))).alias("x"))
            .select("x.node", "x.peer")
            .where("node <> peer")
            .distinct()
        )
        state = links.agg(F.count("*"), F.sum(F.xxhash64("node", "peer").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select("node", F.col("peer").alias("component"))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def sliced(batches, rows: int = 500):
    """Batches a few rows at a time: what is made of them stays small."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def contiguous(batches, keys: int = 1):
    """Regroup sorted Arrow batches so that no run of equal leading key columns is cut."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        cut = np.zeros(whole.num_rows, bool)
        for k in range(keys):
            x = whole.column(k)
            cut |= pc.not_equal(x, x[-1]).to_numpy()
        at = int(np.flatnonzero(cut)[-1]) + 1 if cut.any() else 0
        if at:
            yield whole.slice(0, at)
        held = whole.slice(at)
    if held is not None and held.num_rows:
        yield held
