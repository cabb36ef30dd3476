"""Approximate nearest neighbours: NN-descent builds a graph with Spark joins, greedy search walks it.

Equal vectors are indexed once. The graph starts from blocks of vectors that are
next to each other along random projections; then each round joins every node's
neighbours (in both directions) with their vectors, compares them with one
another and keeps each node's nearest. Rounds go on until few edges are new. A
node with very many neighbours is dealt out in slices, at random each round. A
query keeps a pool of its nearest nodes found and expands those not yet expanded
until none is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEIGHBOURS = 20
#: Rounds end when no more than SETTLED of all edges are new, or after ROUNDS.
ROUNDS, SETTLED = 6, 0.1
PROJECTIONS = 4
BLOCK = 1024
POOL = 300
RERANK = 64
K = 10
_SLICE = 160
#: Queries whose pools are kept in one place during the walk.
_QUERIES = 50
_FLAT = "node long, nb long, d double, fresh boolean"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) with double components, without null ids and vectors that are null, zero or hold null or non-finite components.

    Vectors whose length is not the most frequent one take no part either.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("id is not null and vec is not null").where(~bad & F.exists("vec", lambda x: x != 0.0))
    usual = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("vec") == (usual["dim"] if usual else 0))


def _encode(x: np.ndarray) -> list[bytes]:
    """Single-precision components relative to a power of two near the largest, which goes before them: exact for single-precision vectors."""
    scale = np.exp2(np.floor(np.log2(np.abs(x).max(1))))
    single = (x / scale[:, None]).astype(np.float32)
    return [s.tobytes() + h.tobytes() for s, h in zip(scale, single)]


def _decode(codes: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    scale = np.ascontiguousarray(raw[:, :8]).view(np.float64)
    return np.ascontiguousarray(raw[:, 8:]).view(np.float32).astype(np.float64) * scale


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances; what overflows is infinitely far."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.where(np.isnan(d), np.inf, np.maximum(d, 0))


def _batch(node, nb, d, fresh):
    return pa.record_batch([pa.array(node, pa.int64()), pa.array(nb, pa.int64()), pa.array(d, pa.float64()), pa.array(fresh, pa.bool_())], names=["node", "nb", "d", "fresh"])


def encoded(distinct: DataFrame, projections: int, seed: int = 5) -> DataFrame:
    """(node, code, p0, p1, ...): the vector's code and its values along random directions."""
    names = [f"p{k}" for k in range(projections)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).to_pylist(), np.float64)
            axes = np.random.default_rng(seed).normal(size=(x.shape[1], projections))
            p = x @ axes
            yield pa.record_batch([batch.column(0), pa.array(_encode(x), pa.binary()), *(pa.array(p[:, k]) for k in range(projections))], names=["node", "code", *names])

    return distinct.select("node", "vec").mapInArrow(run, "node long, code binary, " + ", ".join(f"{n} double" for n in names))


def _blocks(k: int, block: int):
    """The k nearest within blocks of consecutive rows."""

    def nearest(node, codes):
        x = _decode(codes)
        d = _squares(x, x)
        np.fill_diagonal(d, np.nan)  # sorts after infinity
        keep = min(k, len(node) - 1)
        if keep < 1:
            return
        at = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        yield _batch(np.repeat(node, keep), node[at].reshape(-1), np.take_along_axis(d, at, 1).reshape(-1), np.ones(at.size, bool))

    def run(batches):
        nodes, codes = np.empty(0, np.int64), []
        for batch in batches:
            nodes, codes = np.r_[nodes, batch.column("node").to_numpy()], codes + batch.column("code").to_pylist()
            while len(nodes) >= 2 * block:  # so that the last block is never a small rest
                yield from nearest(nodes[:block], codes[:block])
                nodes, codes = nodes[block:], codes[block:]
        if len(nodes):
            yield from nearest(nodes, codes)

    return run


def _keep_nearest(k: int):
    """The k nearest different neighbours of each node; rows come sorted by node. A known one stays not fresh."""

    def run(batches):
        for rows in common.contiguous(batches):
            node, nb, d, fresh = (rows.column(x).to_numpy() for x in range(4))
            order = np.lexsort((fresh, nb, node))
            node, nb, d, fresh = node[order], nb[order], d[order], fresh[order]
            first = np.r_[True, (node[1:] != node[:-1]) | (nb[1:] != nb[:-1])] & (node != nb)
            node, nb, d, fresh = node[first], nb[first], d[first], fresh[first]
            order = np.lexsort((nb, d, node))
            node, nb, d, fresh = node[order], nb[order], d[order], fresh[order]
            if not len(node):
                continue
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.r_[starts, len(node)]))
            top = rank < k
            yield _batch(node[top], nb[top], d[top], fresh[top])

    return run


def _nearest(rows: DataFrame, k: int) -> DataFrame:
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(_keep_nearest(k), _FLAT)


def _local_join(batches):
    """For each slice of a node's neighbours, these compared with one another: candidates nearer than the farthest each knows."""
    for rows in common.contiguous(batches, 2):
        at, part, other, fresh, limit = (rows.column(x).to_numpy() for x in ("at", "part", "other", "fresh", "far"))
        x = _decode(rows.column("code").to_pylist())
        edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1]), True])
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            if not fresh[a:b].any():
                continue
            d = _squares(x[a:b], x[a:b])
            i, j = np.nonzero((d < limit[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (other[a:b, None] != other[None, a:b]))
            out.append((other[a:b][i], other[a:b][j], d[i, j]))
        if out:
            node, nb, d = (np.concatenate(c) for c in zip(*out))
            yield _batch(node, nb, d, np.ones(len(node), bool))


def build(codes: DataFrame, k: int = NEIGHBOURS, rounds: int = ROUNDS, projections: int = PROJECTIONS, block: int = BLOCK) -> DataFrame:
    """The neighbour graph (node, nb, d, fresh) with d the squared distance; about k rows per node."""
    starts = None
    for p in range(projections):
        some = codes.select("node", "code", f"p{p}").repartitionByRange(f"p{p}", "node").sortWithinPartitions(f"p{p}", "node").mapInArrow(_blocks(k, block), _FLAT)
        starts = some if starts is None else starts.union(some)
    graph = common.checkpoint(_nearest(starts, k))
    for turn in range(rounds):
        far = graph.groupBy("node").agg(F.max("d").alias("far"), F.count("*").alias("n"))
        members = codes.join(far, "node").select(F.col("node").alias("other"), "code", F.when(F.col("n") < k, float("inf")).otherwise(F.col("far")).alias("far"))
        both = _sliced(_both_ways(graph), turn)
        met = both.join(members, "other").repartition("at", "part").sortWithinPartitions("at", "part").select("at", "part", "other", "fresh", "far", "code")
        found = met.mapInArrow(_local_join, _FLAT)
        graph = common.checkpoint(_nearest(graph.withColumn("fresh", F.lit(False)).union(found), k))
        edges = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if edges["fresh"] <= SETTLED * edges["n"]:
            break
    return graph


def _both_ways(graph: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("node").alias("at"), F.col("nb").alias("other"), "fresh"), F.struct(F.col("nb").alias("at"), F.col("node").alias("other"), "fresh"))
    return graph.select(F.explode(ends).alias("e")).select("e.*")


def _sliced(both: DataFrame, turn: int) -> DataFrame:
    """(at, other, fresh, part): each pair once; a node's neighbours fall at random into slices of about _SLICE.

    Ids alone are gathered by node to be counted; the vectors go to the slices.
    """
    pairs = both.repartition("at").groupBy("at", "other").agg(F.max("fresh").alias("fresh"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("at")) / _SLICE)
    return pairs.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "other"), parts))


def _pack(batches):
    """Neighbours of a node as arrays, a slice to a row."""
    for rows in common.contiguous(batches, 2):
        at, part, other = (rows.column(x).to_numpy() for x in ("at", "part", "other"))
        codes = rows.column("code").to_pylist()
        edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1]), True])
        cuts = list(zip(edges[:-1], edges[1:]))
        yield pa.record_batch([pa.array(at[[a for a, _ in cuts]]), pa.array([other[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([b"".join(codes[a:b]) for a, b in cuts], pa.binary())], names=["node", "nbs", "codes"])


def adjacency(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """(node, nbs, codes): each node's neighbours in either direction with their vectors' codes."""
    both = _sliced(_both_ways(graph), 0).drop("fresh")
    met = both.join(codes.select(F.col("node").alias("other"), "code"), "other")
    return met.repartition("at", "part").sortWithinPartitions("at", "part").select("at", "part", "other", "code").mapInArrow(_pack, "node long, nbs binary, codes binary")


_STATE = pa.schema([("query", pa.int64()), ("code", pa.binary()), ("ids", pa.binary()), ("ds", pa.binary()), ("done", pa.binary())])


def _measure(batches):
    """What a frontier node leads to, where the node is: neighbours nearer to the query than its pool's farthest."""
    for batch in batches:
        out = []
        for query, code, limit, nbs, codes in zip(*(batch.column(c).to_pylist() for c in range(5))):
            width = len(code)
            d = _squares(_decode([codes[i : i + width] for i in range(0, len(codes), width)]), _decode([code]))[:, 0]
            near = (d < limit) | np.isinf(limit)
            out.append((query, np.frombuffer(nbs, np.int64)[near].tobytes(), d[near].tobytes()))
        yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["query", "nbs", "ds"])


def _expand(pool: int):
    """Merge what a query's frontier leads to (rows without a code) into its pool; rows come sorted by query."""

    def merged(query, code, ids, ds, led):
        new = np.frombuffer(b"".join(x for x, _ in led), np.int64)
        # all that was in the pool has been expanded by now
        done = np.r_[np.ones(len(ids), bool), np.zeros(len(new), bool)]
        ids, ds = np.r_[ids, new], np.r_[ds, np.frombuffer(b"".join(x for _, x in led), np.float64)]
        order = np.lexsort((~done, ids))
        ids, ds, done = ids[order], ds[order], done[order]
        first = np.r_[True, ids[1:] != ids[:-1]]
        ids, ds, done = ids[first], ds[first], done[first]
        top = np.lexsort((ids, ds))[:pool]
        return query, code, *(a.tobytes() for a in (ids[top], ds[top], done[top]))

    def run(batches):
        for rows in common.contiguous(batches):
            queries, codes, ids, ds = (rows.column(k).to_pylist() for k in range(4))
            out, lo = [], 0
            while lo < len(queries):
                hi = lo
                while hi < len(queries) and queries[hi] == queries[lo]:
                    hi += 1
                own = next(k for k in range(lo, hi) if codes[k] is not None)
                led = [(ids[k], ds[k]) for k in range(lo, hi) if k != own]
                out.append(merged(queries[lo], codes[own], np.frombuffer(ids[own], np.int64), np.frombuffer(ds[own], np.float64), led))
                lo = hi
            yield pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_STATE)], schema=_STATE)

    return run


def _frontier(pool: int):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for q, code, ids, ds, done in zip(*(batch.column(c).to_pylist() for c in range(5))):
                left = np.frombuffer(ids, np.int64)[~np.frombuffer(done, np.bool_)]
                ds = np.frombuffer(ds, np.float64)
                for column, x in zip(out, ([q] * len(left), [code] * len(left), [float(ds[-1]) if len(ds) >= pool else np.inf] * len(left), left.tolist())):
                    column += x
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.float64(), pa.int64()))], names=["query", "code", "limit", "node"])

    return run


def walk(queries: DataFrame, links: DataFrame, pool: int = POOL, rounds: int = 40) -> DataFrame:
    """(query, ids): the pool of each query node after greedy search, nearest first. queries: (query, code).

    The graph stays where it is; the frontier goes to it with the query's code,
    and only ids and distances that can enter the pool come back.
    """
    schema = "query long, code binary, ids binary, ds binary, done binary"

    def start(batches):
        for batch in batches:
            n = batch.num_rows
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([np.int64(q).tobytes() for q in batch.column(0).to_pylist()], pa.binary()), pa.array([np.float64(0).tobytes()] * n, pa.binary()), pa.array([b"\0"] * n, pa.binary())], names=_STATE.names)

    state = common.checkpoint(queries.mapInArrow(start, schema))
    # a step moves little: no more tasks than the queries are worth
    places = max(8, state.count() // _QUERIES)
    for _ in range(rounds):
        if state.where(F.contains("done", F.lit(b"\0"))).isEmpty():
            break
        frontier = state.mapInArrow(_frontier(pool), "query long, code binary, limit double, node long")
        led = frontier.join(links, "node").select("query", "code", "limit", "nbs", "codes").mapInArrow(_measure, "query long, nbs binary, ds binary")
        none = F.lit(None).cast("binary")
        both = state.union(led.select("query", none.alias("code"), F.col("nbs").alias("ids"), "ds", none.alias("done")))
        state = common.checkpoint(both.repartition("query").coalesce(places).sortWithinPartitions("query").mapInArrow(_expand(pool), schema))
    return state.select("query", "ids")


def _top(n: int):
    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(x, np.int64)[:n] for x in batch.column(1).to_pylist()]
            counts = [len(x) for x in ids]
            if ids:
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), counts)), pa.array(np.concatenate(ids))], names=["rep", "node"])

    return run


def search(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", neighbours: int = NEIGHBOURS, rounds: int = ROUNDS, pool: int = POOL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each vector whose id is divisible by ``every``.

    All other vectors are candidates. The best RERANK nodes of a query's pool are
    measured again in double precision on the original vectors; equal vectors
    share a node, of which the k + 1 smallest ids are enough for any answer.
    Repeated ids are different candidates of one id: the nearest counts.
    Vectors that cannot take part are left out; fewer candidates give fewer rows.
    """
    rows = usable(vectors, id_col, vec_col).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    keyed = rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit("second"), "vec"))
    keyed = common.materialize(keyed.dropDuplicates(["h1", "h2", "id"]))
    ranked = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 2)
    members = common.materialize(ranked)
    nodes = members.where("nth = 1").select(F.col("id").alias("node"), "h1", "h2", "vec")
    codes = common.materialize(encoded(nodes, PROJECTIONS))
    # the graph is laid out by node once; each step of the walk moves the frontier only
    links, laid_out = common.bucketed(adjacency(build(codes, neighbours, rounds), codes), "node")
    asked = keyed.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "h1", "h2", F.col("vec").alias("q"))
    asked = asked.join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).select("query_id", "q", F.col("node").alias("rep"))
    starts = asked.select(F.col("rep").alias("node")).distinct().join(codes, "node").select(F.col("node").alias("query"), "code")
    best = common.checkpoint(walk(starts, links, pool).mapInArrow(_top(RERANK), "rep long, node long"))
    common.drop_table(vectors.sparkSession, laid_out)
    of_node = members.join(nodes.select("node", "h1", "h2"), ["h1", "h2"]).select("node", "id", "vec")
    square = F.aggregate(F.zip_with("q", "vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    met = asked.join(best, "rep").join(of_node, "node").where("id <> query_id").withColumn("score", F.sqrt(square))
    met = met.groupBy("query_id", F.col("id").alias("vec_id")).agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
