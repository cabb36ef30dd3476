"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 17
#: Sources up to this many are broadcast; beyond it the join is salted.
BROADCAST_SOURCES = 100_000
SALTS = 32
#: Larger rates are drawn in equal parts up to this one: exp(-rate) must not underflow.
PART = 500.0
_UNIT = 2.0**-53


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, source_col: str = "source", temper: float = 0.5) -> DataFrame:
    """(source, rate): the mean number of copies that brings each source to its share of the documents.

    Without weights a source's target is its count to the power ``temper``.
    Sources that the weights do not name get none. The total stays the same.
    A null source is a source of its own, not that of the empty name; weights name it by None.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(temper)))
    else:
        given = F.create_map(*(F.lit(x) for pair in {"": 0.0, **weights}.items() if pair[0] is not None for x in pair))
        named = F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(given[F.col("source")])
        counts = counts.withColumn("weight", F.coalesce(named, F.lit(0.0)))
    whole = counts.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    if not whole["weight"]:
        return counts.select("source", F.lit(0.0).alias("rate"))
    return counts.select("source", (F.col("weight") / F.lit(float(whole["weight"])) * F.lit(float(whole["n"])) / F.col("n")).alias("rate"))


def poisson_count(rate, draw):
    """The Poisson quantile: how many values of the cumulative distribution are at or below the draw in [0, 1).

    The terms end 12 standard deviations and 40 above the mean, where the tail is
    below the draw's resolution.
    """
    top = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(state, k):
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), (state["cdf"] + p).alias("cdf"), (state["n"] + F.when(state["cdf"] <= draw, 1).otherwise(0)).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step)["n"]).otherwise(0)


def copies_of(rate, hashed):
    """The Poisson count of a hash: one draw up to a rate of PART, beyond it the sum of draws with parts of the rate."""
    unit = lambda h: F.shiftrightunsigned(h, 11) * F.lit(_UNIT)
    parts = F.ceil(rate / PART).cast("int")
    many = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, k: n + poisson_count(rate / parts, unit(F.xxhash64(hashed, k))))
    return F.when(rate > PART, many).otherwise(poisson_count(rate, unit(hashed)))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", temper: float = 0.5) -> DataFrame:
    """Each document as often as a Poisson draw with its source's rate says, in one global random order.

    The draw is a hash of seed, id and text, so the rows do not depend on the
    partitioning, only their order does; rows that repeat id and text get equal
    counts. All columns stay. Given weights with a rate above 700 are refused as
    a mistake; without weights no rate is.
    """
    inner, names = common.neutral(docs)
    own_id, own_source, text = names[id_col], names[source_col], names[text_col]
    wanted = rates(inner, weights, own_source, temper)
    highest = wanted.agg(F.count("*").alias("n"), F.max("rate").alias("top")).first()
    if weights is not None and not (highest["top"] or 0.0) <= 700:
        raise ValueError("a repetition rate over 700")
    if highest["n"] <= BROADCAST_SOURCES:
        rated = inner.join(F.broadcast(wanted), F.col(own_source).eqNullSafe(F.col("source")))
    else:
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own_salt = F.pmod(F.xxhash64(own_id), F.lit(SALTS)).cast("int")
        rated = inner.join(salted, F.col(own_source).eqNullSafe(F.col("source")) & (own_salt == F.col("salt")))
    copies = rated.withColumn("n", copies_of(F.col("rate"), F.xxhash64(F.lit(seed), own_id, text))).where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    # by hash into partitions and by hash within them: random throughout, without a pass to sample ranges
    shuffled = copies.withColumn("order", F.xxhash64(F.lit(seed + 1), own_id, "copy")).repartition("order").sortWithinPartitions("order")
    return common.named(shuffled, names)
