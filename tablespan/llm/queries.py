"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, common, fingerprints, graph_search, line_dedup, mixing, near_dup, packing, quality, secret_scan, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run):
    """Register a query; the package goes to the workers first."""

    @functools.wraps(run)
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.ship(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return shipped


def vocabulary() -> str:
    """The path of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = common.finished(spark, lambda: packing.pack(common.table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])

    def rows():
        found, _ = suffix_dedup.repeats(common.table(spark, sf_dir, "documents"))
        return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

    return common.finished(spark, rows)


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    canon = fingerprints.canonical
    n = F.length("text")
    moved = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next_text", F.lit(1), moved))
    rows = fingerprints.with_next(docs).withColumn("edited", edited)
    rows = rows.withColumn("edited_fingerprint", fingerprints.digest(canon(F.col("edited"))))

    def likeness(print_of, text):
        # equal digests still count only if the canonical texts are equal
        same = F.when(canon(F.col("text")) == canon(F.col(text)), 1.0).otherwise(0.0)
        return F.when(F.col("fingerprint") == F.col(print_of), same).otherwise(0.0)

    rows = rows.select(
        F.col("id").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("edited_fingerprint", "edited").alias("near_edited"),
        likeness("next_fingerprint", "next_text").alias("near_next"),
        F.sha2(canon(F.col("text")), 256).alias("canon_sha256"),
    )
    classes = fingerprints.equal_classes(docs).select("fingerprint", F.sha2("canon", 256).alias("canon_sha256"), "class_id", "copies")
    return fingerprints.join_classes(rows, classes, ["fingerprint", "canon_sha256"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"),
    )


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.bucket5(F.col("doc_id")) == 1, F.lit(False))

    def rows():
        model, scored = class_lm.train_and_score(docs, ~held_out)
        return scored.withColumn("train_tokens", F.lit(model.total).cast("long"))

    return common.finished(spark, rows).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op9_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.finished(spark, lambda: graph_search.search(common.table(spark, sf_dir, "embeddings")))


@query
def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(common.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "literal")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, net).select(
        "doc_id",
        F.coalesce(common.bucket5(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(common.table(spark, sf_dir, "documents"))


@query
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.table(spark, sf_dir, "documents"))


@query
def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = common.finished(spark, lambda: near_dup.groups(common.table(spark, sf_dir, "documents")))
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The search is approximate; on tables of no more vectors than a block it compares all of them.
ORACLES["op9_nn_descent_search"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
d as (select q.vec_id as query_id, v.vec_id,
  sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b)) as score
  from v q, v where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from d)
select query_id, rank, vec_id, score from r where rank <= 10"""
