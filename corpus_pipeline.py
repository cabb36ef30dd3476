"""A corpus pipeline in five stages: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablespan.llm import common, line_dedup, mixing, near_dup, packing, quality
from tablespan.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level network rejects go."""
    net = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, net)


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go."""
    return line_dedup.dedup(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity of 0.8 or more."""
    return near_dup.dedup(docs, similarity=near_dup.SIMILARITY)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out at random, by the target weight of their source."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; the repeats that mixing made are packed like any other row."""
    packed = packing.pack(docs, vocabulary(), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_runs),
    ("simhash near-dedup", simhash_near_dedup),
    ("mixing sources", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Training, doubling and subset sums are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written to the shared folder and read again."""
    common.ship(spark)
    docs = common.table(spark, sf_dir, "documents")

    def rows() -> DataFrame:
        left = docs
        for _, stage in STAGES[:-1]:
            before, left = left, common.finished(spark, lambda stage=stage, left=left: stage(spark, left, sf_dir))
            if before is not docs:
                common.drop(before)
        return STAGES[-1][1](spark, left, sf_dir)

    return common.finished(spark, rows)
