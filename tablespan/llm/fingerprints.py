"""Document fingerprints: a canonical exact digest, from built-in functions only.

Text is normalised (NFKC), case-folded and its white space runs become one
space; the digest of that canonical text is two chained 64-bit xxhash values.
Rows of one digest are compared byte by byte before they count as equal.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space runs to one space, trimmed. Null: empty."""
    text = F.coalesce(text, F.lit(""))
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    # plain ASCII is already normal; lower() folds it without leaving generated code
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(nfkc(folded)), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: two xxhash64 values over differently prefixed input."""
    return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit("wide"), canon))))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row; equal canonical texts have equal fingerprints.

    Null text counts as empty. Null and repeated ids stay as they are: one row
    out for one row in. Other columns are dropped, so no name can clash.
    """
    return docs.select(F.col(id_col), digest(canonical(F.col(text_col))).alias("fingerprint"))


def equal_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(fingerprint, canonical text, class_id, copies): one row per text found in a bucket of two or more rows.

    Rows are grouped by digest and text itself, so two texts that share a digest
    stay apart. The aggregation combines before it shuffles: a bucket with a
    third of all rows arrives as one row a task. class_id is the smallest id
    (null if all are null).
    """
    rows = docs.select(F.col(id_col).alias("id"), canonical(F.col(text_col)).alias("canon")).withColumn("fingerprint", digest(F.col("canon")))
    return rows.groupBy("fingerprint", "canon").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")).where("copies > 1")


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join of rows with their class; classes are repeated per salt, so the rows of a large class spread."""
    salted = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(salts)).cast("int")
    return rows.withColumn("_salt", own).join(salted, [*keys, "_salt"], "left").drop("_salt")


def _range_of(column: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below a value, by two short scans; -1 for null."""
    step = max(int(len(bounds) ** 0.5), 1)
    every = F.array(*(F.lit(b) for b in bounds[step - 1 :: step])) if len(bounds) >= step else None
    if not bounds:
        return F.when(column.isNull(), -1).otherwise(0)
    coarse = F.size(F.filter(every, lambda b: b < column)) * step
    fine = F.size(F.filter(F.slice(F.array(*(F.lit(b) for b in bounds)), coarse + 1, step), lambda b: b < column))
    return F.when(column.isNull(), -1).otherwise(coarse + fine)


#: Bytes of text that one range of ids is made for.
RANGE_BYTES = 16 << 20


def _slots(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their range of ids and its part, and about how many slots there are.

    There is a range for every RANGE_BYTES of text, and one a shuffle partition
    at least. An id that ends several ranges, and null, have that many parts, by
    ascending hash of the text; the smaller ids of the range go to its last part.
    """
    spark = rows.sparkSession
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("nulls"), F.sum(F.octet_length("text")).alias("bytes")).first()
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, (total["bytes"] or 0) // RANGE_BYTES + 1)
    found = rows.agg(F.percentile_approx("id", [k / many for k in range(1, many)], max(10_000, 20 * many))).first()[0] or []
    times = Counter(found)
    bounds = sorted(times)
    shares = F.array(*(F.lit(max(x, 1)) for x in (total["nulls"] * many // max(total["n"], 1), *(times[b] for b in bounds), 1)))
    ends = F.array(F.lit(None).cast("long"), *(F.lit(b).cast("long") for b in bounds), F.lit(None).cast("long"))
    share = F.get(shares, F.col("range") + 1).cast("long")
    ending = F.col("id").eqNullSafe(F.get(ends, F.col("range") + 1)) & (F.col("range") < len(bounds))
    # the upper 24 bits of the hash, which keep its order
    part = F.shiftright((F.shiftright("h", 40) + (1 << 23)) * share, 24)
    ranged = rows.withColumn("range", _range_of(F.col("id"), bounds))
    return ranged.withColumn("part", F.when(ending, part).otherwise(share - 1)), many


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, fingerprint, next_text, next_fingerprint): each row beside the next by descending id.

    The last row's next is the first. Rows are dealt out by ranges of the id, as
    many as the text's bytes ask for, so no task holds more than a few ranges,
    whatever the session's number of partitions; ids that repeat very often, and
    many null ids, are several ranges. The first row of the following range is
    added to each as its last row. What is collected and broadcast is one row a
    range. Null text counts as empty, null ids come last, equal ids are ordered
    by a hash of their text, and a single row is its own next.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranged, many = _slots(rows)
    tops = ranged.groupBy("range", "part").agg(F.max(F.struct("id", F.bitwise_not("h").alias("h"))).alias("top")).collect()
    tops.sort(key=lambda r: (-r["range"], r["part"]))
    follow = [(t["range"], t["part"], after["top"]["id"], ~after["top"]["h"]) for t, after in zip(tops, tops[1:] + tops[:1])]
    follow = F.broadcast(spark.createDataFrame(follow, "range int, part long, head long, head_h long"))
    heads = (
        rows.join(follow, F.col("id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")))
        .groupBy("range", "part")
        .agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("id"), "text", F.lit(None).cast("long").alias("h"), "range", "part", F.lit(1).alias("edge"))
    )
    both = ranged.withColumn("edge", F.lit(0)).unionByName(heads).withColumn("fingerprint", digest(canonical(F.col("text"))))
    inside = Window.partitionBy("range", "part").orderBy("edge", F.col("id").desc_nulls_last(), "h", "text")
    return (
        both.repartition(many, "range", "part")
        .withColumn("next_text", F.lead("text").over(inside))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(inside))
        .where("edge = 0")
        .select("id", "text", "fingerprint", "next_text", "next_fingerprint")
    )
