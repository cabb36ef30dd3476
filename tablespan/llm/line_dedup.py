"""Line dedup: repeated line runs from prefix doubling over line-ID sequences, built-in functions only.

Every line gets an ID; the name of a position at level k stands for its next
2**k lines. A level pairs the names of the level below, as prefix doubling
does, and only positions whose name occurs again stay in the race. Positions of
equal name are an interval of the suffix array whose longest common prefix is
at least 2**k lines; two overlapping names of a level name a window of any
length between. In each interval the first position is kept and the lines of
the others are later copies.

A repeated run with enough words is the union of its shortest windows with
enough words, from each line on and up to each line. Only these are asked for,
so doubling ends where the windows have the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A run of two or more lines is deleted from this many words on, a single line from MIN_LINE_WORDS on: what has six words hardly recurs by chance.
MIN_RUN_WORDS = 6
MIN_LINE_WORDS = 6
SALTS = 16


def _name(*columns: Column | str) -> list[Column]:
    """A 128-bit name as two long columns."""
    return [F.xxhash64(*columns).alias("n1"), F.xxhash64(F.lit("second"), *columns).alias("n2")]


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.col(id_col).alias("doc"), F.xxhash64(text).alias("variant"), text.alias("text")]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, variant, pos, n1, n2, words): one row per line; the variant tells texts that share an id apart."""
    split = docs.select(*_keys(docs, id_col, text_col)).select("doc", "variant", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != "")).alias("words")
    return split.select("doc", "variant", "pos", *_name("line"), words)


def intervals(named: DataFrame) -> DataFrame:
    """Rows whose name occurs again, with ``later``: whether another row of that name comes before.

    Names are counted with a map-side combine, so a line that a third of all
    rows share reaches the reducer as one row per task. What is shared is
    repeated per salt for the join back, which spreads the rows of such a line.
    """
    here = F.struct(F.col("doc").isNull().alias("last"), "doc", "variant", "pos")
    shared = named.groupBy("n1", "n2").agg(F.count("*").alias("n"), F.min(here).alias("earliest")).where("n > 1").drop("n")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.pmod(F.xxhash64("doc", "variant", "pos"), F.lit(SALTS)).cast("int")
    return named.withColumn("salt", own).join(salted, ["n1", "n2", "salt"]).drop("salt").withColumn("later", here != F.col("earliest")).drop("earliest")


def shortest(repeated: DataFrame, min_words: int) -> DataFrame:
    """(doc, variant, pos, lines): the shortest windows of repeated lines with ``min_words``, from each line on and up to each line.

    Windows of 2**k lines are left out: the levels have them.
    """
    own = Window.partitionBy("doc", "variant")
    along = own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = repeated.select("doc", "variant", "pos", F.row_number().over(own.orderBy("pos")).alias("nth"), "words", F.sum("words").over(along).alias("after"))
    rows = rows.withColumn("before", F.col("after") - F.col("words"))
    end = F.max(F.struct("pos", "nth", "after")).over(own.orderBy("before").rangeBetween(0, min_words - 1))
    start = F.min(F.struct("pos", "nth", "before")).over(own.orderBy("after").rangeBetween(1 - min_words, 0))
    ends = F.array(
        F.struct(F.struct("pos", "nth", "before").alias("a"), F.col("end").alias("b")),
        F.struct(F.col("start").alias("a"), F.struct("pos", "nth", "after").alias("b")),
    )
    both = rows.withColumn("end", end).withColumn("start", start).select("doc", "variant", F.explode(ends).alias("w"))
    lines_of = F.col("w.b.pos") - F.col("w.a.pos") + 1
    # without a gap, and with the words
    whole = (lines_of == F.col("w.b.nth") - F.col("w.a.nth") + 1) & (F.col("w.b.after") - F.col("w.a.before") >= min_words)
    return both.where(whole).select("doc", "variant", F.col("w.a.pos").alias("pos"), lines_of.alias("lines")).where(F.col("lines").bitwiseAND(F.col("lines") - 1) != 0).distinct()


def _beside(left: DataFrame, level: DataFrame, ahead: Column) -> DataFrame:
    """Rows with the level's columns at the line that lies ``ahead`` of theirs, as m1, m2, more, ending."""
    after = level.select(F.col("doc").alias("doc2"), F.col("variant").alias("variant2"), F.col("pos").alias("pos2"), F.col("n1").alias("m1"), F.col("n2").alias("m2"), F.col("words").alias("more"), F.col("last").alias("ending"))
    same = F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("variant") == F.col("variant2")) & (F.col("pos") + ahead == F.col("pos2"))
    return left.join(after, same).drop("doc2", "variant2", "pos2")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """(doc, variant, pos, lines): windows that are later copies; together the repeated runs that are long enough to delete.

    A run of two or more lines needs ``min_run_words``, a line alone
    ``min_line_words``. Rows that repeat both id and text count once.
    """
    own = lines(docs, id_col, text_col).dropDuplicates(["doc", "variant", "pos"])
    level = common.materialize(intervals(own.withColumn("first", F.col("words")).withColumn("last", F.col("words"))))
    odd = common.materialize(shortest(level, min_run_words))
    longest = odd.agg(F.max("lines")).first()[0] or 0
    found, size = level.where("false").select("doc", "variant", "pos", F.lit(1).alias("lines")), 1
    while not level.isEmpty():
        least = min_line_words if size == 1 else min_run_words
        found = found.union(level.where(F.col("later") & (F.col("words") >= least)).select("doc", "variant", "pos", F.lit(size).alias("lines")))
        if size > 1:
            # a window that has the words without its first or without its last line is no part of a shortest one
            level = level.where(F.col("words") - F.greatest("first", "last") < min_run_words)
        if 1 < size < longest:
            wanted = odd.where(f"lines > {size} and lines < {2 * size}")
            heads = level.select("doc", "variant", "pos", "n1", "n2")
            at = [wanted["doc"].eqNullSafe(heads["doc"]), wanted["variant"] == heads["variant"], wanted["pos"] == heads["pos"]]
            headed = wanted.join(heads, at).select(wanted["doc"], wanted["variant"], wanted["pos"], "lines", "n1", "n2")
            between = _beside(headed, level, F.col("lines") - size).select("doc", "variant", "pos", "lines", *_name("lines", "n1", "n2", "m1", "m2"))
            found = found.union(intervals(between).where("later").select("doc", "variant", "pos", "lines"))
        paired = _beside(level, level, F.lit(size))
        paired = paired.select("doc", "variant", "pos", *_name("n1", "n2", "m1", "m2"), (F.col("words") + F.col("more")).alias("words"), "first", F.col("ending").alias("last"))
        level, size = common.materialize(intervals(paired)), size * 2
    return found


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run_words: int = MIN_RUN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """The documents without the later copies of repeated line runs; all columns stay, n_chars follows the text.

    A run of two or more lines, of any length, is deleted from ``min_run_words``
    words on, a line alone from ``min_line_words`` on.

    First is by id, then line; null ids come last. A document that loses every
    line goes; one that loses none keeps its text byte for byte, null included.
    Rows that repeat both id and text are one document and all stay, with the
    same text. Any text length is handled; an empty table gives an empty one.
    """
    inner, names = common.neutral(docs)
    own_id, text = names[id_col], names[text_col]
    windows = runs(inner, own_id, text, min_run_words, min_line_words)
    # windows overlap: each line once
    before = Window.partitionBy("doc", "variant").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    past = F.col("pos") + F.col("lines")
    fresh = windows.select("doc", "variant", past.alias("past"), F.greatest("pos", F.max(past).over(before)).alias("since")).where("since < past")
    gone = (
        fresh.select("doc", "variant", F.explode(F.sequence("since", F.col("past") - 1)).alias("pos"))
        .groupBy("doc", "variant")
        .agg(F.collect_list("pos").alias("gone"))
    )
    keyed = inner.withColumn("own_variant", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(gone, F.col(own_id).eqNullSafe(F.col("doc")) & (F.col("own_variant") == F.col("variant")), "left")
    split = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda k: F.element_at(split, k + 1)), "\n")
    whole = F.col("gone").isNull()
    joined = joined.withColumn("n_left", F.when(whole, 1).otherwise(F.size(left))).where("n_left > 0")
    joined = joined.withColumn(text, F.when(whole, F.col(text)).otherwise(kept))
    if "n_chars" in names:
        joined = joined.withColumn(names["n_chars"], F.when(whole, F.col(names["n_chars"])).otherwise(F.length(text).cast("long")))
    return common.named(joined, names)
