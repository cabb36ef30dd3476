"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CAPACITY = 1024
END_ID = 2

_LOADED: dict[str, object] = {}


def _exact(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def _ranks(path: str):
    """The same vocabulary as ranks, whose library finds the same ids faster; None if it has no such file."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    if ranks not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        _LOADED[ranks] = None
        if os.path.exists(ranks):
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            _LOADED[ranks] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    return _LOADED[ranks]


def token_ids(text: str, path: str) -> list[int]:
    """The ids of ``tokenizers`` for this vocabulary, without special tokens added.

    Ordinary Latin text goes through the ranks. Special tokens' strings and
    other scripts, where the libraries' Unicode classes may differ, do not.
    """
    fast = _ranks(path)
    if fast is None or "<|" in text or not (text.isascii() or max(text) < "\u0250"):
        return _exact(path).encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids, task, nth): token ids cut to the capacity.

    A document is its ids and one end id. Only longer ones are cut; the first
    piece takes the remainder. Null text counts as empty: one end id. ``ids`` is
    binary, little-endian unsigned 32 bits. ``nth`` numbers the pieces of equal
    length within a task.
    """

    def cut(batches):
        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[], [], [], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = token_ids(text or "", path)
                    ids.append(END_ID)
                    raw = np.array(ids, "<u4").tobytes()
                    at, k = 0, 0
                    while at < len(ids):
                        size = len(ids) % capacity or capacity if not at else capacity
                        nth = seen[size] = seen.get(size, -1) + 1
                        for column, x in zip(out, (doc, k, at, size, raw[4 * at : 4 * (at + size)], task, nth)):
                            column.append(x)
                        at, k = at + size, k + 1
                yield pa.record_batch([pa.array(out[0], part.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.int32()), pa.array(out[6], pa.int64())], names=[id_col, "piece", "start", "length", "ids", "task", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids binary, task int, nth long")


def fullest(counts: dict[int, int], room: int, longest_first: bool = True) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``: {length: how many}.

    Subset sums are bits of one integer. Lengths are added in order, and the
    scan stops once ``room`` itself is reached.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=longest_first):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, take = left - take, take * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a bin, how many such bins)] that use up the histogram, by the scan order that needs fewer bins."""
    return min((_plan(counts, capacity, longest_first) for longest_first in (True, False)), key=lambda bins: sum(n for _, n in bins))


def _plan(counts, capacity, longest_first):
    """Each bin takes the longest length left and the fullest combination for the rest.

    The combination stays the best one until a length runs out, so it is taken
    as often as it fits: the work depends on the number of different lengths,
    not of pieces.
    """
    left, bins = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        chosen = fullest({x: n for x, n in rest.items() if n}, capacity - seed, longest_first)
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(left[x] // n for x, n in chosen.items())
        bins.append((chosen, times))
        for x, n in chosen.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece (columns length, task, nth) a sequence_id and an offset, gapless from 0.

    Pieces of a length are numbered by counts per task, so no length, however
    common, is gathered in one place. The driver sees one row per length (at
    most ``capacity``); the plan it returns has a row per length of a bin kind
    and is broadcast: its size depends on the capacity alone.
    """
    spark = cut.sparkSession
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_task = common.materialize(per_task)
    by_length = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    used, base, rows = dict.fromkeys(by_length, 0), 0, []
    for chosen, times in plan(by_length, capacity):
        offset = 0
        for length, many in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + many * times, many, base, offset))
            used[length] += many * times
            offset += length * many
        base += times
    schema = "length long, first long, past long, many long, base long, offset0 long"
    places = F.broadcast(spark.createDataFrame(rows, schema))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = cut.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(places, "length").where("rank >= first and rank < past")
    here = F.col("rank") - F.col("first")
    return placed.withColumn("sequence_id", F.col("base") + F.floor(here / F.col("many"))).withColumn("offset", F.col("offset0") + here % F.col("many") * F.col("length")).drop("before", "rank", "first", "past", "many", "base", "offset0", "task", "nth")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into as few sequences of at most ``capacity`` tokens as minimum bin slack finds.

    Returns a row per piece: id, piece, start, length, ids (binary; without
    ``keep_ids`` only their crc32 as ids_crc32), sequence_id, offset. Repeated
    and null ids are packed like any other row; an empty table packs to none.
    The pieces are written once to the shared folder, so the texts are
    tokenised once.
    """
    cut = pieces(docs, path, capacity, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    cut = common.materialize(cut if keep_ids else cut.drop("ids"))
    return assign(cut, capacity)
