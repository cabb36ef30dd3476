"""LM scoring with Brown class-based n-grams.

Every training word gets a class by exchange. The most frequent words start it:
each moves, one after the other, to the class that raises the likelihood of the
class bigrams most. Then all other words move in parallel rounds on Spark, from
the counts of the classes before and after all their occurrences: in the first
round next to the words that started, then next to all words. Counts and gains
are integers, so classes do not depend on how the texts are dealt out.

A token's probability is P(its class | class of the word before it) * P(word |
class). Each class keeps the mass that absolute discounting frees for words that
training did not see; class transitions are smoothed toward the class
frequencies, which are also the context after an unseen word. Over the training
words and one unseen word the probabilities sum to 1 in every context.

Texts are tokenised twice: once to count words, once to write them as numbers.
The most frequent words (``head``) have numbers and travel in arrays; all other
occurrences are shuffled by the word once and kept as one row per word, with the
numbers before and after each and the texts they are in: rounds and scores start
from those rows. Which words are in the head changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

CLASSES = 16
#: Words that start the exchange; a square table of their bigrams reaches the driver.
CLUSTERED = 1024
#: Frequent words that are known by number everywhere; all others are shuffled.
HEAD = 1 << 17
#: Rounds in which all other words move.
ROUNDS = 2
SWEEPS = 12
SMOOTH = 1.0
#: The end token; no word holds a line break. Its class, 0, is also the context of a text's first token.
END = b"\n"
#: A number before or after that is none: a word outside the head, the start of a text.
_TAIL, _START = -1, -2
_FLUSH = 1_000_000
_BLOCK = 1024
#: A count and its place within a block in one integer.
_PLACE = 20
#: Parts that occurrences outside the training texts are dealt to: a word that training did not see may be frequent there.
_PARTS = 8
#: Groups of tasks whose counts are added up first.
_SALTS = 64


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space, then one end."""
    words = (text or "").encode().lower().split()
    words.append(END)
    return words


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts end to end, as ``tokens`` has them but without ends, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, owner = parts.flatten().cast(pa.binary()), np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    return words.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c): how often each token occurs in all given documents."""

    def count(batches):
        held, n = [], 0
        for batch in common.sliced(batches):
            seen = pa.concat_arrays([pc.value_counts(_words(batch.column(0))[0]), pa.array([(END, batch.num_rows)], pa.struct({"values": pa.binary(), "counts": pa.int64()}))])
            held.append(pa.record_batch([seen.field(0), seen.field(1)], names=["word", "c"]))
            n += len(seen)
            if n > _FLUSH:
                held = added(held)
                n = sum(part.num_rows for part in held)
                if n > _FLUSH // 2:
                    yield from held
                    held, n = [], 0
        if held:
            yield from added(held)

    def added(held):
        return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"]).to_batches()

    return docs.select(text_col).mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent words, the end token first; a word's number is its place."""

    words: list[bytes]
    counts: np.ndarray


def head_of(counts: DataFrame, size: int) -> Head:
    """The ``size`` most frequent words of a corpus, ties by the word; none of an empty one."""
    top = counts.orderBy((F.col("word") == F.lit(END)).desc(), F.desc("c"), "word").limit(size).toArrow()
    return Head(top["word"].to_pylist(), top["c"].to_numpy().astype(np.int64))


def encode(docs: DataFrame, head: Head, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, learn, ids, rest): each text as numbers of head words (int32, _TAIL for others) and its other words. Written once."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(head.words, pa.binary()))

    def run(batches):
        known = shared.value
        end = 0 if len(known) else _TAIL
        for batch in common.sliced(batches):
            words, sizes = _words(batch.column(3))
            found = pc.fill_null(pc.index_in(words, known), _TAIL).to_numpy()
            others = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[found < 0], minlength=len(sizes))
            rest = pc.binary_join(pa.ListArray.from_arrays(_offsets(others), words.filter(pa.array(found < 0))), b" ")
            if end == _TAIL:  # without a corpus
                rest = pa.array([b" ".join([x, END] if x else [END]) for x in rest.to_pylist()], pa.binary())
            ids = np.insert(found, np.cumsum(sizes), end).astype(np.int32)
            yield pa.record_batch([*batch.columns[:3], _pieces(ids, sizes + 1), rest], names=["row", "id", "learn", "ids", "rest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), learn.alias("learn"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return common.materialize(rows.mapInArrow(run, f"row long, id {kind}, learn boolean, ids binary, rest binary"))


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))


def _pieces(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive stretches of a flat array, as binary values."""
    offsets = _offsets(sizes * values.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


def _values(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in binary values end to end, and how many each has."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


def _flat(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of many texts end to end, those before them, and the place of each one's text."""
    ids, sizes = _values(column, np.int32)
    ids = ids.astype(np.int64)
    before = np.r_[_START, ids[:-1]] if len(ids) else ids
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = _START
    return ids, before, np.repeat(np.arange(len(sizes)), sizes)


def seed_bigrams(corpus: DataFrame, n: int) -> np.ndarray:
    """Counts (n x n) of the first n head words straight after one another; a text's start counts as the end token."""

    def count(batches):
        total = np.zeros(n * n, np.int64)
        for batch in common.sliced(batches):
            ids, before, _ = _flat(batch.column(0))
            before = np.where(before == _START, 0, before)
            both = (ids >= 0) & (ids < n) & (before >= 0) & (before < n)
            np.add.at(total, before[both] * n + ids[both], 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            yield pa.record_batch([pa.array(part), pa.array(total[part])], names=["pair", "c"])

    found = corpus.select("ids").mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros(n * n)
    table[found["pair"].to_numpy()] = found["c"].to_numpy()
    return table.reshape(n, n)


def _xlogx(a):
    return a * np.log(np.maximum(a, 1e-300))


def exchange(table: np.ndarray, classes: int = CLASSES, rounds: int = SWEEPS) -> np.ndarray:
    """The class of each word, by exchange: class 0 is the end token's alone, all others move freely."""
    n = len(table)
    label = np.r_[0, 1 + np.arange(n - 1) % (classes - 1)]
    one = np.eye(classes)[label]
    after, before = table @ one, table.T @ one  # (word, class): followed by, preceded by
    pair = one.T @ after
    own = np.diag(table)
    for _ in range(rounds):
        moved = 0
        for w in range(1, n):
            old, out, into, self_ = label[w], after[w].copy(), before[w].copy(), own[w]
            if out.sum() + into.sum() == 0:
                continue
            out[old] -= self_
            into[old] -= self_
            # take the word out of its class
            pair[old] -= out
            pair[:, old] -= into
            pair[old, old] -= self_
            rows, columns = pair.sum(1), pair.sum(0)
            best = np.full(classes, -np.inf)
            gain_row = (_xlogx(pair + out) - _xlogx(pair)).sum(1)
            gain_column = (_xlogx(pair + into[:, None]) - _xlogx(pair)).sum(0)
            diagonal = np.arange(classes)
            d = pair[diagonal, diagonal]
            corner = _xlogx(d + out + into + self_) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
            best = gain_row + gain_column + corner - (_xlogx(rows + out.sum() + self_) - _xlogx(rows)) - (_xlogx(columns + into.sum() + self_) - _xlogx(columns))
            best[0] = -np.inf
            new = int(np.argmax(best))
            pair[new] += out
            pair[:, new] += into
            pair[new, new] += self_
            if new != old:
                moved += 1
                label[w] = new
                after[:, old] -= table[:, w]
                after[:, new] += table[:, w]
                before[:, old] -= table[w]
                before[:, new] += table[w]
        if not moved:
            break
    return label


def gains(moves: np.ndarray) -> np.ndarray:
    """(2 * classes, classes) integers: what an occurrence next to a class is worth in each class; first classes before, then after."""
    some = moves + 0.5
    into, out = np.log(some) - np.log(some.sum(0)), np.log(some.T) - np.log(some.sum(1))
    return np.round(np.concatenate([into, out]) * 65536).astype(np.int64)


def choose(contexts: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The class of most gain for each row of counts (integers); class 0 is the end token's, the first of equals counts."""
    return 1 + np.argmax((contexts @ gain)[:, 1:], axis=1)


class _Cells:
    """Counts of (head word, class before or after) in one task, sent as blocks of words."""

    def __init__(self, size: int, width: int):
        self.width, self.cells = width, np.zeros(-(-max(size, 1) // _BLOCK) * _BLOCK * width, np.uint32)

    def add(self, word: np.ndarray, cell: np.ndarray):
        np.add.at(self.cells, word * self.width + cell, np.uint32(1))

    def blocks(self):
        for k, block in enumerate(self.cells.reshape(-1, _BLOCK * self.width)):
            if block.any():
                yield k, _packed(block)


def _packed(block: np.ndarray) -> bytes:
    at = np.flatnonzero(block)
    return (block[at].astype(np.int64) << _PLACE | at).tobytes()


def _unpacked(cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places, each once, and counts."""
    both = np.frombuffer(cells, np.int64)
    return both & (1 << _PLACE) - 1, both >> _PLACE


def _summed(blocks: DataFrame, size: int) -> DataFrame:
    """(block, cells): blocks of counts added up, in two steps, so that no task gets one from every other."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = _unpacked(cells)
                if k not in total:
                    total[k] = np.zeros(size, np.int64)
                total[k][at] += n
        for k, cells in total.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([_packed(cells)], pa.binary())], names=["block", "cells"])

    some = blocks.repartition("block", F.pmod(F.spark_partition_id(), F.lit(_SALTS))).mapInArrow(add, "block int, cells binary")
    return some.repartition("block").mapInArrow(add, "block int, cells binary")


def _head_contexts(corpus: DataFrame, label, classes: int) -> DataFrame:
    """(block, cells) of head words next to head words."""

    def count(batches):
        own = label.value
        cells = _Cells(len(own), 2 * classes)
        for batch in common.sliced(batches):
            ids, before, _ = _flat(batch.column(0))
            first = (before == _START) & (ids >= 0)
            cells.add(ids[first], np.zeros(first.sum(), np.int64))
            both = (ids >= 0) & (before >= 0)
            here, there = ids[both], before[both]
            for word, klass, side in ((here, own[there], 0), (there, own[here], classes)):
                cells.add(word[klass >= 0], klass[klass >= 0] + side)
        for k, block in cells.blocks():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([block], pa.binary())], names=["block", "cells"])

    return corpus.select("ids").mapInArrow(count, "block int, cells binary")


def occurrences(corpus: DataFrame) -> DataFrame:
    """(word, part, c, cls, near, rows, places): the occurrences of each word outside the head in one row, written once.

    ``near`` are the numbers before and after (int32), ``rows`` (int64) and
    ``places`` (int32) where they are. Part 0 has all of the training texts, of
    which there are fewer than of any head word; those of other texts are dealt
    out by their row. c counts part 0, and nothing has a class yet.
    """

    def run(batches):
        for batch in common.sliced(batches):
            ids, before, owner = _flat(batch.column(2))
            at = np.flatnonzero(ids < 0)
            after = np.r_[ids[1:], _TAIL][at]
            after[np.r_[owner[1:] != owner[:-1], True][at] if len(owner) else []] = _TAIL  # without a corpus the end itself is unseen
            first = np.searchsorted(owner, np.arange(batch.num_rows))
            row = batch.column(0).to_numpy()
            part = np.where(batch.column(1).to_numpy(zero_copy_only=False), 0, 1 + row % _PARTS)
            columns = [_rest(batch.column(3)), *(pa.array(x) for x in (part[owner[at]].astype(np.int32), row[owner[at]], (at - first[owner[at]]).astype(np.int32), before[at] & 0xFFFFFFFF | after << 32))]
            whole = pa.record_batch(columns, names=["word", "part", "row", "place", "near"])
            for lo in range(0, len(at), 100_000):
                yield whole.slice(lo, 100_000)

    def gather(batches):
        for rows in common.contiguous(batches, 2):
            word, part = (rows.column(k).combine_chunks() for k in ("word", "part"))
            first = np.r_[True, pc.or_(pc.not_equal(word[1:], word[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False)]
            sizes = np.diff(np.r_[np.flatnonzero(first), len(first)])
            row, place, near = (rows.column(k).to_numpy() for k in ("row", "place", "near"))
            word, part = word.filter(pa.array(first)), part.filter(pa.array(first))
            c = np.where(part.to_numpy() == 0, sizes, 0)
            yield pa.record_batch([word, part, pa.array(c), pa.array(np.full(len(sizes), -1, np.int32)), _pieces(near, sizes), _pieces(row, sizes), _pieces(place, sizes)], names=["word", "part", "c", "cls", "near", "rows", "places"])

    apart = corpus.select("row", "learn", "ids", "rest").mapInArrow(run, "word binary, part int, row long, place int, near long")
    return common.materialize(apart.repartition("word", "part").sortWithinPartitions("word", "part").mapInArrow(gather, "word binary, part int, c long, cls int, near binary, rows binary, places binary"))


def _rest(column) -> pa.Array:
    """The words outside the head of many texts, end to end."""
    return pc.split_pattern(column.filter(pc.greater(pc.binary_length(column), 0)), b" ").flatten()


def tail_pairs(corpus: DataFrame) -> DataFrame:
    """(one, two): words outside the head straight after one another."""

    def run(batches):
        for batch in common.sliced(batches):
            ids, before, _ = _flat(batch.column(0))
            words, second = _rest(batch.column(1)), np.flatnonzero(before[ids < 0] == _TAIL)
            yield pa.record_batch([words.take(pa.array(second - 1)), words.take(pa.array(second))], names=["one", "two"])

    return corpus.select("ids", "rest").mapInArrow(run, "one binary, two binary")


_COUNTED = "word binary, c long, cls int, near binary, contexts binary, block int, cells binary"


def _tail_contexts(label, classes: int, last: bool):
    """From rows of words outside the head (kind 0) and what their neighbours outside it tell them: their contexts, but for the last time;
    what head words next to them get from their classes; their transitions (block -1)."""

    def run(batches):
        own = label.value
        cells, moves = _Cells(len(own), 2 * classes), np.zeros(classes * classes, np.int64)
        known = np.r_[own, 0, -1]  # ... of the start, of no number
        width, names = 2 * classes, [part.split()[0] for part in _COUNTED.split(", ")]
        for rows in common.contiguous(batches):
            kind, k, n = (rows.column(name).to_numpy().astype(np.int64) for name in ("kind", "cls", "n"))
            words = rows.filter(pa.array(kind == 0))
            group, size = np.searchsorted(np.flatnonzero(kind == 0), np.arange(len(kind)), "right") - 1, words.num_rows
            near, cls = words.column("near").combine_chunks(), k[kind == 0]
            numbers, sizes = _values(near, np.int32)
            x, y = numbers.astype(np.int64).reshape(-1, 2).T
            here = np.repeat(np.arange(size), sizes // 2)
            before, after, mine = known[x], known[y], cls[here]
            a, b, one, two = before >= 0, after >= 0, kind == 1, kind == 2
            # a transition counts at its second word; those into head words are in their contexts
            into = np.r_[before[a] * classes + mine[a], k[one] * classes + cls[group[one]]]
            classed = np.r_[mine[a], cls[group[one]]] >= 0
            moves += np.bincount(into[classed], np.r_[np.ones(a.sum()), n[one]][classed], classes * classes).astype(np.int64)
            for number, side in ((x, classes), (y, 0)):
                beside = (number >= 0) & (mine >= 0)
                cells.add(number[beside], mine[beside] + side)
            if last:
                continue
            at = np.r_[here[a] * width + before[a], here[b] * width + classes + after[b], group[one] * width + k[one], group[two] * width + classes + k[two]]
            total = np.bincount(at, np.r_[np.ones(a.sum() + b.sum()), n[one], n[two]], size * width).astype(np.int64)
            at = np.flatnonzero(total)
            contexts = _pieces(total[at] << 8 | at % width, np.bincount(at // width, minlength=size))
            columns = [words.column("word").combine_chunks(), pa.array(n[kind == 0]), pa.array(cls.astype(np.int32)), near, contexts, pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())]
            yield pa.record_batch(columns, names=names)
        for k, block in [*cells.blocks(), (-1, _packed(moves))]:
            yield pa.record_batch([pa.array([None], t) for t in (pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())] + [pa.array([k], pa.int32()), pa.array([block], pa.binary())], names=names)

    return run


def _move(gain: np.ndarray):
    """Each word outside the head to its class of most gain."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                packed, sizes = _values(part.column(3), np.int64)
                contexts = np.zeros((part.num_rows, len(gain)), np.int64)
                contexts[np.repeat(np.arange(part.num_rows), sizes), packed & 255] = packed >> 8
                yield pa.record_batch([part.column(0), part.column(1), pa.array(choose(contexts, gain).astype(np.int32)), part.column(2)], names=["word", "c", "cls", "near"])

    return run


def _counted(corpus: DataFrame, tail: DataFrame, pairs: DataFrame | None, label: np.ndarray, classes: int, last: bool):
    """Under the present classes: counts of head words, contexts of the others, transitions between classes, and the frame behind them.

    ``pairs`` is left out while no word outside the head has a class.
    """
    spark = corpus.sparkSession
    shared = spark.sparkContext.broadcast(label)
    rows = tail.select("word", F.lit(0).cast("tinyint").alias("kind"), "cls", F.col("c").alias("n"), "near")
    if pairs is not None:
        classed = tail.select("word", "cls")

        def told(kind, own, other):
            beside = pairs.join(classed.withColumnRenamed("word", other), other)
            return beside.select(F.col(own).alias("word"), F.lit(kind).cast("tinyint").alias("kind"), "cls", "n", F.lit(None).cast("binary").alias("near"))

        rows = rows.union(told(1, "two", "one")).union(told(2, "one", "two")).repartition("word").sortWithinPartitions("word", "kind")
    met = rows.mapInArrow(_tail_contexts(shared, classes, last), _COUNTED)
    if not last:
        met = common.materialize(met)
    blocks = _head_contexts(corpus, shared, classes).union(met.where("block is not null").select("block", "cells"))
    cells, moves = np.zeros((max(len(label), 1), 2 * classes), np.int64), np.zeros((classes, classes), np.int64)
    for row in _summed(blocks, max(2 * classes * _BLOCK, classes * classes)).toLocalIterator():
        at, n = _unpacked(row["cells"])
        into, at = (moves.reshape(-1), at) if row["block"] < 0 else (cells.reshape(-1), at + row["block"] * _BLOCK * 2 * classes)
        into[at] += n
    for k in range(classes):
        moves[:, k] += cells[: len(label)][label == k, :classes].sum(0)
    return cells, met.where("block is null").select("word", "c", "near", "contexts"), moves, met


@dataclass
class Model:
    head: Head
    label: np.ndarray  # the class of each head word
    tail: DataFrame  # word, c, cls of all other training words
    total: int  # training tokens, ends included
    types: int  # distinct training tokens
    transition: np.ndarray  # log10 P(class | class before); the last row after an unseen word
    discount: np.ndarray
    mass: np.ndarray  # tokens of each class
    unseen: np.ndarray  # log10 P(an unseen word | class before)

    @property
    def words(self) -> DataFrame:
        """(word, c, cls): every training word once."""
        rows = list(zip(self.head.words, self.head.counts.tolist(), self.label.tolist()))
        return self.tail.sparkSession.createDataFrame(rows, "word binary, c long, cls int").union(self.tail)


def fit(corpus: DataFrame, words: DataFrame, head: Head, classes: int = CLASSES, clustered: int = CLUSTERED, rounds: int = ROUNDS) -> Model:
    """Classes and probabilities from an encoded corpus (all its rows) and its ``occurrences`` (part 0)."""
    if not 2 <= classes <= 128:
        raise ValueError("there are 2 to 128 classes")
    seeds = min(clustered, len(head.words))
    label = np.full(len(head.words), -1)
    label[:seeds] = exchange(seed_bigrams(corpus, seeds), classes) if seeds else 0
    pairs = common.materialize(tail_pairs(corpus).groupBy("one", "two").agg(F.count("*").alias("n")))
    tail, old = words.where("part = 0").select("word", "c", "cls", "near"), None
    for turn in range(rounds + 1):
        cells, contexts, moves, met = _counted(corpus, tail, pairs if turn else None, label, classes, turn == rounds)
        if turn == rounds:
            break
        gain = gains(moves)
        rest = np.arange(seeds, len(label))
        label[rest] = choose(cells[rest], gain)
        tail = common.materialize(contexts.mapInArrow(_move(gain), "word binary, c long, cls int, near binary"))
        for frame in (met, old):
            if frame is not None:
                common.drop(frame)
        old = tail
    common.drop(pairs)
    return _model(head, label, tail.select("word", "c", "cls"), moves, classes)


def _model(head: Head, label: np.ndarray, tail: DataFrame, moves: np.ndarray, classes: int) -> Model:
    stats = tail.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2")).collect()
    of_head = lambda weights: np.bincount(label, weights, classes)
    mass, types, once, twice = of_head(head.counts), of_head(None).astype(float), of_head(head.counts == 1), of_head(head.counts == 2)
    for r in stats:
        for total, x in ((mass, "n"), (types, "v"), (once, "n1"), (twice, "n2")):
            total[r["cls"]] += r[x]
    # every class but the end's can hold unseen words
    share = (mass + 0.5) / (mass + 0.5).sum()
    transition = np.concatenate([(moves + SMOOTH * share) / (moves.sum(1, keepdims=True) + SMOOTH), share[None]])
    discount = np.clip(np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5), 0.01, 0.99)
    discount[0] = 0.0 if mass[0] else 1.0
    free = np.where(mass > 0, discount * types / np.maximum(mass, 1), 1.0)
    free[0] = 0.0 if mass[0] else 1.0
    return Model(head, label, tail, int(mass.sum()), int(types.sum()), np.log10(transition), discount, mass, np.log10(np.maximum(transition @ free, 1e-300)))


def train(docs: DataFrame, text_col: str = "text", classes: int = CLASSES, clustered: int = CLUSTERED, head: int = HEAD, rounds: int = ROUNDS) -> Model:
    """Learn from all given documents.

    Null texts are an end only, repeated rows count as often as they occur, and
    a text of any length is handled whole; without any document all words are
    unseen. Ids are not read, so null or repeated ones change nothing.
    """
    words = head_of(word_counts(docs, text_col), max(head, clustered))
    corpus = encode(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), words, F.lit(True))
    others = occurrences(corpus)
    model = fit(corpus, others, words, classes, clustered, rounds)
    common.drop(corpus)
    common.drop(others)
    return model


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """Learn from the rows where ``learn`` holds and score all rows: (the model, (id, learn, n_tokens, n_known, base_score, score))."""
    words = head_of(word_counts(docs.where(learn), text_col), HEAD)
    corpus = encode(docs, words, learn, id_col, text_col)
    others = occurrences(corpus)
    model = fit(corpus.where("learn"), others, words)
    return model, _scored(corpus, others, model).withColumnRenamed("id", id_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for every row; scores are log10 probabilities of whole texts.

    One row out for one row in, also for null or repeated ids; a null text is an
    end only. Other columns are dropped, so no name can clash.
    """
    corpus = encode(docs, model.head, F.lit(False), id_col, text_col)
    return _scored(corpus, occurrences(corpus), model).drop("learn").withColumnRenamed("id", id_col)


def _scored(corpus: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """Head words are scored in one pass; all others, as ``occurrences`` has them, join the word table and meet by text."""
    floor, norm, classes = 0.5, model.total + 0.5 * (model.types + 1), len(model.mass)
    c, label = model.head.counts, model.label
    with np.errstate(divide="ignore", invalid="ignore"):
        emit = np.log10((c - model.discount[label]) / model.mass[label])
    shared = corpus.sparkSession.sparkContext.broadcast((label, np.log10((c + floor) / norm), emit, model.transition))
    kind = corpus.schema["id"].dataType.simpleString()

    def pass_over(batches):
        label, base_of, emit_of, transition = shared.value
        known = np.r_[label, 0, -1].astype(np.int64)  # ... of the start, of a word outside the head
        for batch in common.sliced(batches):
            ids, before, owner = _flat(batch.column(3))
            seen = ids >= 0
            here, cls, last = ids[seen], known[ids[seen]], known[before[seen]]
            both = last >= 0
            per_text = lambda at, weights=None: np.bincount(at, weights, batch.num_rows).astype(np.int64 if weights is None else float)
            total = per_text(owner[seen], emit_of[here]) + per_text(owner[seen][both], transition[last[both], cls[both]])
            yield pa.record_batch([*batch.columns[:3], *(pa.array(x) for x in (per_text(owner), per_text(owner[seen]), per_text(owner[seen], base_of[here]), total))], names=["row", "id", "learn", "n_tokens", "h_known", "h_base", "h_score"])

    whole = corpus.select("row", "id", "learn", "ids").mapInArrow(pass_over, f"row long, id {kind}, learn boolean, n_tokens long, h_known long, h_base double, h_score double")

    others = corpus.sparkSession.sparkContext.broadcast((np.r_[label, 0, -1], model.transition, model.unseen, model.discount, np.maximum(model.mass, 1)))

    def apart(batches):
        known, transition, unseen, discount, mass = others.value
        step = np.c_[transition, unseen]  # into an unseen word last
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                c, cls, near, rows, places = batch.slice(lo, 2_000).columns
                cls = pc.fill_null(cls, classes).to_numpy()
                c = pc.fill_null(c, 0).to_numpy()
                emission = np.zeros(len(c))
                seen = cls < classes
                emission[seen] = np.log10((c[seen] - discount[cls[seen]]) / mass[cls[seen]])
                x, y = known[_values(near, np.int32)[0]].reshape(-1, 2).T
                row, sizes = _values(rows, np.int64)
                place, here = _values(places, np.int32)[0].astype(np.int64), np.repeat(np.arange(len(c)), sizes)
                mine = cls[here]
                score = emission[here] + np.where(x < 0, 0.0, step[x, mine]) + np.where(y < 0, 0.0, step[mine, y])
                out = pa.record_batch([pa.array(row), pa.array(place << 8 | mine), pa.array(np.log10((c + floor) / norm)[here]), pa.array(score)], names=["row", "at", "base", "score"])
                for lo in range(0, len(row), 100_000):
                    yield out.slice(lo, 100_000)

    def together(batches):
        step = np.c_[others.value[1], others.value[2]]
        for rows in common.contiguous(batches):
            row, at, base, score = (column.to_numpy() for column in rows.columns)
            first = np.r_[True, row[1:] != row[:-1]]
            group, cls = np.cumsum(first) - 1, at & 255
            beside = np.flatnonzero(~first & (np.diff(at >> 8, prepend=-2) == 1))  # two words outside the head
            pair = np.bincount(group[beside], step[cls[beside - 1], cls[beside]], first.sum())
            yield pa.record_batch([pa.array(x) for x in (row[first], np.bincount(group, cls < classes).astype(np.int64), np.bincount(group, base), np.bincount(group, score) + pair)], names=["row", "known", "base", "score"])

    told = words.select("word", "near", "rows", "places").join(model.tail, "word", "left").select("c", "cls", "near", "rows", "places")
    alone = told.mapInArrow(apart, "row long, at long, base double, score double").repartition("row").sortWithinPartitions("row", "at")
    rest = alone.mapInArrow(together, "row long, known long, base double, score double")
    zero = lambda x: F.coalesce(x, F.lit(0))
    return whole.join(rest, "row", "left").select(
        "id", "learn", "n_tokens", (F.col("h_known") + zero("known")).alias("n_known"), (F.col("h_base") + zero("base")).alias("base_score"), (F.col("h_score") + zero("score")).alias("score")
    )
