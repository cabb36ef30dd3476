"""Suffix-array dedup: remove every byte under a string of 200 bytes that starts twice.

The plan is the difference-cover one: name sampled suffixes by their prefixes,
go on with names only, sort the remaining suffixes by (distance to their sample,
prefix) and compare neighbours.

1. Sampled suffixes get two names: the tuple of bytes at the sample (64 bits,
   which only group), and the stretch of text under all windows of 200 bytes that
   the sample answers for (128 bits of XXH3, which decide). A sample whose tuple
   is unique has no repeated window; a stretch that occurs twice consists of
   repeated windows only. In texts that repeat themselves, as a run of one byte
   does, the samples of a text with equal names are rows of places at even steps.
2. For the samples in between, at the borders of repeats, every window of the
   sample is a suffix to sort: by tuple, distance and prefix. Neighbours of equal
   key are compared byte by byte; equal ones are repeats.

Which suffixes are sampled is the cover, and both covers give the same result:

* "difference" takes the residues of a perfect difference set modulo 133. Any
  two windows have a sample at one common distance, and each sample answers for
  the 133 windows before it. 12 in 133 suffixes are sampled.
* "content", the default, takes the place of the least 32-byte hash in each
  window of 200 bytes. Equal windows have it at the same distance, and a sample
  answers only for the windows that chose it. About 1 suffix in 85 is sampled.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 200
GRAM = 32
#: A perfect difference set: every distance modulo PERIOD is a difference of two of its members.
PERIOD, RESIDUES = 133, (0, 1, 6, 22, 33, 40, 50, 59, 63, 88, 119, 131)
PIECE = 1 << 20
#: A name with more samples to sort than this is dealt out window by window.
CROWD = 20_000
_ORDER = (1 << 24) - 1
_BASE = 0x9E3779B97F4A7C15

_tables: dict[int, tuple] = {}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, and a random value for each byte."""
    size = 1 << max(n, 1 << 12).bit_length()
    if size not in _tables:
        _tables.clear()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _tables[size] = np.cumprod(up), np.cumprod(down), np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)
    return _tables[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCA9B0D2F1F8B7E35)
    return h ^ (h >> np.uint64(32))


class _Hashes:
    """Hashes of any substrings of a buffer."""

    def __init__(self, raw: np.ndarray):
        up, self.down, byte = _powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(byte[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    grid = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(grid, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def samples(texts: list[bytes], cover: str):
    """Arrays (text, start, count, lead, name, s1, s2): runs of windows that a sample answers for.

    ``start`` is the first window's, ``lead`` its distance to the sample, and s1
    and s2 name all text under the windows, with lead and count. Texts are
    laid end to end; windows across a border are left out. Windows of a text
    longer than a piece fall into pieces.
    """
    found, group, size = [], [], 0
    for k, text in enumerate(texts):
        for lo in range(0, max(len(text) - LENGTH + 1, 0), PIECE - LENGTH + 1):
            part = text[lo : lo + PIECE]
            if size + len(part) > PIECE and group:
                found.append(_samples(group, cover))
                group, size = [], 0
            group.append((k, lo, part))
            size += len(part)
    if group:
        found.append(_samples(group, cover))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found))


def _samples(group, cover):
    sizes = np.array([len(x) for _, _, x in group])
    joined = b"".join(x for _, _, x in group)
    hashes, ends = _Hashes(np.frombuffer(joined, np.uint8)), np.cumsum(sizes)
    offset = np.array([lo for _, lo, _ in group]) - np.r_[0, ends[:-1]]
    begin, count, sample, part, name = (_by_content if cover == "content" else _by_difference)(hashes, sizes, ends, offset)
    lead = sample - begin
    stretch = _digests(joined, begin, begin + count + LENGTH - 1)
    s1 = stretch[:, 0] ^ _mix((lead * 512 + count).astype(np.uint64))
    return np.array([k for k, _, _ in group])[part], begin + offset[part], count, lead, name, s1, stretch[:, 1]


def _digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 (n x 2, 128 bits) of substrings."""
    digest, view = xxhash.xxh3_128_digest, memoryview(raw)
    return np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist())]), np.uint64).reshape(-1, 2)


def _by_content(hashes, sizes, ends, offset):
    grams = hashes.grams(GRAM)
    # of equal hashes the last counts: the order goes down with the position
    keys = (grams & np.uint64(~_ORDER & (1 << 64) - 1)) | (np.uint64(_ORDER) - np.arange(len(grams), dtype=np.uint64))
    at = (np.uint64(_ORDER) - (_least(keys, LENGTH - GRAM + 1) & np.uint64(_ORDER))).astype(np.int64)
    part = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    window = np.arange(len(at))
    inside = window + LENGTH <= ends[part]
    window, at, part = window[inside], at[inside], part[inside]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])])
    return window[first], np.diff(np.r_[first, len(at)]), at[first], part[first], grams[at[first]]


def _by_difference(hashes, sizes, ends, offset):
    part = np.repeat(np.arange(len(sizes)), sizes)
    taken = np.zeros(PERIOD, bool)
    taken[list(RESIDUES)] = True
    sample = np.flatnonzero(taken[(np.arange(len(part)) + offset[part]) % PERIOD])
    part = part[sample]
    begin = np.maximum(sample - PERIOD + 1, ends[part] - sizes[part])
    count = np.minimum(sample, ends[part] - LENGTH) - begin + 1
    some = count > 0
    sample, part = sample[some], part[some]
    return begin[some], count[some], sample, part, hashes.of(sample, sample + LENGTH - PERIOD + 1)


def _long(a: np.ndarray):
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a)


def _bytes(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _classes(cover):
    """(name, s1, s2, n): how often each occurs in this task."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            *_, name, s1, s2 = samples(_bytes(batch.column(0)), cover)
            held.append(np.stack([name, s1, s2], 1))
            size += len(name)
            if size > 2_000_000:
                yield _counted(held)
                held, size = [], 0
        if size:
            yield _counted(held)

    return run


def _counted(held):
    rows = np.concatenate(held)
    rows = rows[np.lexsort(rows.T[::-1])]
    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
    return pa.record_batch([*(_long(np.ascontiguousarray(rows[first, k])) for k in range(3)), pa.array(np.diff(np.r_[first, len(rows)]))], names=["name", "s1", "s2", "n"])


def _pack(start, count, lead):
    return start << 16 | lead << 8 | count


def _unpack(at):
    return at >> 16, at & 255, at >> 8 & 255  # start, count, lead


def _places(cover):
    def run(batches):
        for batch in batches:
            owner, start, count, lead, name, s1, s2 = samples(_bytes(batch.column(1)), cover)
            order = np.lexsort((start, s2, s1, name, owner))
            owner, start, count, lead, name, s1, s2 = (x[order] for x in (owner, start, count, lead, name, s1, s2))
            first, step, times = _steps([owner, name, s1, s2], start)
            row = batch.column(0).to_numpy()[owner[first]]
            columns = [_long(name[first]), _long(s1[first]), _long(s2[first]), pa.array(row), pa.array(_pack(start, count, lead)[first]), pa.array(step), pa.array(times)]
            yield pa.record_batch(columns, names=["name", "s1", "s2", "row", "at", "step", "times"])

    return run


def _steps(keys: list[np.ndarray], start: np.ndarray):
    """Runs of equal keys whose starts go on in even steps: (index of the first, step, how many)."""
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(len(start), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    step = np.r_[0, np.diff(start)]
    step[new] = 0
    turn = ~new & ~np.r_[True, new[:-1]] & (step != np.r_[0, step[:-1]])
    first = np.flatnonzero(new | turn)
    times = np.diff(np.r_[first, len(start)])
    return first, np.where(times > 1, step[np.minimum(first + 1, len(start) - 1)], 0), times


_CONTEXT = "name long, crowd boolean, row long, at long, open boolean, context binary"


def _contexts(batches):
    """The text under the windows of the samples to sort."""
    for batch in batches:
        out = [[] for _ in range(6)]
        for row, text, borders in zip(batch.column(0).to_pylist(), _bytes(batch.column(1)), batch.column(2).to_pylist()):
            for b in borders or ():
                start, count, _ = _unpack(b["at"])
                for column, x in zip(out, (b["name"], b["crowd"], row, b["at"], b["open"], text[start : start + count + LENGTH - 1])):
                    column.append(x)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types)], names=["name", "crowd", "row", "at", "open", "context"])


def _windows(rows):
    """(index of the row, window within it, place of the window in all contexts, contexts end to end)."""
    _, count, _ = _unpack(rows.column("at").to_numpy())
    texts = rows.column("context").to_pylist()
    begin = np.r_[0, np.cumsum([len(x) for x in texts])[:-1]]
    index = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(index)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count)
    return index, nth, begin[index] + nth, b"".join(texts)


def _runs(rows, index, nth):
    """(row, at): runs of consecutive windows, packed without a lead."""
    first = np.flatnonzero(np.r_[True, (index[1:] != index[:-1]) | (nth[1:] != nth[:-1] + 1)]) if len(index) else np.empty(0, int)
    count = np.diff(np.r_[first, len(index)])
    start = _unpack(rows.column("at").to_numpy())[0]
    return pa.record_batch([pa.array(rows.column("row").to_numpy()[index[first]]), pa.array(_pack(start[index[first]] + nth[first], count, 0))], names=["row", "at"])


def _sorted_names(batches):
    """Sort the windows of each name and compare neighbours; rows come sorted by name."""
    for rows in common.contiguous(batches):
        index, nth, at, raw = _windows(rows)
        lead = _unpack(rows.column("at").to_numpy())[2][index] - nth
        name = rows.column("name").to_numpy().view(np.uint64)[index]
        key = _mix(_Hashes(np.frombuffer(raw, np.uint8)).of(at, at + LENGTH) + _mix(name + lead.astype(np.uint64)))
        twice = _repeated(key, at, raw)
        twice &= rows.column("open").to_numpy()[index]
        yield _runs(rows, index[twice], nth[twice])


def _repeated(key: np.ndarray, at: np.ndarray, raw: bytes) -> np.ndarray:
    """Which windows occur twice: sorted by key, neighbours of equal key compared byte by byte."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, places = np.zeros(len(key), bool), at[order].tolist()
    pairs = np.flatnonzero(same)
    equal = np.fromiter((raw[places[k] : places[k] + LENGTH] == raw[places[k + 1] : places[k + 1] + LENGTH] for k in pairs.tolist()), bool, len(pairs))
    if equal.all():
        twice[order] = np.r_[same, False] | np.r_[False, same]
        return twice
    # keys of different windows that agree: by their bytes
    run = np.cumsum(np.r_[True, ~same])
    seen = Counter(zip(run.tolist(), (raw[p : p + LENGTH] for p in places)))
    twice[order] = [seen[r, raw[p : p + LENGTH]] > 1 for r, p in zip(run.tolist(), places)]
    return twice


def _each_window(batches):
    for batch in batches:
        if batch.num_rows:
            batch = pa.Table.from_batches([batch])
            index, nth, at, raw = _windows(batch)
            key = _digests(raw, at, at + LENGTH)
            start, _, lead = _unpack(batch.column("at").to_numpy())
            # the tuple and the distance to it belong to the key: a cover may give a window several samples
            name = batch.column("name").to_numpy().view(np.uint64)[index]
            key = np.stack([key[:, 0] ^ _mix(name + (lead[index] - nth).astype(np.uint64)), key[:, 1]], 1)
            yield pa.record_batch([*(_long(np.ascontiguousarray(key[:, k])) for k in (0, 1)), pa.array(batch.column("row").to_numpy()[index]), pa.array(_pack(start[index] + nth, np.ones(len(nth), np.int64), 0)), pa.array(batch.column("open").to_numpy()[index])], names=["k1", "k2", "row", "at", "open"])


def _spread(found: list[dict]) -> np.ndarray:
    """All places of runs at even steps, sorted."""
    at, step, times = (np.array([x[k] for x in found], np.int64) for k in ("at", "step", "times"))
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return np.sort(np.repeat(at, times) + (nth * np.repeat(step, times) << 16))


def _cut(batches):
    """Spans and remaining bytes of each text from its repeated windows."""
    for batch in batches:
        kept, spans = [], []
        for text, found in zip(_bytes(batch.column(1)), batch.column(2).to_pylist()):
            if not found:
                kept.append(text)
                spans.append([])
                continue
            start, count, _ = _unpack(_spread(found))
            end = np.maximum.accumulate(start + count + LENGTH - 1)
            first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
            lo, hi = start[first], end[np.r_[first[1:] - 1, len(end) - 1]]
            kept.append(b"".join(text[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(text)])))
            spans.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())])
        sizes = [len(x) for x in _bytes(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, cover: str = "content") -> tuple[DataFrame, str]:
    """(id, n_bytes, spans, kept) for every row, and the name of the working table to drop afterwards.

    Every byte that a repeated string of LENGTH bytes covers is in a span;
    spans are maximal, byte offsets, end exclusive; kept is the rest. Matches
    stay within a text, and all rows count, repeated ones too. Null counts as
    empty, texts shorter than LENGTH lose nothing, and null ids stay.
    """
    if cover not in ("content", "difference"):
        raise ValueError(f"a cover is content or difference, not {cover}")
    # the texts are dealt out once; each later join with them moves the other side only
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    texts, table = common.bucketed(rows, "row")

    counted = texts.select("text").mapInArrow(_classes(cover), "name long, s1 long, s2 long, n long")
    pairs = counted.groupBy("name", "s1", "s2").agg(F.sum("n").alias("n"))
    totals = pairs.groupBy("name").agg(F.sum("n").alias("total"), F.max(F.col("n") == 1).alias("border")).where("total > 1")
    live = common.materialize(pairs.join(totals, "name").select("name", "s1", "s2", (F.col("n") > 1).alias("same"), "border", (F.col("total") > crowd).alias("crowd")))

    places = texts.select("row", "text").mapInArrow(_places(cover), "name long, s1 long, s2 long, row long, at long, step long, times long")
    placed = common.materialize(places.join(live, ["name", "s1", "s2"]))
    # at borders, one member stands for all of a repeated stretch: only what is open needs an answer
    stands = placed.where("border and same").groupBy("name", "s1", "s2").agg(F.min(F.struct("row", "at", "crowd")).alias("m")).select("m.row", "m.at", "name", "m.crowd", F.lit(False).alias("open"))
    border = placed.where("border and not same").select("row", "at", "name", "crowd", F.lit(True).alias("open")).unionByName(stands)
    border = border.groupBy("row").agg(F.collect_list(F.struct("name", "crowd", "at", "open")).alias("borders"))
    context = common.materialize(texts.join(border, "row").select("row", "text", "borders").mapInArrow(_contexts, _CONTEXT))
    small = context.where("not crowd").repartition("name").sortWithinPartitions("name").mapInArrow(_sorted_names, "row long, at long")
    each = context.where("crowd").mapInArrow(_each_window, "k1 long, k2 long, row long, at long, open boolean")
    # written first, so that the join can split the windows of a very frequent string
    twice = common.materialize(each.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1", "k2"))
    large = each.where("open").join(twice, ["k1", "k2"], "left_semi").select("row", "at")

    alone = small.union(large).select("row", "at", F.lit(0).cast("long").alias("step"), F.lit(1).cast("long").alias("times"))
    windows = placed.where("same").select("row", "at", "step", "times").union(alone).groupBy("row").agg(F.collect_list(F.struct("at", "step", "times")).alias("found"))
    id_type = docs.schema[id_col].dataType.simpleString()
    joined = texts.join(windows, "row", "left").select("id", "text", "found")
    return joined.mapInArrow(_cut, f"id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"), table
