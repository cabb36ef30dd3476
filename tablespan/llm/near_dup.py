"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints with at most four differing bits have a 32-bit half with
at most two. In each half, 31 bits are covered by the Hamming [31, 26] code: it
is perfect with covering radius 1, so a point midway between two such halves has
a code word within 1, and that word is within 1 + 1 of both. Replicating every
fingerprint to the code words within covering radius plus (half the) threshold,
at most 16 in each half, therefore brings every linked pair to a common anchor.

By similarity instead of bits: shingle sets of Jaccard similarity s make a bit
differ with probability arccos(2s / (1 + s)) / pi. Further fingerprint words of
the same shingles give more halves and more bits to measure by; those travel
with the anchors. Not every pair has a close half, so bands of least hashes are
further anchors: a band of ROWS agrees with probability s ** ROWS. Anchors and
bits only propose: what may be linked is gathered into clusters by forests, never
by all pairs of an anchor, and within a cluster the distinct shingles decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 4
WORDS = 4
#: By similarity: shingles of five words; the first MEASURE words of a fingerprint are compared, LANES further ones have anchors.
SIMILARITY, SIMILAR_WORDS, MEASURE, LANES = 0.8, 5, 3, 4
#: Bands of least hashes: at similarity 0.8 none of them agrees for 1 pair in 14,000.
BANDS, ROWS = 24, 5
#: Texts are gathered up to this many standard deviations above the expected bits, and pairs are taken as good ones to begin with below it by SURE.
LAX, SURE = 4.0, 2.0
#: Pairs of one text that are judged in one place.
HUB = 256
#: Texts and shingles of a cluster that are compared with one another in one place; larger clusters are dealt out as pairs of blocks.
CLUSTER_TEXTS, CLUSTER_GRAMS = 512, 500_000
SEED = 42
#: Rows of one anchor that are compared in one place; larger groups are split into blocks.
BLOCK = 1 << 14
_SMALL = 64


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words than a shingle has: of all of them; no words: none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts, width = ends - sizes, min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    last = len(parts) - width + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist())), np.uint64, last)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: str | None, words: int = WORDS) -> int:
    """The 64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes; no words: 0."""
    return _majority(_shingle_hashes(text, words))


def wide_simhash(text: str | None, words: int = SIMILAR_WORDS, lanes: int = MEASURE + LANES) -> list[int]:
    """The fingerprint, and further words of it from remixed hashes of the same shingles."""
    return _wide(_shingle_hashes(text, words), lanes)


def _wide(hashes: np.ndarray, lanes: int = MEASURE + LANES) -> list[int]:
    found = [_majority(hashes)]
    for lane in range(1, lanes):
        h = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        found.append(_majority(h ^ (h >> np.uint64(31))))
    return found


def bands(distinct: np.ndarray) -> list[int]:
    """A hash for each band of least hashes of a shingle set; nothing for an empty one: 0."""
    if not len(distinct):
        return [0] * BANDS
    rng = np.random.default_rng(SEED)
    mask, odd, mix = (rng.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(k) for k in (0, 1, 1))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(distinct), 1024):
        mixed = (distinct[None, lo : lo + 1024] ^ mask[:, None]) * odd[:, None]
        np.minimum(least, mixed.min(1), out=least)
    least = (least ^ (least >> np.uint64(32))) * mix
    return (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).tolist()


def differing(similarity: float) -> float:
    """The expected share of differing bits of two shingle sets of this Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long. Null and empty texts have 0."""

    def scan(batches):
        for batch in common.sliced(batches):
            found = np.fromiter((simhash(x, words) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long")


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SIMILAR_WORDS) -> DataFrame:
    """(id, variant, fp, key, wide): a hash of the text, the fingerprint, a digest of the distinct shingles, and all words of the fingerprint and the bands."""

    def row(text):
        hashes = _shingle_hashes(text, words)
        distinct = np.unique(hashes)
        return [*_wide(hashes), *bands(distinct), xxhash.xxh64_intdigest(distinct.tobytes(), SEED)]

    def scan(batches):
        for batch in common.sliced(batches):
            found = np.array([row(x) for x in batch.column(2).to_pylist()], np.uint64).reshape(batch.num_rows, MEASURE + LANES + BANDS + 1)
            fp, key = (pa.array(found[:, k].copy().view(np.int64)) for k in (0, -1))
            yield pa.record_batch([batch.column(0), batch.column(1), fp, key, pa.array([x.tobytes() for x in found[:, :-1]], pa.binary())], names=[id_col, "variant", "fp", "key", "wide"])

    rows = docs.select(id_col, F.xxhash64(text_col).alias("variant"), text_col)
    return rows.mapInArrow(scan, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, variant long, fp long, key long, wide binary")


def _flips() -> np.ndarray:
    """For each syndrome the masks that lead from a 31-bit word to the code words within 2."""
    table = np.zeros((32, 16), np.uint64)
    for syndrome in range(1, 32):
        pairs = [(i, i ^ syndrome) for i in range(32) if i < i ^ syndrome]
        table[syndrome] = [(1 << i >> 1) ^ (1 << j >> 1) for i, j in pairs]
    return table


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index of the fingerprint) for all code words within 2 of either half."""
    flips, found, index = _flips(), [], []
    checks = [np.uint64(sum(1 << i for i in range(31) if (i + 1) >> k & 1)) for k in range(5)]
    for half in (0, 1):
        word = (fps >> np.uint64(32 * half)) & np.uint64(0x7FFFFFFF)
        syndrome = sum((np.bitwise_count(word & check).astype(np.int64) & 1) << k for k, check in enumerate(checks))
        near = word[:, None] ^ flips[syndrome]
        many = np.ones(near.shape, bool)
        many[syndrome == 0, 1:] = False  # a code word is its own only anchor
        at = np.repeat(np.arange(len(fps)), 16).reshape(-1, 16)
        found.append((near | np.uint64(half << 32))[many])
        index.append(at[many])
    return np.concatenate(found), np.concatenate(index)


def _replicate(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy()
        anchor, at = anchors(fps.view(np.uint64))
        yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(fps[at])], names=["anchor", "fp"])


def _replicate_wide(batches):
    """The anchors of the last LANES words, each word with anchors of its own, and the bands, with the key and the words to measure by."""
    for batch in batches:
        key = batch.column(0).to_numpy().view(np.uint64)
        rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(batch.num_rows, -1)
        for lane in range(MEASURE, rows.shape[1]):
            if lane < MEASURE + LANES:
                anchor, at = anchors(np.ascontiguousarray(rows[:, lane]))
                anchor = anchor | np.uint64(lane << 33)
            else:
                anchor, at = rows[:, lane] + np.uint64(lane), np.arange(len(rows))
            columns = [anchor, key[at], *(rows[at, k] for k in range(MEASURE))]
            yield pa.record_batch([pa.array(c.view(np.int64)) for c in columns], names=["anchor", "key", *(f"w{k}" for k in range(MEASURE))])


def _forest(rows: np.ndarray, bits: int, sure: int, name: int) -> list[tuple[int, int, bool]]:
    """Links (of first words) of one large group, fewer than two per fingerprint: a forest by ``sure`` bits, and what joins its trees by ``bits``."""
    left, out = rows, []
    tree = np.full(len(rows), -1)  # the tree that a row not yet visited was joined to
    joined: list[int] = []

    def root(k):
        while joined[k] != k:
            joined[k] = k = joined[joined[k]]
        return k

    while len(left):
        own = len(joined) if tree[0] < 0 else root(int(tree[0]))
        if own == len(joined):
            joined.append(own)
        queue, left, tree = [left[0]], left[1:], tree[1:]
        while queue and len(left):
            x = queue.pop()
            far = np.bitwise_count(left[:, name:] ^ x[name:]).sum(1, dtype=np.int64)
            near = far <= sure
            others = np.unique(tree[near]) if near.any() else ()
            for k in others:  # trees that meet in a sure neighbour are one
                if k >= 0 and root(int(k)) != root(own):
                    joined[root(int(k))] = root(own)
            loose = np.flatnonzero((far <= bits) & ~near)
            fresh = loose[tree[loose] < 0]
            out += [(x[0], y[0], False) for y in left[fresh]]
            tree[fresh] = root(own)
            for k in np.unique(tree[loose]):
                if root(int(k)) != root(own):
                    out.append((x[0], left[loose[tree[loose] == k][0]][0], False))
                    joined[root(int(k))] = root(own)
            if near.any():
                found = left[near]
                out += [(x[0], y[0], True) for y in found]
                queue += list(found)
                left, tree = left[~near], tree[~near]
    return out


def links_within(anchor: np.ndarray, rows: np.ndarray, bits: int, sure: int | None = None, name: int = 0) -> np.ndarray:
    """Links (n x 3: first words, and whether by ``sure`` bits) among rows of equal anchor; rows sorted by anchor.

    Rows are fingerprint words, after ``name`` columns that name them.
    """
    sure = bits if sure is None else sure
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[edge, len(anchor)])
    bare = rows.view(np.uint64)
    found = [np.array(_forest(np.unique(bare[a : a + n], axis=0), bits, sure, name), np.uint64).reshape(-1, 3) for a, n in zip(edge[sizes > _SMALL], sizes[sizes > _SMALL])]
    at = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
    for lag in range(1, _SMALL):
        at = at[at + lag < len(anchor)]
        at = at[anchor[at] == anchor[at + lag]]
        if not len(at):
            break
        far = np.bitwise_count(bare[at, name:] ^ bare[at + lag, name:]).sum(1, dtype=np.int64)
        near = at[far <= bits]
        found.append(np.stack([bare[near, 0], bare[near + lag, 0], (far[far <= bits] <= sure).astype(np.uint64)], 1))
    pairs = np.concatenate(found) if found else np.empty((0, 3), np.uint64)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    pairs[:, :2].sort(axis=1)
    return np.unique(pairs, axis=0).view(np.int64)


class _Forest:
    """Union-find over what one task has seen."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def joins(self, a: int, b: int) -> bool:
        """Join the two; whether they were apart."""
        a, b = self._root(a), self._root(b)
        self.parent[a] = b
        return a != b

    def _root(self, x):
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x


def _thinned(run):
    """Of the links of one task only those that join what its sure links, or all its links, have not joined yet."""

    def thin(batches):
        sure_ones, all_ones = _Forest(), _Forest()
        for batch in run(batches):
            keep = []
            for k, (a, b, sure, over) in enumerate(zip(*(column.to_pylist() for column in batch.columns))):
                if over or sure and sure_ones.joins(a, b) or not sure and all_ones.joins(a, b):
                    keep.append(k)
                if sure:
                    all_ones.joins(a, b)
            yield batch.take(pa.array(keep, pa.int64()))

    return thin


def _spanning(batches):
    """Of the pairs of one partition, those that connect what is not connected yet."""
    seen = _Forest()
    for batch in batches:
        keep = [k for k, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if seen.joins(*pair)]
        yield batch.take(pa.array(keep, pa.int64()))


def spanning(pairs: DataFrame) -> DataFrame:
    """A forest of the pairs (a, b), about FOREST_LINKS of them in one place."""
    together = max(1, -(-pairs.count() // common.FOREST_LINKS))
    return common.checkpoint(pairs.coalesce(together).mapInArrow(_spanning, "a long, b long"))


def _link(bits: int, keys: int, block: int | None, sure: int | None = None, name: int = 0):
    """Compare sorted (keys..., words...) rows per run of equal keys; runs over ``block`` rows are only reported."""

    def batch_of(pairs, over):
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] == 1), pa.array(np.full(len(pairs), over))], names=["a", "b", "sure", "over"])

    def run(batches):
        held, skipped = None, None
        for batch in batches:
            rows = np.stack([column.to_numpy() for column in batch.columns], 1)
            if skipped is not None:
                rows = rows[(rows[:, :keys] != skipped).any(1)]
            if not len(rows):
                continue
            rows = rows if held is None else np.concatenate([held, rows])
            other = np.flatnonzero((rows[:, :keys] != rows[-1, :keys]).any(1))
            cut = int(other[-1]) + 1 if len(other) else 0
            yield from judged(rows[:cut])
            held = rows[cut:]
            if block is not None and len(held) > block:
                skipped = held[0, :keys].copy()
                yield batch_of(np.array([[skipped[0], 0, 0]]), True)
                held = None
        if held is not None:
            yield from judged(held)

    def judged(rows):
        if not len(rows):
            return
        run_id = np.cumsum(np.r_[0, (rows[1:, :keys] != rows[:-1, :keys]).any(1)])
        sizes = np.bincount(run_id)
        if block is not None and (large := sizes > block).any():
            heads = rows[np.flatnonzero(np.r_[True, np.diff(run_id) > 0])[large], 0]
            yield batch_of(np.stack([heads, np.zeros_like(heads), np.zeros_like(heads)], 1), True)
            keep = ~large[run_id]
            rows, run_id = rows[keep], run_id[keep]
        if len(rows):
            pairs = links_within(run_id, np.ascontiguousarray(rows[:, keys:]), bits, sure, name)
            if len(pairs):
                yield batch_of(pairs, False)

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct) that connect all within ``bits``.

    Not every pair within a large group is emitted, but what is linked stays
    connected. An anchor with more than ``block`` fingerprints is dealt out
    again: its fingerprints fall into blocks by hash, and every pair of blocks
    is compared in a place of its own.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the covering is for up to four differing bits")
    return _linked(fps.select("fp").mapInArrow(_replicate, "anchor long, fp long"), bits, block).select("a", "b")


def _linked(replicas: DataFrame, bits: int, block: int, sure: int | None = None, name: int = 0) -> DataFrame:
    """(a, b, sure): links among replicas (anchor, words...) of an anchor."""
    schema, words = "a long, b long, sure boolean, over boolean", replicas.columns[1:]
    judged = common.checkpoint(replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_thinned(_link(bits, 1, block, sure, name)), schema))
    found = judged.where("not over").select("a", "b", "sure")
    over = judged.where("over").select(F.col("a").alias("anchor")).distinct()
    if over.isEmpty():
        return found
    crowded = replicas.join(over, "anchor")
    blocks = crowded.groupBy("anchor").agg(F.ceil(2 * F.count("*") / block).cast("int").alias("n"))
    dealt = crowded.join(blocks, "anchor").withColumn("own", F.pmod(F.xxhash64(*words), F.col("n")).cast("long"))
    dealt = dealt.select("anchor", *words, "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    dealt = dealt.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *words)
    more = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(_thinned(_link(bits, 3, None, sure, name)), schema)
    return found.union(common.checkpoint(more).select("a", "b", "sure"))


def similar_links(printed: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(a, b, sure): forests of keys (printed: key, wide) that may have this similarity or more; sure if they hardly have less.

    Keys are digests of shingle sets, so null ids, repeated rows and very long
    texts make no difference here; null and empty texts share one key.

    At a common anchor the words to measure by may differ in the expected number
    of bits and LAX standard deviations.
    """
    share, n = differing(similarity), 64 * MEASURE
    spread = np.sqrt(n * share * (1 - share))
    names = ", ".join(f"w{k} long" for k in range(MEASURE))
    replicas = printed.groupBy("key").agg(F.min("wide").alias("wide")).mapInArrow(_replicate_wide, f"anchor long, key long, {names}")
    return _linked(replicas, int(n * share + LAX * spread), block, int(n * share - SURE * spread), 1)


def _share(similarity: float):
    """The pairs whose sets of shingles have this Jaccard similarity or more."""

    def run(batches):
        for batch in batches:
            sets = (batch.column(c).to_pylist() for c in ("one", "two"))
            keep = []
            for k, (one, two) in enumerate(zip(*(map(lambda x: np.frombuffer(x, np.uint64), c) for c in sets))):
                both = len(np.intersect1d(one, two, assume_unique=True))
                if both >= similarity * (len(one) + len(two) - both) - 1e-9:
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def shingle_sets(keys: DataFrame, printed: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """(key, grams): the distinct shingles' hashes of these keys, sorted. One text of each key is read."""

    def shingles(batches):
        for batch in common.sliced(batches):
            sets = [np.unique(_shingle_hashes(x, words)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["key", "grams"])

    wanted = printed.select("key", "variant").join(keys, "key", "left_semi").groupBy("key").agg(F.min("variant").alias("variant"))
    texts = docs.select(F.xxhash64(text_col).alias("variant"), F.col(text_col).alias("text")).join(wanted, "variant").groupBy("key").agg(F.min("text").alias("text"))
    return common.materialize(texts.mapInArrow(shingles, "key long, grams binary"))


def exact(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of keys whose sets (key, grams) have this Jaccard similarity or more; a key with over HUB pairs is dealt out."""
    ends = common.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.ceil(F.count("*") / HUB).alias("places")))
    dealt = sets.join(ends, "key").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("places") - 1))).drop("places")
    hubs = ends.where("places > 1")
    for end, other, grams in (("a", "b", "one"), ("b", "a", "two")):
        placed = pairs.join(hubs.withColumnRenamed("key", end), end, "left").withColumn("place", F.pmod(F.xxhash64(other), F.coalesce("places", F.lit(1)))).drop("places")
        pairs = placed.join(dealt.select(F.col("key").alias(end), "place", F.col("grams").alias(grams)), [end, "place"]).drop("place")
    return pairs.select("a", "b", "one", "two").mapInArrow(_share(similarity), "a long, b long")


def _common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of one list shares with each of the other."""
    lists = [*one, *two]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    which = np.cumsum(np.r_[True, values[1:] != values[:-1]]) - 1
    # only what both sides have counts
    left = owner < len(one)
    n = which[-1] + 1
    both = (np.bincount(which[left], minlength=n) > 0) & (np.bincount(which[~left], minlength=n) > 0)
    keep = both[which]
    which, owner, left = (np.cumsum(both) - 1)[which[keep]], owner[keep], left[keep]
    total = np.zeros((len(one), len(two)), np.float32)
    for lo in range(0, int(both.sum()), 4096):
        a, b = np.searchsorted(which, [lo, lo + 4096])
        sides = []
        for own, size, base in ((left[a:b], len(one), 0), (~left[a:b], len(two), len(one))):
            side = np.zeros((size, 4096), np.float32)
            side[owner[a:b][own] - base, which[a:b][own] - lo] = 1
            sides.append(side)
        total += sides[0] @ sides[1].T
    return total


def _cluster_links(similarity: float):
    """Links that join the components of a cluster, from the sets in two of its blocks; rows sorted by (cluster, i, j)."""

    def run(batches):
        for rows in common.contiguous(batches, 3):
            keys = np.stack([rows.column(k).to_numpy() for k in range(3)], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1), True])
            own, key, part = (rows.column(c).to_numpy() for c in ("own", "key", "part"))
            grams = rows.column("grams").to_pylist()
            out = []
            for lo, hi in zip(edges[:-1], edges[1:]):
                one = np.arange(lo, hi)[own[lo:hi] == keys[lo, 1]]
                two = np.arange(lo, hi)[own[lo:hi] == keys[lo, 2]]
                if not len(one) or not len(two):
                    continue
                sets = [[np.frombuffer(grams[k], np.uint64) for k in side] for side in (one, two)]
                sizes = [np.array([len(x) for x in side]) for side in sets]
                both = _common_counts(*sets)
                whole = sizes[0][:, None] + sizes[1][None] - both
                i, j = np.nonzero((both >= similarity * whole - 1e-6) & (part[one][:, None] != part[two][None]))
                # one link for each two components
                _, first = np.unique(np.sort(np.stack([part[one][i], part[two][j]], 1), axis=1), axis=0, return_index=True)
                out += zip(key[one][i[first]].tolist(), key[two][j[first]].tolist())
            yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _only_own(members: DataFrame, similarity: float) -> DataFrame:
    """Members of which too many shingles occur in no other member of the cluster: no other text can be this similar."""

    def grams(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                sets = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                yield pa.record_batch([*(part.column(c).take(pa.array(at)) for c in (0, 1)), pa.array(np.concatenate(sets))], names=["cluster", "key", "gram"])

    each = members.select("cluster", "key", "grams").mapInArrow(grams, "cluster long, key long, gram long")
    alone = each.groupBy("cluster", "gram").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n = 1").groupBy("key").agg(F.count("*").alias("alone"))
    return members.select("key", "n").join(alone, "key").where(F.col("n") - F.col("alone") < F.lit(similarity) * F.col("n") - 1e-6).select("key")


def within_clusters(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join the components (part) of each cluster's members (cluster, key, part, n, grams).

    A cluster of many texts or shingles first loses what is too much its own,
    and is then dealt out as pairs of blocks. The largest component's members
    are not compared with one another.
    """
    sized = lambda rows: rows.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_TEXTS), F.ceil(F.sum("n") / CLUSTER_GRAMS)).alias("blocks"))
    large = common.checkpoint(sized(members).where("blocks > 1"))
    if not large.isEmpty():
        alone = _only_own(members.join(large.select("cluster"), "cluster", "left_semi"), similarity)
        members = common.materialize(members.join(alone, "key", "left_anti"))
    parts = members.groupBy("cluster", "part").agg(F.count("*").alias("texts"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.sum("texts") / CLUSTER_TEXTS), F.ceil(F.sum("grams") / CLUSTER_GRAMS))
    first = parts.groupBy("cluster").agg(F.max(F.struct("texts", "part")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("cluster", F.col("m.part").alias("major"))
    sides = parts.join(first, "cluster").groupBy("cluster", "major", (F.col("part") == F.col("major")).alias("is_major")).agg(blocks.alias("b"))
    dealt = sides.groupBy("cluster", "major").agg(F.sum(F.when(F.col("is_major"), F.col("b"))).alias("nm"), F.sum(F.when(~F.col("is_major"), F.col("b"))).alias("no"))
    salted = common.checkpoint(dealt).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    placed = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")).join(salted, ["cluster", "salt"]).drop("salt")
    major = F.col("part") == F.col("major")
    # the other components' blocks come first; each meets all blocks, the largest component's meet only those
    own = F.when(major, F.col("no") + F.pmod(F.xxhash64(F.lit(1), "key"), F.col("nm"))).otherwise(F.pmod(F.xxhash64(F.lit(1), "key"), F.col("no")))
    meets = F.sequence(F.lit(0).cast("long"), F.when(major, F.col("no")).otherwise(F.col("no") + F.col("nm")) - 1)
    placed = placed.withColumn("own", own).withColumn("other", F.explode(meets))
    placed = placed.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "part", "grams")
    return placed.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_cluster_links(similarity), "a long, b long")


def similar_components(printed: DataFrame, docs: DataFrame, similarity: float, text_col: str, words: int = SIMILAR_WORDS) -> DataFrame:
    """(node, component): keys linked by exact similarity.

    Proposed pairs are reduced to forests: the sure ones are judged pair by pair,
    and all of them make clusters. A cluster that those good pairs do not connect
    is compared in full, in blocks.
    """
    proposed = similar_links(printed, similarity)
    sure, loose = spanning(proposed.where("sure").select("a", "b")), spanning(proposed.select("a", "b"))
    clusters = common.components(loose).withColumnRenamed("component", "cluster")
    clusters = common.checkpoint(clusters.union(clusters.select("cluster", "cluster").distinct()).distinct())
    sets = shingle_sets(clusters.select(F.col("node").alias("key")), printed, docs, text_col, words)
    good = common.checkpoint(exact(sure, sets, similarity))
    parts = common.components(good).withColumnRenamed("component", "part")
    members = clusters.join(parts, "node", "left").select("cluster", F.col("node").alias("key"), F.coalesce("part", "node").alias("part"))
    apart = members.groupBy("cluster").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("cluster")
    members = members.join(apart, "cluster", "left_semi").join(sets, "key").withColumn("n", F.expr("octet_length(grams) div 8"))
    more = within_clusters(common.materialize(members.select("cluster", "key", "part", "n", "grams")), similarity)
    return common.components(good.union(more))


def groups(docs: DataFrame, bits: int = BITS, words: int | None = None, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): near-duplicate groups of documents; component_id is the smallest id reachable.

    Fingerprints link at ``bits`` or fewer differing bits, or texts by the exact
    ``similarity`` of their distinct shingles if one is given. They are compared once each, however many
    documents carry one. Null ids never become a component_id while the group
    has another id. Null and empty texts share the fingerprint 0. Repeated rows
    give repeated rows.
    """
    if similarity is None:
        printed = common.materialize(fingerprints(docs, id_col, text_col, words or WORDS)).withColumn("key", F.col("fp"))
        joined = common.components(links(printed.select("fp").distinct(), bits))
    else:
        printed = common.materialize(wide_fingerprints(docs, id_col, text_col, words or SIMILAR_WORDS))
        joined = similar_components(printed, docs, similarity, text_col, words or SIMILAR_WORDS)
    distinct = printed.groupBy("key").agg(F.min(id_col).alias("least"))
    roots = common.checkpoint(distinct.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("component", "key")))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = common.spread_join(roots, least, "root", F.col("key")).select("key", "component_id")
    return common.spread_join(printed, by_key, "key", F.col(id_col)).select(id_col, "fp", "component_id")


def dedup(docs: DataFrame, bits: int = BITS, words: int | None = None, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each near-duplicate group: the one with the smallest id. All columns stay.

    Rows that share an id are one document: one of them stays, if the id is the
    smallest of the smallest group it is in. Rows without an id stay as they are.
    """
    inner, names = common.neutral(docs)
    own_id = names[id_col]
    member = groups(inner, bits, words, similarity, own_id, names[text_col]).where(F.col(own_id).isNotNull())
    stay = member.groupBy(F.col(own_id).alias("stays")).agg(F.min("component_id").alias("c")).where("c = stays").select("stays")
    kept = inner.join(stay, F.col(own_id) == F.col("stays"), "left_semi").dropDuplicates([own_id])
    return common.named(kept.union(inner.where(F.col(own_id).isNull())), names)
