"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters slide over overlapping chunks of eight bytes
that start every four, over the whole document. Filter responses are max-pooled
within segments of 512 bytes; the mean and the maximum of the segments' values
go through a logistic layer to one probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

STEP = 4  #: bytes from one chunk to the next; a chunk is two steps long
SEGMENT = 128  #: chunks that are pooled together
EMBED, FILTERS = 8, 48
PIECE = 512 * SEGMENT * STEP  #: bytes in one go, whole segments
#: The network is fitted on at most this many labelled documents, whole texts each.
TRAIN_ROWS = 4000
EPOCHS, BATCH, RATE = 8, 32, 0.01
#: Rejected documents are rare among the labels; each counts this much in the loss.
ZERO_WEIGHT = 2.0
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    first: np.ndarray  # (STEP * EMBED, FILTERS): the chunk's first half
    second: np.ndarray  # (STEP * EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,): mean, then maximum
    out_bias: np.ndarray  # (1,)

    def parts(self):
        return (self.embed, self.first, self.second, self.bias, self.out, self.out_bias)


def fresh(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    return Network(normal(0.5, 256, EMBED), normal(0.2, STEP * EMBED, FILTERS), normal(0.2, STEP * EMBED, FILTERS), np.zeros(FILTERS, np.float32), normal(0.1, 2 * FILTERS), np.array([1.0], np.float32))


def _layout(texts: list[bytes]):
    """All texts in one buffer: steps of STEP bytes, one step of padding after each text."""
    steps = np.array([max(-(-len(t) // STEP), 1) + 1 for t in texts])
    starts = np.r_[0, np.cumsum(steps)[:-1]]
    raw = b"".join(t.ljust(n * STEP, b"\0") for t, n in zip(texts, steps.tolist()))
    # segments within each text, and one for the chunk that would reach into the next text
    counts = -(-(steps - 1) // SEGMENT)
    doc = np.repeat(np.arange(len(texts)), counts + 1)
    nth = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(counts + 1)[:-1]], counts + 1)
    edge = nth == counts[doc]
    at = np.where(edge, starts[doc] + steps[doc] - 1, starts[doc] + nth * SEGMENT)
    return np.frombuffer(raw, np.uint8), at, doc, ~edge


def _forward(net: Network, texts: list[bytes]):
    raw, at, doc, real = _layout(texts)
    x = net.embed[raw].reshape(-1, STEP * EMBED)
    h = x @ net.first
    h[:-1] += x[1:] @ net.second
    h += net.bias
    np.maximum(h, 0, out=h)
    pooled = np.maximum.reduceat(h, at, axis=0)[real]
    owner = doc[real]
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[edges, len(owner)])
    mean = np.add.reduceat(pooled, edges, axis=0) / count[:, None]
    features = np.concatenate([mean, np.maximum.reduceat(pooled, edges, axis=0)], 1)
    return raw, x, h, at[real], owner, count, pooled, features


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each text; texts are handled about PIECE bytes at a time."""
    out, lo = np.empty(len(texts)), 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= PIECE):
            size += len(texts[hi])
            hi += 1
        if hi == lo + 1 and size > PIECE:
            out[lo] = _long(net, texts[lo])
        else:
            features = _forward(net, texts[lo:hi])[-1]
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30).astype(float)))
        lo = hi
    return out


def _long(net: Network, text: bytes) -> float:
    """One very long text, in parts of whole segments: each part also sees the step that follows it."""
    block, total, top, count = PIECE, 0.0, 0.0, 0
    for lo in range(0, len(text), block):
        raw = text[lo : lo + block + STEP]
        steps = max(-(-min(len(raw), block) // STEP), 1)
        x = net.embed[np.frombuffer(raw.ljust((steps + 1) * STEP, b"\0"), np.uint8)].reshape(-1, STEP * EMBED)
        h = np.maximum(x[:-1] @ net.first + x[1:] @ net.second + net.bias, 0)
        pooled = np.maximum.reduceat(h, np.arange(0, steps, SEGMENT), axis=0)
        total, top, count = total + pooled.sum(0), np.maximum(top, pooled.max(0)), count + len(pooled)
    logit = np.concatenate([total / count, top]) @ net.out + net.out_bias[0]
    return float(1 / (1 + np.exp(-np.clip(float(logit), -30, 30))))


def _gradients(net: Network, texts: list[bytes], label: np.ndarray):
    raw, x, h, at, owner, count, pooled, features = _forward(net, texts)
    p = 1 / (1 + np.exp(-np.clip(features @ net.out + net.out_bias, -30, 30)))
    error = ((p - label) * np.where(label > 0.5, 1.0, ZERO_WEIGHT)).astype(np.float32) / len(texts)
    to_features = error[:, None] * net.out
    to_pool = to_features[owner, :FILTERS] / count[owner, None]
    highest = features[:, FILTERS:]
    to_pool += to_features[owner, FILTERS:] * (pooled == highest[owner])
    # only the first chunk that reaches a segment's maximum passes the gradient on
    segment = np.zeros(len(h), np.int64)
    segment[at[1:]] = 1
    segment = np.cumsum(segment)
    row, column = np.nonzero((h == pooled[segment]) & (h > 0))
    _, first = np.unique(segment[row] * FILTERS + column, return_index=True)
    row, column = row[first], column[first]
    last = row + 1 < len(x)
    row, column = row[last], column[last]
    flow = to_pool[segment[row], column]
    order = np.argsort(column, kind="stable")
    row, column, flow = row[order], column[order], flow[order]
    grads = [np.zeros_like(a) for a in net.parts()]
    cuts = np.searchsorted(column, np.arange(FILTERS + 1))
    for f in range(FILTERS):
        r, g = row[cuts[f] : cuts[f + 1]], flow[cuts[f] : cuts[f + 1]]
        grads[1][:, f] = g @ x[r]
        grads[2][:, f] = g @ x[r + 1]
        grads[3][f] = g.sum()
    steps = raw.reshape(-1, STEP)
    for offset, weight in ((0, net.first), (1, net.second)):
        to_x = (flow[:, None] * weight.T[column]).reshape(-1, EMBED)
        byte = steps[row + offset].reshape(-1)
        for e in range(EMBED):
            grads[0][:, e] += np.bincount(byte, to_x[:, e], 256)
    grads[4][:] = error @ features
    grads[5][0] = error.sum()
    return grads


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Adam on the weighted logistic loss. One label only: the network keeps its start, which says 1 more often."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    if len(texts) == 0:
        return net
    moment = [(np.zeros_like(a), np.zeros_like(a)) for a in net.parts()]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo : lo + BATCH]
            step += 1
            rate = RATE * (1 - step / (1 + epochs * -(-len(order) // BATCH)))
            for a, (m, v), g in zip(net.parts(), moment, _gradients(net, [texts[k] for k in chosen], labels[chosen])):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit on at most ``rows`` labelled documents outside fold 0, chosen by a hash of the id.

    The bound limits what reaches the driver; ids and labels that are null are
    left out, and of repeated labels for an id the smaller counts.
    """
    known = labels.where("quality is not null").where(F.col("doc_id").isNotNull() & (common.bucket5(F.col("doc_id")) != 0))
    chosen = known.groupBy(F.col("doc_id").alias("_labelled")).agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("_labelled")).limit(rows)
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_labelled")).select(F.coalesce(text_col, F.lit("")).alias("t"), "_quality", F.col("_labelled").alias("k"))
    found = sample.orderBy(F.xxhash64("k"), "t").limit(rows).toArrow()
    return fit([x.encode() for x in found["t"].to_pylist()], np.array(found["_quality"].to_pylist(), np.float32))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, score) for every row, in one narrow pass over whole texts.

    Null text counts as empty; null and repeated ids and repeated rows stay as
    they are; a very long text is handled in parts and never cut.
    """
    keep = [c for c in (keep or []) if c not in (id_col, "score")]

    def scan(batches):
        for batch in common.sliced(batches):
            texts = [(x or "").encode() for x in batch.column(0).to_pylist()]
            yield pa.record_batch([*batch.columns[1:], pa.array(probabilities(net, texts))], names=[*batch.schema.names[1:], "score"])

    rows = docs.select(F.col(text_col).alias("_t"), id_col, *keep)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return rows.mapInArrow(scan, f"{schema}, score double")


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with a score of at least the threshold; all columns stay, whatever their names."""
    inner, names = common.neutral(docs)
    scored = score(inner, net, names[id_col], names[text_col], inner.columns)
    return common.named(scored.where(F.col("score") >= threshold), names)
