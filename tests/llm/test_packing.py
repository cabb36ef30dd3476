"""Packing: ids, cuts, offsets, and the number of sequences against exact optima."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablespan.llm import packing, queries

PATH = queries.vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(spark, sf_dir, tokenizer):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(120).collect()]
    texts += ["", " ", "  a\n\n b\t", "<|endoftext|>", "a <|endoftext|> b", "don't I'LL", "é ü ß ñ", "日本語 текст עברית", "\U0001f600\U0001f600", "x" * 3000, "1234567 89", "  x", "á", "ǅ ǈ ʼn"]
    for text in texts:
        assert packing.token_ids(text, PATH) == tokenizer.encode(text, add_special_tokens=False).ids


def checked(rows, ids_of, capacity=1024):
    """The rows of a packing: whole documents, cuts, digests and gapless sequences."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, found in by_doc.items():
        ids, at = ids_of[doc], 0
        for k, r in enumerate(sorted(found, key=lambda r: r["piece"])):
            size = len(ids) if len(ids) <= capacity else (len(ids) % capacity or capacity) if k == 0 else capacity
            assert (r["piece"], r["start"], r["length"]) == (k, at, size)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + size], "<u4").tobytes())
            at += size
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_query(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids_of = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs}
    used = checked(queries.op5_best_fit_packing(spark, sf_dir).collect(), ids_of)
    total = sum(map(len, ids_of.values()))
    large = sum((len(x) % 1024 > 512) + len(x) // 1024 for x in ids_of.values())
    assert used <= 1.02 * max(-(-total // 1024), large)


def test_edges(spark, tokenizer):
    rows = [(1, None), (2, ""), (3, "x " * 5000), (None, "a"), (4, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("task", F.lit(1))
    ids_of = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    packed = packing.pack(df, PATH).collect()
    checked(packed, ids_of)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in packed)
    assert packing.pack(df.limit(0), PATH).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "same"), (1, "same")], "doc_id long, text string"), PATH).collect()
    assert len(twice) == 2 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 2


def best(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    return max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)


def test_fullest_equals_every_combination():
    rng = np.random.default_rng(2)
    for _ in range(120):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, rng.integers(1, 6))}
        room = int(rng.integers(0, 70))
        chosen = packing.fullest(counts, room)
        assert all(0 < n <= counts[x] for x, n in chosen.items())
        assert sum(x * n for x, n in chosen.items()) == best(counts, room)


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 101, rng.integers(1, 60))}
        used = dict.fromkeys(counts, 0)
        for chosen, times in packing.plan(counts, 100):
            assert times > 0 and sum(x * n for x, n in chosen.items()) <= 100
            for x, n in chosen.items():
                used[x] += n * times
        assert used == counts
    # repeating a combination while it fits is what one bin at a time does
    counts = {100: 3, 60: 5, 40: 4, 30: 7, 10: 11}
    single, left = 0, dict(counts)
    while any(left.values()):
        seed = max(x for x, n in left.items() if n)
        left[seed] -= 1
        for x, n in packing.fullest({x: n for x, n in left.items() if n}, 100 - seed).items():
            left[x] -= n
        single += 1
    assert sum(t for _, t in packing.plan(counts, 100)) == single
    assert packing.plan({}, 100) == []
