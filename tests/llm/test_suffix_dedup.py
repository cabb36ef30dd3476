"""Byte-exact comparison with a plain count of all strings of 200 bytes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablespan.llm import common, queries, suffix_dedup


def brute(texts):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) for each text."""
    size, counts, out = suffix_dedup.LENGTH, Counter(), []
    for t in texts:
        counts.update(t[k : k + size] for k in range(len(t) - size + 1))
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - size + 1):
            if counts[t[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def removed(spark, df, **options):
    found, working = suffix_dedup.repeats(df, **options)
    rows = [(r["id"], (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest())) for r in found.collect()]
    common.drop_table(spark, working)
    return rows


def cases():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(6)]
    texts = [prose(rng.randint(0, 150)) + rng.choice(["", *shared]) + prose(rng.randint(0, 90)) + rng.choice(["", *shared]) for _ in range(60)]
    texts += [texts[0], texts[1][:-1], texts[2] * 2, "a" * 199, "a" * 200, "b" * 201, "xyz" * 150, "xyz" * 90, "", None]
    texts += [t[7:] for t in texts[3:9]] + [t[: len(t) // 2] + "#" + t[len(t) // 2 :] for t in texts[9:20]]
    return texts


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"cover": "difference"}, {"cover": "difference", "crowd": 3}])
def test_equals_brute_force(spark, options):
    texts = cases()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = dict(enumerate(brute([(t or "").encode() for t in texts])))
    assert dict(removed(spark, df, **options)) == want


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r["doc_id"] for r in docs), brute([(r["text"] or "").encode() for r in docs])))
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op6_suffix_array_dedup(spark, sf_dir).collect()}
    assert found == want and sum(x[1] for x in want.values())


def test_edges(spark):
    rows = [(None, "q" * 300, 1), (1, None, 2), (1, "", 3), (2, "r" * 150, 4), (2, "r" * 150, 4), (3, "s" * 1_100_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumn("spans", F.lit("x"))
    found = sorted((str(i), r[:3]) for i, r in removed(spark, df))
    assert found == sorted([("None", (300, 300, 1)), ("1", (0, 0, 0)), ("1", (0, 0, 0)), ("2", (150, 0, 0)), ("2", (150, 0, 0)), ("3", (1_100_000, 1_100_000, 1))])
    assert removed(spark, df.limit(0)) == []


def test_long_texts_fall_into_pieces(spark):
    rng = random.Random(5)
    block = bytes(rng.choice(b"abcdefgh") for _ in range(900_000)).decode()
    passage = block[500_000:500_400]
    df = spark.createDataFrame([(1, block + "!" + block[:700_000]), (2, "?" + passage + "?")], "doc_id long, text string")
    found = dict(removed(spark, df))
    assert found[1][:3] == (1_600_001, 1_400_000, 2) and found[2][:3] == (402, 400, 1)


def test_a_run_of_one_byte_is_few_rows():
    import pyarrow as pa

    for text in ("a" * 100_000, "ab" * 50_000, "abcde" * 20_000):
        batch = pa.record_batch([pa.array([1]), pa.array([text])], names=["row", "text"])
        rows = pa.Table.from_batches(suffix_dedup._places("content")([batch]))
        period = len(set(text))
        assert rows.num_rows <= 3 * period + 3 and sum(rows.column("times").to_pylist()) > 10_000 / period


def test_equal_keys_are_compared_by_bytes():
    # Thue-Morse words of equal length agree in many low bits modulo 2**64; here all keys are forced to agree
    import numpy as np

    windows = [b"x" * 200, b"y" * 200, b"x" * 200, b"z" * 200]
    twice = suffix_dedup._repeated(np.zeros(4, np.uint64), np.arange(4) * 200, b"".join(windows))
    assert twice.tolist() == [True, False, True, False]


def test_repeats_of_thue_morse(spark):
    word = "01"
    for _ in range(9):
        word += word.translate(str.maketrans("01", "10"))
    other = word.translate(str.maketrans("01", "10"))
    texts = [word[:300], other[:300], "q" + word[:256], "r" + other[:256], word[:256] + other[:256]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert dict(removed(spark, df)) == dict(enumerate(brute([t.encode() for t in texts])))


def test_unknown_cover(spark):
    with pytest.raises(ValueError):
        suffix_dedup.repeats(spark.createDataFrame([], "doc_id long, text string"), cover="none")
