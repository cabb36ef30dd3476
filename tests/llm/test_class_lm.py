"""Class n-grams: counts and base scores against a plain model, proper probabilities, exchange gains."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablespan.llm import class_lm, queries


def plain_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def test_query_counts_and_base(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    counts = Counter(t for i, x in docs if not held[i] for t in plain_tokens(x))
    total, types = sum(counts.values()), len(counts)
    rows = {r["doc_id"]: r for r in queries.op8_lm_scoring(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    gain = []
    for i, text in docs:
        found, r = plain_tokens(text), rows[i]
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in found)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(found), sum(counts[t] > 0 for t in found), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
        if held[i]:
            gain.append((r["score"] - base) / len(found))
    assert np.mean(gain) > 0.05  # better than the base on held-out texts


def small(spark):
    texts = ["the cat sat", "the dog sat", "a cat ran", "a dog ran", "the cat ran", None, "", "der hund lief", "die katze lief", "rare"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def probability(model, words, before):
    """P(word or unseen | class before) for every training word, from the model's tables."""
    rows = [(r["c"], r["cls"]) for r in model.words.collect()]
    known = [10 ** model.transition[before, k] * (c - model.discount[k]) / model.mass[k] for c, k in rows]
    return sum(known) + 10 ** model.unseen[before]


@pytest.mark.parametrize("options", [{}, {"clustered": 4, "head": 3, "classes": 4}, {"clustered": 6, "head": 1, "classes": 5}])
def test_probabilities_sum_to_one(spark, options):
    model = class_lm.train(small(spark), **options)
    for before in range(len(model.mass)):
        assert probability(model, None, before) == pytest.approx(1.0, abs=1e-6)


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    docs = small(spark).union(spark.createDataFrame([(99, "the unseen zebra sat")], "doc_id long, text string"))
    scores = []
    for head in (1, 3, 1000):
        model = class_lm.train(small(spark), clustered=6, head=head, classes=5)
        scores.append({r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in class_lm.score(docs, model).collect()})
    assert scores[0] == scores[1] == scores[2]
    assert scores[0][99][:2] == (5, 3) and scores[0][5][:2] == (1, 1)


def plain_score(model, train, texts):
    """log10 probabilities from counts and classes alone, in plain loops."""
    classes = {bytes(r["word"]): (r["c"], r["cls"]) for r in model.words.collect()}
    k = len(model.mass)
    counts, moves = Counter(), np.zeros((k, k))
    for text in train:
        before = 0
        for t in class_lm.tokens(text):
            counts[t] += 1
            moves[before, classes[t][1]] += 1
            before = classes[t][1]
    assert {w: c for w, (c, _) in classes.items()} == counts
    of = [[c for c, cls in classes.values() if cls == j] for j in range(k)]
    mass = np.array([sum(x) for x in of], float)
    share = (mass + 0.5) / (mass + 0.5).sum()
    step = [*((moves + class_lm.SMOOTH * share) / (moves.sum(1, keepdims=True) + class_lm.SMOOTH)), share]
    once, twice = ([sum(c == n for c in x) for x in of] for n in (1, 2))
    cut = [0.0 if j == 0 else min(max(o / (o + 2 * t) if o else 0.5, 0.01), 0.99) for j, (o, t) in enumerate(zip(once, twice))]
    free = [0.0 if j == 0 else cut[j] * len(of[j]) / mass[j] if mass[j] else 1.0 for j in range(k)]
    out = []
    for text in texts:
        total, before = 0.0, 0
        for t in class_lm.tokens(text):
            c, cls = classes.get(t, (0, None))
            p = step[before][cls] * (c - cut[cls]) / mass[cls] if c else sum(a * b for a, b in zip(step[before], free))
            total, before = total + math.log10(p), k if cls is None else cls
        out.append(total)
    return out


@pytest.mark.parametrize("options", [{"clustered": 50, "head": 60, "classes": 6}, {"clustered": 1024, "classes": 16}])
def test_scores_equal_a_plain_model_on_any_partitioning(spark, sf_dir, options):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    learn, held = [t for i, t in rows if i % 3], [t for i, t in rows if not i % 3]
    found = []
    for parts in (1, 16):
        model = class_lm.train(docs.where("doc_id % 3 <> 0").repartition(parts), **options)
        kinds = {bytes(r["word"]): r["cls"] for r in model.words.collect()}
        scores = {r["doc_id"]: r["score"] for r in class_lm.score(docs.repartition(parts), model).collect()}
        found.append((kinds, scores))
    assert found[0][0] == found[1][0] and len(set(kinds.values())) > 3
    assert all(found[0][1][i] == pytest.approx(x, rel=1e-12) for i, x in scores.items())
    plain = plain_score(model, learn, held)
    assert [scores[i] for i, _ in rows if not i % 3] == pytest.approx(plain, rel=1e-9)


def test_words_move_to_the_class_of_their_neighbours():
    # two kinds that alternate: a third word that stands where the first kind stands joins it
    moves = np.array([[0, 1, 1], [1, 0, 90], [1, 90, 0]])
    contexts = np.array([[0, 0, 5, 0, 0, 5], [0, 5, 0, 0, 5, 0], [0, 0, 0, 0, 0, 0]])
    assert class_lm.choose(contexts, class_lm.gains(moves)).tolist() == [1, 2, 1]


def likelihood(table, label):
    one = np.eye(label.max() + 1)[label]
    pair = one.T @ table @ one
    return float(class_lm._xlogx(pair).sum() - class_lm._xlogx(pair.sum(1)).sum() - class_lm._xlogx(pair.sum(0)).sum())


def test_exchange_raises_the_likelihood_and_finds_groups():
    rng = np.random.default_rng(1)
    group = rng.integers(0, 3, 60)
    table = rng.poisson(np.where(group[:, None] == group[None], 8.0, 0.1)).astype(float)
    table[0] = table[:, 0] = 1
    label = class_lm.exchange(table, 4)
    start = np.r_[0, 1 + np.arange(59) % 3]
    assert likelihood(table, label) > likelihood(table, start)
    assert all(len(set(label[1:][group[1:] == g])) == 1 for g in range(3)) and label[0] == 0
    # no single move helps any more
    for w in range(1, 60):
        for k in range(1, 4):
            other = label.copy()
            other[w] = k
            assert likelihood(table, other) <= likelihood(table, label) + 1e-6


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "b b\x00 \U0001f600"), (3, "b b\x00 \U0001f600"), (None, "y"), (4, "w " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("score", F.lit("x")).withColumn("c", F.lit(2))
    model = class_lm.train(df)
    found = class_lm.score(df, model).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted([("1", 1), ("2", 1), ("3", 4), ("3", 4), ("None", 2), ("4", 100_001)])
    assert class_lm.score(df.limit(0), model).count() == 0
    nothing = class_lm.train(df.limit(0))
    assert nothing.total == 0
    rows = class_lm.score(df, nothing).collect()
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)


def test_words_of_batches_equal_tokens():
    texts = [" The\tthe\x0bÄRGER\x0cB\r\n", None, "", " \t ", "a\x1cb \x85c\xa0d e", "x\x00y 😀 İK", "B" * 5000 + " b"]
    words, sizes = class_lm._words(pa.array(texts, pa.string()).slice(0))
    found = np.split(np.array(words.to_pylist(), object), np.cumsum(sizes)[:-1])
    assert [[*x, class_lm.END] for x in found] == [class_lm.tokens(t) for t in texts]


def test_occurrences_outside_the_head_are_one_row_per_word(spark):
    texts = ["a b b a c", None, "c x", "b", "z z c", "c d"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    head = class_lm.Head([class_lm.END, b"a"], np.array([6, 2]))
    corpus = class_lm.encode(docs, head, F.col("doc_id") < 5)
    rows = {r["row"]: r["id"] for r in corpus.collect()}
    found = {}
    for r in class_lm.occurrences(corpus).collect():
        assert (bytes(r["word"]), r["part"]) not in found and r["cls"] == -1
        near = np.frombuffer(r["near"], np.int32).reshape(-1, 2).tolist()
        at = [(rows[row], place) for row, place in zip(np.frombuffer(r["rows"], np.int64).tolist(), np.frombuffer(r["places"], np.int32).tolist())]
        found[bytes(r["word"]), r["part"]] = (r["c"], sorted((*p, *q) for p, q in zip(at, near)))
    outside = [part for _, part in found if part]
    assert found == {
        (b"b", 0): (3, [(0, 1, 1, -1), (0, 2, -1, 1), (3, 0, -2, 0)]), (b"c", 0): (3, [(0, 4, 1, 0), (2, 0, -2, -1), (4, 2, -1, 0)]),
        (b"x", 0): (1, [(2, 1, -1, 0)]), (b"z", 0): (2, [(4, 0, -2, -1), (4, 1, -1, -1)]),
        (b"c", outside[0]): (0, [(5, 0, -2, -1)]), (b"d", outside[0]): (0, [(5, 1, -1, 0)]),
    }


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_occurrences_are_not_shuffled_anew_each_round(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(class_lm, "HEAD", 1100)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40))))
    before = shuffled(spark)
    model, scored = class_lm.train_and_score(docs, F.lit(True))
    scored.write.format("noop").mode("overwrite").save()
    outside = model.tail.agg(F.sum("c")).first()[0]
    assert shuffled(spark) - before < 3 * outside  # to their words, and to their texts
