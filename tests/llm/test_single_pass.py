"""Operators without a join: quality, secrets, fingerprints, and their edge cases."""

import hashlib
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablespan.llm import fingerprints, quality, queries, secret_scan

EDGES = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "y z"), (4, "long " * 60_000), (5, "\U0001f600é\x00 \n\t")]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "s", 1.0, "f", [1]) for i, t in EDGES], "doc_id long, text string, source string, score double, fingerprint string, spans array<int>")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def base(text):
    """The fixed patterns, written out apart from the operator."""
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def test_base_spans_equal_the_patterns(docs):
    cases = [t for _, t in docs] + ["secret=token: abcdef12", "password = 'secret=abcdef1'", "AKIA" * 6, "x AKIAABC", "PASSWORD: \"abcdefg\"", "api-key=abcdef api_key=abcdef APIKEY:abcdef", "tokenſ=abcdefg", "é🙂 token=abcdefg"]
    assert any(base(t) for t in cases)
    for text in cases:
        assert sorted(secret_scan.base_spans(text)) == base(text)


def test_secret_query(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op10_secret_scans(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    for doc, text in docs:
        r, want = rows[doc], base(text)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, k, _ in want) for kind in range(3)]
        joined = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_constants_propagate():
    text = 'K1 = "Zx81-qwerty-77"\ndb_pwd = K1\nname = "hello world"\ncolor: \'#ffeedd\'\npassphrase: "correct8Horse!"\n'
    spans = {text[a:b] for a, _, b in secret_scan.literal_spans(text)}
    assert spans == {"Zx81-qwerty-77", "correct8Horse!"}
    assert secret_scan.literal_spans('password = "changeme"') == [] and secret_scan.literal_spans("password = os.environ") == []
    assert secret_scan.literal_spans("'db_password' => 'pa55word-x'")[0][:2] == (18, 3)
    assert list(secret_scan.pairs("a == b")) is not None


SYNTAX = [
    'os.environ["SECRET"] = "@"', 'set("password", "@")', 'password = """@"""', "<password>@</password>", '<add key="password" value="@"/>', 'tokens = ["other-x1", "@"]',
    "password: |\n  @\nother: 1", "passwords:\n  - first-x1\n  - @\n", 'password = "@" + "rest-of-it-9"', 'password: str = "@"', 'let apiKey: Optional[str] = "@";', "mysql --password @ -u x",
    "export DB_PASSWORD=@", "{'api-key': '@'}", "url=http://h/?token=@", "don't say it: password = '@'", 'connect(host="x", password="@")', 'client_secret := "@"', "dbpassword => '@'", 'A1 = "@"\nB1 = A1\nlogin.token = B1',
]


@pytest.mark.parametrize("text", SYNTAX)
def test_secret_syntax(text):
    text = text.replace("@", "Zx81-qwerty-77")
    assert "Zx81-qwerty-77" in {text[a:b] for a, _, b in secret_scan.literal_spans(text)}


@pytest.mark.parametrize("text", ['tokenizer = "bert-base-uncased"', "author: Johnathan99", "max_tokens = 4096000", 'keyboard = "Qwerty-123456"', 'password = os.getenv("X")', "the key: Something99", 'token == "abc"', 'compass = "North-West-81"'])
def test_names_are_matched_by_words(text):
    assert secret_scan.literal_spans(text) == []


@pytest.mark.parametrize("unit", ["a=", '\\"', '"\\"', '"""', "<a>", "token=[", "a.", "token:", "a'", "token:\n - a\n", '("a",', '+"b"', "token: |\n  a\n", "-", " ", "a= ", "--token "])
def test_secret_scan_is_linear(unit):
    seconds = []
    for n in (50_000, 200_000):
        text = 'token "' + unit * n
        began = time.process_time()
        secret_scan.spans_of(text)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 8 * seconds[0] + 1  # four times the text; a square would be sixteen times


def test_secret_edges(edges):
    rows = secret_scan.find_secrets(edges).collect()
    assert len(rows) == len(EDGES) and all(r["spans"] == [] for r in rows)
    assert secret_scan.find_secrets(edges.limit(0)).count() == 0


def test_fingerprints(spark):
    texts = ["Straße  A b", "STRASSE a b ", "été", "été", "ﬁx", "fix", "", " \n", None, "a", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    assert found[0] == found[1] and found[2] == found[3] and found[4] == found[5] and found[6] == found[7] == found[8]
    assert len(set(found.values())) == 6 and all(re.fullmatch("[0-9a-f]{32}", x) for x in found.values())
    classes = {r["class_id"]: r["copies"] for r in fingerprints.equal_classes(df).collect()}
    assert classes == {0: 2, 2: 2, 4: 2, 6: 3}


def test_fingerprint_query(spark, sf_dir, docs):
    rows = {r["doc_id"]: r for r in queries.op7_document_fingerprints(spark, sf_dir).collect()}
    order = sorted(docs, reverse=True)
    assert len(rows) == len(order)
    for k, (doc, text) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = rows[doc]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_next"] == float(r["fingerprint"] == rows[order[(k + 1) % len(order)][0]]["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
    by_text = {}
    for doc, text in docs:
        by_text.setdefault(text, set()).add(rows[doc]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprint_edges(edges):
    assert fingerprints.fingerprint(edges).count() == len(EDGES)
    rows = [(r["id"], r["next_text"]) for r in fingerprints.with_next(edges).collect()]
    assert len(rows) == len(EDGES) and all(t is not None for _, t in rows)
    assert ([t for i, t in rows if i is None]) == ["\U0001f600é\x00 \n\t"] and [t for i, t in rows if i == 1] == ["y z"]
    assert fingerprints.with_next(edges.limit(0)).count() == 0
    assert [r["next_text"] for r in fingerprints.with_next(edges.where("doc_id = 2")).collect()] == [""]


def test_next_of_ids_that_repeat_very_often(spark, monkeypatch):
    """One id and null hold most rows: their rows are several ranges, and all rows are still one circle by descending id."""
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 100)
    ids = [7] * 120 + [None] * 80 + list(range(-20, 30)) + [2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    slots = fingerprints._slots(df.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h")))[0].groupBy("range", "part").count()
    assert slots.agg(F.max("count")).first()[0] < 40
    rows = {r["text"]: r for r in fingerprints.with_next(df).collect()}
    assert len(rows) == len(ids)
    at, seen = next(t for t, r in rows.items() if r["id"] == 2**63 - 1), []
    for _ in ids:
        seen.append(rows[at]["id"])
        assert rows[at]["next_fingerprint"] == rows[rows[at]["next_text"]]["fingerprint"]
        at = rows[at]["next_text"]
    assert seen == sorted([i for i in ids if i is not None], reverse=True) + [None] * 80


def plain_probability(net, text):
    """The network written out: bytes, chunks of two steps, segments, mean and maximum."""
    steps = max(-(-len(text) // quality.STEP), 1)
    raw = text.ljust((steps + 1) * quality.STEP, b"\0")
    at = [net.embed[list(raw[k * quality.STEP : (k + 1) * quality.STEP])].reshape(-1).astype(float) for k in range(steps + 1)]
    chunks = [[max(0.0, float(at[k] @ net.first[:, f] + at[k + 1] @ net.second[:, f] + net.bias[f])) for f in range(quality.FILTERS)] for k in range(steps)]
    segments = [np.max(chunks[k : k + quality.SEGMENT], axis=0) for k in range(0, steps, quality.SEGMENT)]
    logit = float(np.concatenate([np.mean(segments, 0), np.max(segments, 0)]) @ net.out + net.out_bias[0])
    return 1 / (1 + np.exp(-logit))


def test_quality_equals_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    texts = [b"", b"a", b"abcd", b"abcde", *(bytes(rng.integers(0, 256, n, np.uint8)) for n in (7, 100, 511, 512, 513, 1500))]
    net = quality.fit([b"good words here", b"zzz\x00zz"] * 20, np.array([1.0, 0.0] * 20, np.float32), epochs=2)
    assert quality.probabilities(net, texts) == pytest.approx([plain_probability(net, t) for t in texts], rel=1e-4)


def test_quality_held_out(spark):
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    scored = queries.op1_quality_classifier(spark, big)
    assert scored.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    rows = scored.where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    score, label = np.array([r["score"] for r in rows]), np.array([r["quality"] for r in rows])
    rank = score.argsort().argsort()
    ones, zeros = label.sum(), (1 - label).sum()
    auc = (rank[label == 1].sum() - ones * (ones - 1) / 2) / (ones * zeros)
    assert auc > 0.97 and np.mean((score >= 0.3) == label) > 0.94 and np.mean(score[label == 1] >= 0.3) > 0.99


def test_network_reads_whole_texts():
    net = quality.fit([b"plain words here and there " * 20, b"*** $$$ %%% ###" * 20] * 8, np.array([1, 0] * 8, np.float32), epochs=20)
    good, bad = quality.probabilities(net, [b"some other words", b"$$$ *** $$$ %%% ***"])
    assert good > 0.6 > bad
    tail = b"words and words " * 200_000
    clean, dirty = quality.probabilities(net, [tail, tail + b"$$$ *** %%% ###" * 3])
    assert clean > dirty
    # a very long text gives what the batch path gives
    long = b"abc $$ de " * 120_000
    features = quality._forward(net, [long])[-1]
    want = 1 / (1 + np.exp(-(features @ net.out + net.out_bias)))
    assert quality._long(net, long) == pytest.approx(float(want[0]), abs=1e-4)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net, texts, labels = quality.fresh(), [rng.integers(32, 127, n, np.uint8).tobytes() for n in (0, 3, 90, 1400)], np.array([1, 0, 1, 0], np.float32)
    for part in net.parts():
        part[...] = part.astype(np.float32)

    def loss():
        features = quality._forward(net, texts)[-1].astype(float)
        z = features @ net.out + net.out_bias
        weight = np.where(labels > 0.5, 1.0, quality.ZERO_WEIGHT)
        return float(np.mean(weight * (np.log1p(np.exp(z)) - labels * z)))

    grads = quality._gradients(net, texts, labels)
    for part, grad in zip(net.parts(), grads):
        k = int(np.argmax(np.abs(grad)))
        at = np.unravel_index(k, part.shape)
        old = part[at]
        part[at] = old + 2e-3
        up = loss()
        part[at] = old - 2e-3
        down = loss()
        part[at] = old
        assert (up - down) / 4e-3 == pytest.approx(float(grad[at]), rel=0.15, abs=2e-4)


def test_quality_edges(spark, edges, sf_dir):
    net = quality.fresh()
    rows = quality.score(edges, net).collect()
    assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(edges, net, 0.0)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)
    assert quality.score(edges.limit(0), net).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.train(edges, labels).out.shape == (2 * quality.FILTERS,)
    assert quality.train(edges, labels.limit(0)).out.shape == (2 * quality.FILTERS,)
