"""SimHash groups against all pairs; mixing and line dedup against plain versions; the whole pipeline."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tablespan.llm import common, line_dedup, mixing, near_dup, queries


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_groups(rows):
    prints = [plain_simhash(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4]
    least = closure(range(len(rows)), links)
    members = defaultdict(list)
    for k, c in least.items():
        members[c].append(rows[k][0])
    return [(rows[k][0], f"{prints[k]:016x}", min((i for i in members[least[k]] if i is not None), default=None)) for k in range(len(rows))]


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {tuple(r) for r in queries.op3_simhash_near_dedup(spark, sf_dir).select("doc_id", "fingerprint", "component_id").collect()}
    assert found == set(plain_groups(rows)) and any(i != c for i, _, c in found)


def chains(seed, n):
    """Fingerprints in drifting chains, dense balls and at random."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 1 << 63, n, np.uint64)]
    for start in out[:5]:
        x = start
        for _ in range(30):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    out += [out[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))]
    return sorted({x & (1 << 64) - 1 for x in out})


@pytest.mark.parametrize("block", [near_dup.BLOCK, 10])
def test_links_connect_what_is_near(spark, block):
    prints = chains(1, 200)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = near_dup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block).collect()
    back = {s: p for s, p in zip(signed, prints)}
    pairs = [(back[r["a"]], back[r["b"]]) for r in links]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
    want = closure(prints, [(a, b) for a in prints for b in prints if a < b and bin(a ^ b).count("1") <= 4])
    assert closure(prints, pairs) == want


def test_anchors_cover():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + int(rng.integers(2))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        one, two = (set(near_dup.anchors(np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert one & two and len(one) <= 32


def jaccard(a, b, n=5):
    one, two = ({" ".join(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(out), n, replace=False):
        out[k] = f"new{rng.integers(1 << 30)}"
    return out


@pytest.mark.parametrize("block", [near_dup.BLOCK, 8])
def test_similar_texts_meet(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup.similar_links, "__defaults__", (0.8, block))
    rng = np.random.default_rng(7)
    texts, close, far = [], [], []
    for g in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        texts.append(" ".join(words))
        for n in (1, 3, 40):
            texts.append(" ".join(edited(rng, words, n)))
            (close if jaccard(texts[4 * g], texts[-1]) >= 0.88 else far).append((4 * g, len(texts) - 1))
    texts += [texts[0]] * 40 + ["", None, "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("wide", F.lit(1))
    found = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, similarity=0.8).collect()}
    assert all(jaccard(texts[a], texts[b]) < 0.5 for a, b in far) and len(close) >= 100
    assert sum(found[a] == found[b] for a, b in close) >= 0.95 * len(close)
    assert not any(found[a] == found[b] for a, b in far)
    assert all(c // 4 == i // 4 for i, c in found.items() if i < 240) and all(found[k] == 0 for k in range(240, 280))
    assert found[280] == found[281] == 280 and found[282] == 282
    kept = near_dup.dedup(df, similarity=0.8)
    assert kept.columns == df.columns and kept.count() == len(set(found.values()))


def test_similarity_is_exact_from_the_threshold_on(spark):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(150):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 200)]
        # one replaced stretch of n words takes n + 4 shingles: similarity from 0.71 to 0.88
        n, at = int(rng.integers(10, 30)), int(rng.integers(20, 150))
        texts += [" ".join(words), " ".join(words[:at] + [f"n{g}x{k}" for k in range(n)] + words[at + n :])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, similarity=0.8).collect()}
    near = [k for k in range(0, 300, 2) if jaccard(texts[k], texts[k + 1]) >= 0.8]
    assert 30 < len(near) < 120
    assert [k for k in range(0, 300, 2) if found[k] == found[k + 1]] == near


def test_repeated_shingles_do_not_merge_texts(spark):
    # one shingle rules both fingerprints; the sets share one of about a hundred
    rows = [(k, "z " * 1000 + " ".join(f"{c}{j}" for j in range(50))) for k, c in enumerate("abc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dup.groups(df, similarity=0.8).collect()} == {0, 1, 2}


def test_wide_words_are_fingerprints_of_their_own():
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 10_000, 2000)]
    one, two = (near_dup.wide_simhash(" ".join(w)) for w in (words, edited(rng, words, 60)))
    assert one[0] == near_dup.simhash(" ".join(words), near_dup.SIMILAR_WORDS)
    bits = sum(bin(a ^ b).count("1") for a, b in zip(one, two))
    share = near_dup.differing(jaccard(" ".join(words), " ".join(edited(rng, words, 60))))
    assert abs(bits / (64 * len(one)) - share) < 0.08
    assert len(set(one)) == near_dup.LANES + near_dup.MEASURE == len(one)


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2001 + k) for k in range(300)]
    want = closure({x for p in links for x in p if p[0] != p[1]}, links)
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    assert {n: found.get(n, n) for n in want} == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two three"), (5, "ONE two\tthree"), (5, "ONE two\tthree"), (None, "x y z"), (6, "w " * 50_000), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("fp", "component_id", "stays", "node", "c0")})
    kept = near_dup.dedup(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "6", "None", "None"]
    assert near_dup.dedup(df.limit(0)).count() == 0
    grouped = {(r["doc_id"], r["component_id"]) for r in near_dup.groups(df).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (None, 1)} <= grouped


def plain_line_dedup(rows, min_run=line_dedup.MIN_RUN_WORDS, min_line=line_dedup.MIN_LINE_WORDS):
    """Every window of every length that occurs again, counted as a whole."""
    rows = list(dict.fromkeys((i, t or "") for i, t in rows))
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    lines = [t.split("\n") for _, t in rows]
    words = [[len(x.split()) for x in own] for own in lines]
    gone, size = [set() for _ in rows], 1
    at = [(d, k) for d, own in enumerate(lines) for k in range(len(own))]
    while at:
        same = defaultdict(list)
        for d, k in at:
            if k + size <= len(lines[d]):
                same[tuple(lines[d][k : k + size])].append((d, k))
        at = sorted(x for places in same.values() if len(places) > 1 for x in places)
        for places in same.values():
            for d, k in places[1:]:
                if sum(words[d][k : k + size]) >= (min_line if size == 1 else min_run):
                    gone[d].update(range(k, k + size))
        size += 1
    return sorted((str(i), "\n".join(x for k, x in enumerate(own) if k not in g)) for (i, _), own, g in zip(rows, lines, gone) if len(g) < len(own))


def test_line_dedup_equals_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup(docs).collect()) == plain_line_dedup(rows)


def test_line_dedup_finds_runs_of_any_length(spark):
    rng = np.random.default_rng(3)
    kinds = ["", "a b", "c d e", "f", "g h i j", "k l m n o p q r s t u", "v w x y"]
    rows = [(k, "\n".join(kinds[x] for x in rng.integers(0, len(kinds), 14))) for k in range(40)]
    rows += [(100, "start\na b c d\ne f g h\ni j k l\nend"), (101, "other\na b c d\ne f g h\ni j k l\nstop"), (102, "\n" * 300 + "one two three four five six seven eight nine ten"), (103, "z\n" + "\n" * 300 + "one two three four five six seven eight nine ten")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((str(r["doc_id"]), r["text"]) for r in line_dedup.dedup(df).collect())
    assert found == plain_line_dedup(rows) and ("101", "other\nstop") in found and ("103", "z") in found


def test_line_dedup_takes_short_lines_that_repeat(spark):
    often = "one two three four five six seven eight nine"
    rows = [(k, f"first of {k}\n{often}\nlast of {k}") for k in range(30)] + [(k, f"clean {k}\nyes\n\nno\nits own {k}") for k in range(30, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
    assert found[0] == rows[0][1] and all(found[k] == f"first of {k}\nlast of {k}" for k in range(1, 30))
    assert all(found[k] == rows[k][1] for k in range(30, 40))


def test_line_dedup_edges(spark):
    long = " ".join(f"w{k}" for k in range(25))
    rows = [(1, f"{long}\na b c d e\nf g h i j\nend"), (2, f"x\na b c d e\nf g h i j\ny\n{long}"), (3, "a b c d e\nz"), (4, None), (5, ""), (6, "\n\n\n\n"), (7, long), (7, long), (None, long + "\nq"), (8, "s t\n" * 20_000), (9, "s t\n" * 300 + "u")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, pos string, n_chars long").withColumns({c: F.lit(1) for c in ("doc", "variant", "gone", "n_left", "words")})
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found[1] == rows[0][1] and found[2] == "x\ny" and found[3] == rows[2][1] and found[4] is None and found[5] == "" and found[6] == "\n\n\n\n"
    assert 7 not in found and found[None] == "q" and found[9] == "u" and len(found[8]) < 200_000
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_mixing_counts(spark):
    sizes = {"a": 6000, "b": 1500, "c": 300}
    rows = [(k, f"t{k}", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(10_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clashing = df.withColumns({c: F.lit(1) for c in ("n", "rate", "copy", "salt")})
    assert mixing.mix(clashing).columns == clashing.columns
    for weights in (None, {"a": 1.0, "b": 1.0, "c": 1.0}):
        mixed = mixing.mix(df, weights)
        assert mixed.columns == ["doc_id", "text", "source"]
        got = Counter(r["source"] for r in mixed.collect())
        share = {s: n**0.5 if weights is None else 1.0 for s, n in sizes.items()}
        for s in sizes:
            want = sum(sizes.values()) * share[s] / (sum(share.values()) + (1 if weights is None else 0))
            assert abs(got[s] - want) < 6 * (want * max(1.0, want / sizes[s])) ** 0.5 + 60
    again = sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    assert again == sorted(map(str, mixing.mix(df).collect()))
    order = [r["doc_id"] for r in mixing.mix(df).collect()]
    assert order != sorted(order)
    assert mixing.mix(df, {}).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"c": 1e9, "a": 1e-9, "b": 0.0}, temper=1.0) if sizes["c"] < 10 else mixing.mix(spark.createDataFrame([(k, "x", "big" if k else "tiny") for k in range(2000)], "doc_id long, text string, source string"), {"tiny": 1.0})


def test_poisson_quantiles(spark):
    from math import exp

    def plain(rate, u):
        k, p = 0, exp(-rate)
        total = p
        while total <= u and k < 500:
            k += 1
            p *= rate / k
            total += p
        return k

    cases = [(r, u) for r in (0.01, 0.5, 1.0, 3.7, 40.0) for u in (0.0, 0.1, 0.5, 0.9, 0.999)]
    df = spark.createDataFrame(cases, "rate double, u double").select("rate", "u", mixing.poisson_count(F.col("rate"), F.col("u")).alias("n"))
    assert all(r["n"] == plain(r["rate"], r["u"]) for r in df.collect())


def test_mixing_refuses_no_rate_of_its_own(spark):
    rows = [(k, f"t{k}", "big") for k in range(6000)] + [(6000, "lone", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df, temper=0.0)  # equal weights: a rate of 3000.5 for the one row of the null source
    got = Counter(r["source"] for r in mixed.collect())
    assert abs(got[None] - 3000.5) < 6 * 3000.5**0.5 and abs(got["big"] - 3000.5) < 6 * 3000.5**0.5
    assert mixing.mix(df.repartition(5), temper=0.0).where("source is null").count() == got[None]


def test_parts_of_a_large_rate_are_poisson(spark):
    df = spark.range(2000).select(mixing.copies_of(F.lit(1700.0), F.xxhash64("id")).alias("n"))
    mean, var = df.agg(F.avg("n"), F.variance("n")).first()
    assert abs(mean - 1700) < 6 * (1700 / 2000) ** 0.5 and abs(var / 1700 - 1) < 0.2


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame([(k, "t", f"s{k % 9}" if k % 10 else None) for k in range(500)], "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(str, mixing.mix(df).collect())) == want


def test_stages_keep_the_columns(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        if name != "mixing sources":
            assert 0.7 * count < docs.count() <= count
            count = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    copies = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    first = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert first == copies
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_pipeline_takes_nulls_repeats_and_an_empty_table(spark, tmp_path):
    texts = [None, "", "one text that repeats with some words in it", "one text that repeats with some words in it", "z " * 5000, "a short line\nand a second line of six words here\n"]
    rows = [(k if k != 2 else None, t, "en" if k % 2 else None, "web" if k % 3 else None, len(t or "")) for k, t in enumerate(texts * 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, docs in (("some", rows + rows[:3]), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(r[0], k % 2, 0) for k, r in enumerate(docs)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder)
        assert packed.columns[:2] == ["doc_id", "piece"]
        assert packed.count() == 0 or docs


def test_recall_at_the_threshold(spark):
    """Pairs between 0.80 and 0.85, the hardest: nearly all are found, in a group that they chain together as well."""
    rng = np.random.default_rng(21)
    texts, near = [], []
    for g in range(250):
        words = [f"w{x}" for x in rng.integers(0, 50_000, 240)]
        n = int(rng.integers(12, 23))
        at = int(rng.integers(20, 180))
        texts += [" ".join(words), " ".join(words[:at] + [f"n{g}x{k}" for k in range(n)] + words[at + n :])]
        if 0.8 <= jaccard(texts[-2], texts[-1]) <= 0.85:
            near.append(len(texts) - 2)
    base = [f"b{x}" for x in rng.integers(0, 50_000, 150)]
    crowd = range(len(texts), len(texts) + 150)
    texts += [" ".join(edited(rng, base, int(rng.integers(1, 9)))) for _ in crowd]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, similarity=0.8).collect()}
    assert len(near) > 60 and sum(found[k] == found[k + 1] for k in near) >= 0.99 * len(near)
    want = closure(crowd, [(a, b) for a in crowd for b in crowd if a < b and jaccard(texts[a], texts[b]) >= 0.8])
    assert {k: found[k] for k in crowd} == want


@pytest.mark.parametrize("texts,grams", [(40, 500_000), (512, 3_000)])
def test_clusters_in_blocks_equal_whole_ones(spark, monkeypatch, texts, grams):
    rng = np.random.default_rng(9)
    base = [f"b{x}" for x in rng.integers(0, 50_000, 120)]
    rows = [" ".join(edited(rng, base, int(rng.integers(0, 7)))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "CLUSTER_TEXTS", texts)
    monkeypatch.setattr(near_dup, "CLUSTER_GRAMS", grams)
    found = {r["doc_id"]: r["component_id"] for r in near_dup.groups(df, similarity=0.8).collect()}
    assert found == closure(range(120), [(a, b) for a in range(120) for b in range(a) if jaccard(rows[a], rows[b]) >= 0.8])
