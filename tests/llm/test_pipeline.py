"""Stages of the pipeline on planted rows, each against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from viewspan.llm import neardups

SF = "/root/testdata/sf0.01"


def shingles(t, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, similarity=0.8):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            common = len(sets[i] & sets[j])
            if same or common and common >= similarity * (len(sets[i]) + len(sets[j]) - common):
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low.setdefault(find(i), []).append(d)
    return sorted(min(v) for v in low.values())


def corpus(seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    rows = []
    for k in range(60):
        base = [word() for _ in range(r.randint(40, 250))]
        rows.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    r.shuffle(rows)
    return list(enumerate(rows)) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one two"), (905, "One  two")]


def kept(df, **options):
    return sorted(r["doc_id"] for r in neardups.one_of_each(df, **options).collect())


def test_near_dedup(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int")
    want = brute_groups(rows)
    assert kept(df) == want
    assert kept(df.union(df.where("doc_id < 5"))) == want
    assert neardups.one_of_each(df.limit(0)).count() == 0


def test_same_rows_at_any_partition_count(spark, monkeypatch):
    """Blocks of a cluster, hot leaves and shuffle partitions change nothing."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    base = [word() for _ in range(160)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5, 8, 12])):
            w[r.randrange(160)] = word()
        rows.append(" ".join(w))
    rows = list(enumerate(rows)) + [(1000 + k, " ".join(word() for _ in range(120))) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert 25 < len(want) < 400
    assert kept(df) == want
    monkeypatch.setattr(neardups, "BLOCK_TEXTS", 48)
    monkeypatch.setattr(neardups, "LEAF_PAIRS", 16)
    for n in ("40", "211"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert kept(df.repartition(5)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)


def test_recall(spark):
    """Lone pairs at a similarity of 0.8 to 0.9: at least 0.95 are found, and no pair below 0.8 is linked."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(3, 8)))
    rows, near, far = [], [], []
    while len(near) < 300:
        base = [word() for _ in range(r.randint(60, 300))]
        other = list(base)
        for _ in range(max(1, round(len(base) * r.uniform(0.01, 0.03)))):
            other[r.randrange(len(base))] = word()
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        j = len(a & b) / len(a | b)
        if 0.7 <= j <= 0.9:
            (near if j >= 0.8 else far).append(len(rows) + 1)
            rows += [" ".join(base), " ".join(other)]
    got = set(kept(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert sum(k not in got for k in near) >= 0.95 * len(near)
    assert got >= set(far)


def test_other_ids_names_and_ties(spark):
    rows = [("b", "one two three four five six", 1), ("a", "one two three four five six", 2), ("a", "one two three four five six", 1), ("a", "one two three four five six", 1), (None, "other text", 3), ("z", "other text", 4), (None, None, 5), (None, "", 6)]
    df = spark.createDataFrame(rows, "`the id` string, `a.b` string, `_vs_node` int")
    got = sorted(map(tuple, neardups.one_of_each(df, "the id", "a.b").collect()), key=str)
    assert len(got) == 3 and {g[0] for g in got} == {"a", "z", None}
    again = sorted(map(tuple, neardups.one_of_each(df.repartition(7), "the id", "a.b").collect()), key=str)
    assert got == again


def test_dense_group(spark):
    """More near copies of one text than a text has nearest partners, in two halves that few pairs hold together."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    base = [word() for _ in range(220)]
    rows = []
    for k in range(60):
        w = list(base)
        if k >= 30:
            w[10] = w[120] = "other"
        w[r.randrange(220)] = word()
        rows.append(" ".join(w))
    rows = list(enumerate(rows)) + [(100 + k, " ".join(word() for _ in range(120))) for k in range(20)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == brute_groups(rows)


def test_repeated_lines(spark):
    """A line repeated many times neither makes texts near-duplicates nor hides them."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    junk = " ".join(word() for _ in range(10))
    rows = [" ".join([junk] * 200 + [word() for _ in range(150)]) for _ in range(12)]
    for _ in range(4):
        text = [word() for _ in range(200)]
        rows += [" ".join(text), " ".join(text[:60] + text[50:60] * 300 + text[60:])]
    rows = list(enumerate(rows))
    want = brute_groups(rows)
    assert len(want) == 16
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == want


def test_one_bridge(spark):
    """Two groups of near copies with 900 pairs between them, of which only one is near enough."""
    r = random.Random(57)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    base = [word() for _ in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        if k >= 30:
            w[20], w[90], w[150], w[180] = "other", "words", "are", "here"
        if k not in (0, 30):
            w[r.choice([*range(30, 80), *range(100, 140)])] = word()
        rows.append(" ".join(w))
    sets = [shingles(t) for t in rows]
    near = [(i, j) for i in range(30) for j in range(30, 60) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert near == [(0, 30)]
    rows = list(enumerate(rows))
    assert brute_groups(rows) == [0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert kept(df) == [0]


def test_large_leaf():
    """In a leaf of 200 texts with one key all pairs are compared, not neighbours alone."""
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 2**63, (4, 200), dtype=np.uint64)
    wide[0] = (wide[0] & np.uint64(0xFFFFFFFF00000000)) | np.uint64(77)
    wide[:, 120] = wide[:, 40]
    for lane in range(1, 4):
        wide[lane, 120] ^= np.uint64(0xFFF0000000000000 >> 1)
    columns = [np.full(200, 77), np.full(200, 77), np.arange(200), np.full(200, 50), *wide.view(np.int64)]
    names = ["bucket", "v", "node", "n", "fp0", "fp1", "fp2", "fp3"]
    out = list(neardups._cluster_links([pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)], names[4:], 0.8))
    assert [(a, b) for x in out for a, b in zip(*(c.to_pylist() for c in x.columns))] == [(40, 120)]


def test_similar_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 5000, (5, 60))
    sets = [np.unique(np.append(base[rng.integers(5), : rng.integers(45, 61)], rng.integers(0, 5000, 3)).astype(np.uint64)) for _ in range(70)]
    left = rng.random(70) < 0.4
    ok = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    want = {(i, j) for i in range(70) for j in range(i + 1, 70) if ok(i, j)}
    assert want and {*zip(*(x.tolist() for x in neardups.similar_pairs(sets, None, 0.8)))} == want
    sided = {(i, j) for i, j in want if left[i] != left[j]}
    assert {(min(p), max(p)) for p in zip(*(x.tolist() for x in neardups.similar_pairs(sets, left, 0.8)))} == sided


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("input", docs)]
    for name, f in P.STAGES:
        out.append((name, f(spark, out[-1][1], SF).cache()))
    return dict(out)


def test_stages(spark, stages):
    docs, toxic, near, clean, secret, mixed = stages.values()
    assert toxic.columns == near.columns == clean.columns == secret.columns == docs.columns
    n = [x.count() for x in (docs, toxic, near, clean, secret)]
    assert n[0] > n[1] > n[2] > n[3] == n[4]
    rows = [tuple(r) for r in toxic.select("doc_id", "text").collect()]
    assert brute_groups(rows) == sorted(r[0] for r in near.select("doc_id").collect())
    assert secret.where(F.col("text").rlike(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert all("[SECRET]" in r["text"] or r["text"] == texts[r["doc_id"]] for r in secret.collect())
    assert {r["doc_id"] for r in mixed.select("doc_id").collect()} <= set(texts)


def test_run_equals_stages(spark, stages):
    key = lambda df: Counter((r["doc_id"], r["text"], r["copy_no"]) for r in df.collect())
    assert key(P.run(spark, SF)) == key(stages["source mixing"])
