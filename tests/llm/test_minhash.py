"""op13 against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from viewspan.llm import minhash
from viewspan.llm.minhash import KEYS, ROWS, minhash_bytes, minhash_groups, op13_minhash_neardup

SF = "/root/testdata/sf0.01"


def set_of(text, size=2):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(w) < size:
        return {" ".join(w)} if w else set()
    return {" ".join(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    holds = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    common = {}
    for own in holds.values():
        for p in itertools.combinations(own, 2):
            common[p] = common.get(p, 0) + 1
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for (i, j), c in common.items():
        if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c):
            comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)) if sets[i] else d, (low.get(find(i)) if sets[i] else d) == d) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert any(not r[3] for r in want)
    assert got(op13_minhash_neardup(spark, SF)) == want


def variants(rng, text, n):
    words = text.split()
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(1, max(2, len(w) // 18))):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("hot", [8192, 50, 3])
@pytest.mark.parametrize("parts", [4, 40])
def test_groups_of_copies_and_split_keys(spark, hot, parts):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for k in range(60):
        base = " ".join(word() for _ in range(rng.choice((3, 20, 120, 300))))
        texts += [base, *variants(rng, base, 120 if k == 7 else rng.randrange(4)), base.upper(), base.replace(" ", "\n")]
    rows = [(k, t) for k, t in enumerate(rng.sample(texts, len(texts)))]
    assert got(minhash_groups(frame(spark, rows).repartition(parts), hot=hot)) == brute(rows)


def test_pairs_at_the_limit(spark):
    """Lone pairs with similarities from just under to just over 0.8."""
    rng = random.Random(3)
    rows = []
    for k in range(400):
        n = rng.randrange(60, 240)
        a = [f"w{k}x{i}" for i in range(n)]
        cut = max(1, round(n * rng.uniform(0.09, 0.22)))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[cut:] + [f"z{k}"] * (k % 2)))]
    want = brute(rows)
    near = {r[0] for r in want if not r[3]}
    assert 50 < len(near) < 350
    assert got(minhash_groups(frame(spark, rows))) == want


def test_nulls_short_long_repeats_names(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (None, "one two"), (None, "lonely text"), (8, long), (9, long + " end"), (9, long + " end")]
    rows += [(20, "same row again and again")] * 300 + [(20, "other text of one id"), (21, "other text of one id")]
    df = frame(spark, rows)
    assert got(minhash_groups(df)) == brute(rows)
    clash = df.selectExpr("*", "1 as node", "2 as n", "3 as d0", "4 as id", "5 as t", "6 as `a.b`")
    assert got(minhash_groups(clash)) == brute(rows)
    assert got(minhash_groups(df.limit(0))) == []


def test_many_members_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SENT", 0)
    rows = [(k, f"a b c d e f g h {k % 7}") for k in range(50)]
    assert got(minhash_groups(frame(spark, rows))) == brute(rows)


def test_minhashes_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [x[:2000], x[400:2400], x[1000:3000]]
    m = minhash_bytes(np.concatenate(sets), np.array([2000] * 3)).reshape(3, -1)
    assert m.shape[1] == 2 * KEYS * ROWS
    assert abs((m[0] == m[1]).mean() - 1600 / 2400) < 0.13 and abs((m[0] == m[2]).mean() - 1000 / 3000) < 0.13


def test_blocks_of_large_runs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "SMALL", 5)
    rng = random.Random(2)
    base = " ".join(f"b{k}" for k in range(100))
    rows = list(enumerate(variants(rng, base, 90)))
    assert got(minhash_groups(frame(spark, rows))) == brute(rows)
