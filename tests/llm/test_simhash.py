"""op6 against brute force."""

import itertools
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from viewspan.llm.simhash import block_bits, majority_bits, op6_simhash, simhash_components, trie_pairs

SF = "/root/testdata/sf0.001"


def fingerprint(text, size=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, budget=2):
    fps = [fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= budget:
            comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op6_simhash(spark, SF)) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One TWO"), (5, "One TWO"), (None, "a b c d"), (7, "É é x"), (8, "a b c d e f g " * 9000), (9, "a b c")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, fp0 int, component_id int")
    assert got(simhash_components(df)) == brute(rows)
    assert simhash_components(df.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), unique=True, max_size=90), st.integers(0, 3))
def test_trie_join(keys, budget):
    k = np.array(sorted(keys), np.uint64)
    pairs = [(int(a), int(b)) for i, j, _ in trie_pairs(k, np.array([0]), np.array([len(k)]), 12, budget) for a, b in zip(i, j)]
    want = [(a, b) for a, b in itertools.combinations(range(len(k)), 2) if (int(k[a]) ^ int(k[b])).bit_count() <= budget]
    assert sorted(pairs) == want


def test_blocks_cover():
    assert block_bits(64, 2) == [(0, 21), (21, 22), (43, 21)]
    assert sum(w for _, w in block_bits(32, 3)) == 32


def test_majority_of_long_and_empty():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 250_003, dtype=np.uint64)
    lengths = np.array([0, 3, 250_000, 0])
    out = majority_bits(h, lengths)
    for row, part in ((1, h[:3]), (2, h[3:])):
        assert int(out[row]) == sum(1 << b for b in range(64) if 2 * int(((part >> np.uint64(b)) & np.uint64(1)).sum()) > len(part))
    assert out[0] == out[3] == 0
