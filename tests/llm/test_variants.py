"""op11 against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from viewspan.llm.variants import PRIME, anagram_key, near_words, op11_spelling_variants, spelling_groups, spelling_variants

SF = "/root/testdata/sf0.001"


def words_of(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    of = {w: [] for w in n}
    for k, own in by.items():
        for a, b in itertools.chain(itertools.combinations(own, 2), itertools.product(own, by.get(k + 1, []))):
            if near(a, b):
                of[a].append(b)
                of[b].append(a)
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, root, n[w], len(of[w]), form[w], n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "root", "n", "n_near", "form", "form_n")) for r in df.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(words_of(rows))
    assert want and any(r[4] for r in want)
    assert got(op11_spelling_variants(spark, SF)) == want


def some_words(seed, letters="aböÀ"):
    """A chain of forms, anagrams and one-letter neighbours of a small alphabet."""
    rng = random.Random(seed)
    n = {"".join(rng.choice(letters) for _ in range(rng.choice((7, 7, 8)))): rng.choice((2, 2, 25, 300, 4000)) for _ in range(700)}
    return n | {"chainedx": 2, "chained": 20, "chaine": 0, "chainedxx": 200, "aaaaaaa": 5, "aaaaaaaa": 50, "aaaaaaaaa": 500}


@pytest.mark.parametrize("hot", [1, 8, 10**9])
def test_split_keys_give_the_same(spark, hot):
    n = {w: c for w, c in some_words(3).items() if c and len(w) >= 7}
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    pairs = [(r["a"], r["b"]) for r in near_words(df, hot).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert got(spelling_variants(df, hot)) == brute(n)


def test_changes_of_a_key_are_unambiguous():
    """Differences of two letters' values are all different, and none is a letter's value."""
    values = [c**5 for c in (*range(97, 123), *range(65, 91), *range(0xC0, 0x100))]
    differences = {(a - b) % PRIME for a in values for b in values if a != b}
    assert len(differences) == len(values) * (len(values) - 1)
    assert not differences & {s * v % PRIME for v in values for s in (1, -1)}


def test_keys(spark):
    rows = [("listen",), ("silent",), ("ÿ" * 3,)]
    keys = [r[0] for r in spark.createDataFrame(rows, "w string").select(anagram_key(F.col("w"))).collect()]
    assert keys[0] == keys[1] == sum(ord(c) ** 5 for c in "listen") and keys[2] == 3 * 255**5


def test_nulls_long_texts_repeats_names(spark):
    long = " ".join(f"{w} " * 40 for w in ("Straßenbahn", "Strasenbahn", "strassenbahn", "Àbcdefgh", "àbcdefgh"))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, "hapaxlegomenon " * 3), (4, "x" * 120_000 + " " + "x" * 120_000), (5, "no×sign÷split×sign÷split"), (6, "\U0001d504lphabet \U0001d504lphabet")]
    rows += [(k, "something somethings sumething") for k in range(10, 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling_groups(df)) == brute(words_of(rows))
    clash = df.selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as run", "5 as `key.x`")
    assert got(spelling_groups(clash)) == brute(words_of(rows))
    assert got(spelling_groups(df.limit(0))) == []
