"""op2 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from viewspan.llm.suffixes import op2_suffix_dedup, pieces, repeated_windows, suffix_array, suffix_dedup

SF = "/root/testdata/sf0.001"
from viewspan.llm.suffixes import with_repeats


def brute(rows, width):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + width] for _, b in texts for i in range(len(b) - width + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=50), max_size=6), st.integers(2, 9))
def test_repeated_windows(texts, width):
    texts = [t.encode() for t in texts]
    seen = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    want = [{i for i in range(len(b) - width + 1) if seen[b[i : i + width]] > 1} for b in texts]
    assert [{i for a, b in r for i in range(a, b)} for r in repeated_windows(texts, width)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=5))
def test_pieces_cover_every_window_once(texts):
    width, kgram = 12, 5
    ends = np.cumsum([len(t) for t in texts])
    bucket, start, n, _ = pieces(b"".join(texts), ends, width, kgram)
    covered = sorted(i for s, k in zip(start.tolist(), n.tolist()) for i in range(s, s + k))
    begins = [e - len(t) for e, t in zip(ends.tolist(), texts)]
    assert covered == [b + i for b, t in zip(begins, texts) for i in range(len(t) - width + 1)]
    by_window = {}
    data = b"".join(texts)
    for v, s, k in zip(bucket.tolist(), start.tolist(), n.tolist()):
        for i in range(s, s + k):
            assert by_window.setdefault(data[i : i + width], v) == v


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common, rows = prose(12), [(1, None), (2, ""), (3, "short"), (None, prose(40))]
    base = prose(60)
    rows += [(10 + k, base) for k in range(4)] + [(10, base)]
    rows += [(20 + k, prose(r.randint(0, 20)) + " " + common + " " + prose(r.randint(0, 20))) for k in range(25)]
    rows += [(50, "ab" * 100), (51, "xyz " * 60), (52, "q" * 90), (53, prose(300) + "no" * 30), (54, base[:100] + prose(9) + base[60:])]
    return rows


@pytest.mark.parametrize("hot_bytes", [1 << 20, 200])
def test_small_corpus(spark, hot_bytes):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in corpus()], "doc_id long, text string, k1 int, bucket int")
    assert got(suffix_dedup(df, width=40, kgram=8, hot_bytes=hot_bytes)) == brute(corpus(), 40)


def test_empty(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = got(op2_suffix_dedup(spark, SF))
    assert out == brute(rows, 400)
    assert any(r[2] for r in out)


def test_many_equal_rows(spark):
    """Rows of one id and text, beside a text that holds part of theirs and rows of another id."""
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(1, text)] * 60 + [(2, text[200:700] + "tail"), (3, "short")] + [(3, "short")] * 3 + [(None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as _vs_k1", "8 as _vs_r")
    out = with_repeats(df).collect()
    assert len(out) == len(rows) and all((r["_vs_k1"], r["_vs_r"]) == (7, 8) for r in out)
    for r in out:
        spans = [(x["start"], x["end"]) for x in r["repeats"]]
        assert spans == {1: [(0, 1500)], 2: [(0, 500)]}.get(r["doc_id"], [])
