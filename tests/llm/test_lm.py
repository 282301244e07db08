"""op7 against brute force."""

import math
import re
from collections import Counter

import pytest

from tests.oracle import connect, differences
from viewspan.llm import lm

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, order=2, backoff=0.4, min_count=2):
    counts = Counter()
    for _, t in rows:
        w = words(t)
        for n in range(1, order + 1):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(c for g, c in counts.items() if len(g) == 1)
    out = []
    for d, t in rows:
        w, s = words(t), 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1:
                    s += math.log(factor * counts[g] / total)
                elif counts[g] >= min_count:
                    s += math.log(factor * counts[g] / counts[g[:-1]])
                    break
                else:
                    factor *= backoff
        out.append((d, len(w), s, s / len(w) if w else None))
    return out


def same(df, want):
    key = lambda r: (str(r[0]), r[1], round(r[2], 4))
    got = sorted((tuple(r) for r in df.collect()), key=key)
    want = sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want):
        assert a[2] == pytest.approx(b[2], rel=1e-9, abs=1e-9) and (a[3] == pytest.approx(b[3]) if b[3] is not None else a[3] is None)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(lm.lm_scores(docs), brute([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]))


def test_against_sql(spark):
    assert differences(lm.op7_lm_scores(spark, SF), connect(SF), lm.OP7_SQL) is None


ROWS = [(1, None), (2, ""), (3, "one"), (4, "a b a b a c"), (4, "a b a b a c"), (None, "b a b É é"), (6, "x " * 30_000 + "y x"), (7, "a b c d e f")]


@pytest.mark.parametrize("order,block", [(1, 10**6), (2, 20), (3, 10**6), (3, 5)])
def test_edge_rows(spark, monkeypatch, order, block):
    monkeypatch.setattr(lm, "BLOCK_WORDS", block)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in ROWS], "doc_id long, text string, block int, n int")
    same(lm.lm_scores(df, order=order), brute(ROWS, order))
    assert lm.lm_scores(df.limit(0)).count() == 0
