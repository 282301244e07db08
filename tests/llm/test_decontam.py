"""op3 against brute force."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import connect, differences
from viewspan.llm import decontam
from viewspan.llm.decontam import benchmark_hits, contamination, matchers, op3_decontamination

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, it in items:
            v = words(it)
            m = min(10, len(v))
            for p in {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else ():
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) == p:
                        hit.update(range(k, k + m))
                        found.add(i)
        found.discard(None)
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").collect()]
    docs = [(r[0], r[1]) for r in read("documents")]
    out = got(op3_decontamination(spark, SF))
    assert out == brute(docs, [(r[0], r[1]) for r in read("benchmark")])
    assert any(r[-1] for r in out)


def test_against_sql(spark):
    assert differences(op3_decontamination(spark, SF), connect(SF), decontam.OP3_SQL) is None


EDGE_DOCS = [(1, None), (2, ""), (3, "one Two"), (3, "one Two"), (4, "x " * 50_000 + "one two three four five six seven eight nine ten eleven"), (None, "a-b É!é"), (6, "two three " * 20)]
EDGE_ITEMS = [(1, "One, two"), (2, "one two three four five six seven eight nine ten ELEVEN"), (2, "one two three four five six seven eight nine ten ELEVEN"), (3, None), (4, "?!"), (None, "é"), (5, "two three two"), (10, "seven")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(d, t, 9) for d, t in EDGE_DOCS], "doc_id long, text string, n_words int")
    items = spark.createDataFrame([(i, t, 9) for i, t in EDGE_ITEMS], "item_id long, text string, n_items int")
    assert got(contamination(docs, items)) == brute(EDGE_DOCS, EDGE_ITEMS)
    assert all(not r["contaminated"] for r in contamination(docs, items.limit(0)).collect())
    assert contamination(docs.limit(0), items).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(d, t, 7) for d, t in EDGE_DOCS], "doc_id long, text string, `a.b` int")
    items = spark.createDataFrame(EDGE_ITEMS, "item_id long, text string")
    one, many = (sorted(map(str, benchmark_hits(docs, items, block_bytes=b).collect())) for b in (10**6, 20))
    assert one == many
    monkeypatch.setattr(decontam, "BLOCKS_AT_ONCE", 2)  # several passes, joined by text
    assert sorted(map(str, benchmark_hits(docs, items, block_bytes=20).collect())) == one


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), max_size=6))
def test_wu_manber(text, patterns):
    ms = matchers([(i, " ".join(p)) for i, p in enumerate(patterns)], window=4)
    text = [c.encode() for c in text]
    found = sorted((at, k.m, i) for k in ms for at, items in k.scan(text) for i in items)
    want = set()
    for i, p in enumerate(patterns):
        m = min(4, len(p))
        grams = {tuple(c.encode() for c in p[k : k + m]) for k in range(len(p) - m + 1)}
        want |= {(at, m, i) for at in range(len(text) - m + 1) if tuple(text[at : at + m]) in grams}
    assert sorted(set(found)) == sorted(want)
