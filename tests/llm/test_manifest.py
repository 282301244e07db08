"""op12 against a plain manifest."""

import hashlib
import random
import zlib

import pytest

from viewspan.llm import manifest
from viewspan.llm.manifest import leaf_ranks, merkle_manifest, op12_merkle_manifest, text_ranks

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*(one(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def level_up(nodes):
    return [sha(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]


def proof(levels, at):
    """(left, right) siblings of each level, and what is on top."""
    out = []
    for nodes in levels:
        if len(nodes) == 1:
            break
        run = at // 16 * 16
        out.append((nodes[run:at], nodes[at + 1 : run + 16]))
        at //= 16
    return out


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(level_up(levels[-1]))
    return levels


def brute(rows):
    by = {}
    for row in rows:
        by.setdefault(row["source"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, row["text"]), row))
    trees = {}
    for source, own in by.items():
        own.sort(key=lambda x: x[:3])
        trees[source] = tree([x[2] for x in own])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in order])
    root = top[-1][0] if rows else None
    out = []
    for k, source in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(by[source]):
            path = proof(trees[source], i) + proof(top, k)
            d = row["doc_id"]
            bad = d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and row["text"] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"]) if bad else row["text"]
            cur = leaf_of(row, text)
            for left, right in path:
                cur = sha(*left, cur, *right)
            out.append((d, leaf, trees[source][-1][0], root, sha(*(x for left, right in path for x in (*left, *right))), cur, cur == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def tampered():
    from pyspark.sql import functions as F

    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def got(df):
    assert tuple(df.columns[: len(COLUMNS)]) == COLUMNS
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def plain(df):
    return [r.asDict() for r in df.collect()]


def test_whole_table(spark):
    rows = plain(spark.read.parquet(f"{SF}/documents.parquet"))
    assert got(op12_merkle_manifest(spark, SF)) == brute(rows)


@pytest.mark.parametrize("n_sources,n", [(1, 1), (1, 16), (1, 17), (1, 300), (3, 40), (17, 60), (40, 41)])
def test_shapes(spark, n_sources, n):
    rng = random.Random(n)
    ids = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
    rows = [(d, f"Text {d} É", "en", f"s{k % n_sources}" if k % n_sources else None, 5) for k, d in enumerate(ids)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(merkle_manifest(df, tampered())) == brute(plain(df))


def test_a_source_of_many_levels(spark):
    rows = [(k * 7 % 4999, f"T{k}", None, "big" if k % 3 else f"s{k}", None) for k in range(4999)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(merkle_manifest(df, tampered())) == brute(plain(df))


def test_nulls_repeats_empty_names(spark):
    rows = [(1, "A", "en", "x", 1)] * 40 + [(1, f"v{k}", None, "x", None) for k in range(30)] + [(None, None, None, None, None)] * 3 + [(2, "", "", "", 0), (5, None, "en", "x", 2), (5, "Z" * 100_000, "en", "é", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(plain(df))
    assert got(merkle_manifest(df, tampered())) == want
    clash = df.selectExpr("*", "1 as leaf", "2 as `r`", "3 as n", "'q' as digest", "5 as `a.b`")
    assert got(merkle_manifest(clash, tampered())) == want
    assert got(merkle_manifest(df.limit(0), tampered())) == []


def test_ranks_in_small_windows(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DIGIT", 4)
    rng = random.Random(5)
    rows = [(f"g{k % 3}" if k % 3 else None, rng.choice([None, *range(-300, 300)]), f"{rng.randrange(20):015x}", k) for k in range(3000)]
    out = leaf_ranks(spark.createDataFrame(rows, "source string, id long, leaf string, seq long")).collect()
    assert len(out) == len(rows)
    for g in (None, "g1", "g2"):
        own = sorted((r for r in out if r["source"] == g), key=lambda r: r["r"])
        assert [r["r"] for r in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda r: (r["id"] is not None, r["id"] or 0, r["leaf"], r["seq"]))
    names = [None, "", "é", *{"".join(rng.choice("abé/") for _ in range(rng.randrange(12))) for _ in range(500)} - {"", "é"}]
    ranked = text_ranks(spark.createDataFrame([(x,) for x in names], "t string"), "t").collect()
    assert [r["t"] for r in sorted(ranked, key=lambda r: r["r"])] == sorted(names, key=lambda x: (x is not None, (x or "").encode()))
    assert sorted(r["r"] for r in ranked) == list(range(len(names)))


def test_changed_data_is_found(spark):
    df = spark.createDataFrame([(k, "Same Text", "en", "s", 9) for k in range(50)], SCHEMA)
    out = merkle_manifest(df, tampered()).collect()
    assert all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0) for r in out)
    assert all(r["verified"] for r in merkle_manifest(df).collect())
