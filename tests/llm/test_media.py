"""op4: planted copies are found, unrelated images stay apart."""

import numpy as np
import pytest

from viewspan.llm import media as M

SF = "/root/testdata/sf0.001"


def test_pictures():
    x = np.arange(60, dtype=np.uint8).reshape(6, 10)
    assert (M.decode(M.encode(x)) == x).all()
    assert (M.decode(b"P6 # colour\n2 1\n255\n" + bytes([9, 9, 9, 200, 200, 200])).round() == [[9, 200]]).all()
    for bad in (None, b"", b"P5", b"P5\n4 4\n255\nab", b"\x89PNG....", b"P5\n0 0\n255\n"):
        assert M.decode(bad) is None


def test_consensus():
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.uniform(10, 80, (12, 2)), np.zeros(12), rng.uniform(-3, 3, 12)])
    t, s = 0.7, 1.5
    c, z = np.cos(t), np.sin(t)
    q = np.column_stack([s * (c * p[:, 0] + z * p[:, 1]) + 5, s * (c * p[:, 1] - z * p[:, 0]) - 9, p[:, 2] + np.log2(s), p[:, 3] + t])
    assert M.consensus(np.hstack([p, q])) == 12
    assert M.consensus(np.hstack([p, q[rng.permutation(12)]])) < M.INLIERS


def test_planted_copies(spark):
    """The rows ending in 7, 8 and 9 are edits of those ending in 0."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 300")
    cls = {r["media_id"]: r["class_id"] for r in M.image_copies(M.media_table(e)).collect()}
    assert len(cls) == 300
    copies = [(k, k - k % 10) for k in cls if k % 10 >= 7]
    found = sum(cls[a] == cls[b] for a, b in copies)
    assert found >= 0.9 * len(copies), (found, len(copies))
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in e.collect()}
    plain = [k for k in cls if k % 10 < 7]
    wrong = sum(1 for a in plain if cls[a] != a and np.corrcoef(vectors[a], vectors[cls[a]])[0, 1] < 0.8)
    assert wrong <= 0.01 * len(plain), wrong


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    pic = M.rendered(rng.normal(size=64).tolist(), 0)
    rows = [(1, None), (2, b""), (3, None), (4, pic), (4, pic), (None, pic), (7, b"P5\n3 3\n255\n" + bytes(9)), (8, M.rendered(rng.normal(size=64).tolist(), 0)), (9, pic[:-5])]
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None, 5) for k, v in rows], "media_id long, image binary, node int")
    got = sorted((tuple(r) for r in M.image_copies(df).collect()), key=str)
    assert [g[:2] for g in got] == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (7, 7), (8, 8), (9, 9)], key=str)
    assert {g[0]: g[3] for g in got}[4] == 3
    assert M.image_copies(df.limit(0)).count() == 0


def crowded_corners(strangers=40):
    """Two images of six like corners; each corner's key is shared with strangers below and between them."""
    rng = np.random.default_rng(5)
    corner = lambda bits, place: bits.tobytes() + np.array(place, np.float32).tobytes()
    common = rng.integers(0, 256, (6, M.BITS // 8)).astype(np.uint8)
    places = [(20 + 9 * k, 70 - 8 * k + 3 * (k % 2), 0, 0.1 * k) for k in range(6)]
    noise = lambda n: b"".join(corner(rng.integers(0, 256, M.BITS // 8).astype(np.uint8), (*rng.uniform(12, 80, 2), 0, 0)) for _ in range(n))
    rows = [(node, b"".join(corner(c, p) for c, p in zip(common, places, strict=True)) + noise(18)) for node in (1000, 2000)]
    for k in range(6):
        rows += [(base + 10 * k + s % 10 + 100 * (s // 10), noise(12) + corner(common[k], (*rng.uniform(12, 80, 2), 0, 0))) for base in (-5000, 1100) for s in range(strangers // 2)]
    return rows


@pytest.mark.parametrize("block", [4096, 8])
def test_links_between_neighbours(spark, monkeypatch, block):
    """Neighbours in a bucket are strangers and the link is still found, in blocks too."""
    monkeypatch.setattr(M, "BLOCK", block)
    nodes = spark.createDataFrame(crowded_corners(), "node long, corners binary")
    rows = nodes.mapInArrow(M._corner_rows, "bucket long, node long, corner binary")
    near = rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(M._bucket_matches, "a long, b long, places binary")
    assert near.where("a = 1000 and b = 2000").isEmpty()
    assert [tuple(r) for r in M.image_links(nodes).collect()] == [(1000, 2000, 6)]


def test_classes_of_all_pairs(spark):
    """Classes are those that all pairs of images make, each pair compared directly."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 160")
    media = M.media_table(e)
    got = {r["media_id"]: r["class_id"] for r in M.image_copies(media).collect()}
    ids, corners = [], []
    for r in media.collect():
        places, bits = M.descriptors(M.decode(r["image"]))
        ids.append(r["media_id"])
        corners.append(np.hstack([bits, places.astype(np.float32).view(np.uint8)]).tobytes())
    least = {k: k for k in ids}
    for i in range(len(ids)):
        for j in range(i):
            a, b = least[ids[i]], least[ids[j]]
            if a != b and max(M.consensus(M.matching_places(corners[x], corners[y])) for x, y in ((i, j), (j, i))) >= M.INLIERS:
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    assert got == least


def test_few_matches_are_not_looked_at(monkeypatch):
    """A pair with less than the fewest matches costs no consensus; equal matches count once."""
    import pyarrow as pa

    monkeypatch.setattr(M, "consensus", lambda places: pytest.fail(f"{len(places)} matches"))
    place = lambda k: np.arange(k, k + 8, dtype=np.float32).tobytes()
    batch = pa.table({"a": [1] * 4 + [2] * 9, "b": [5] * 13, "places": [place(k) for k in range(4)] + [place(k % 3) for k in range(9)]}).to_batches()
    assert sum(b.num_rows for b in M._agreed(iter(batch))) == 0


def near_corners(n=150, kinds=4):
    """Corners of few kinds with some bits changed, all in one bucket, with node, class and block."""
    rng = np.random.default_rng(8)
    flat = rng.integers(0, 2, (kinds, M.BITS))[rng.integers(0, kinds, n)]
    rows = np.packbits(flat ^ (rng.random((n, M.BITS)) < rng.choice([0.0, 0.05, 0.1], (n, 1))), axis=1)
    return rows, np.sort(rng.integers(0, 60, n)), rng.integers(0, 50, n)


@pytest.mark.parametrize("tiled", [2, 10**9])
def test_tiles_miss_no_match(monkeypatch, tiled):
    """In tiles or one by one, in blocks or not: the pairs of a bucket that brute force finds."""
    import pyarrow as pa

    monkeypatch.setattr(M, "TILED", tiled)
    monkeypatch.setattr(M, "TILE", 7)
    monkeypatch.setattr(M, "TILE_WIDTH", 16)
    rows, node, cls = near_corners()
    n = len(rows)
    bits = [int.from_bytes(r.tobytes(), "big") for r in rows]
    close = lambda i, j: (bits[i] ^ bits[j]).bit_count() <= M.MATCH_BITS
    want = sorted({(min(node[i], node[j]), max(node[i], node[j]), i if node[i] < node[j] else j) for i in range(n) for j in range(n) if i != j and cls[i] != cls[j] and node[i] != node[j] and close(i, j)})
    for blocks in (1, 3):
        block, got = np.arange(n) % blocks, set()
        for low in range(blocks):
            for high in range(low, blocks):
                own = np.flatnonzero((block == low) | (block == high))
                one = lambda v: pa.array(np.full(len(own), v, np.int32))
                t = pa.table({"bucket": pa.array(np.full(len(own), 3)), "low": one(low), "high": one(high), "block": pa.array(block[own].astype(np.int32)), "node": pa.array(node[own]), "class": pa.array(cls[own]), "at": pa.array(own.astype(np.int32)), "bits": pa.array([rows[k].tobytes() for k in own], pa.binary())})
                for b in M._class_matches(iter(t.to_batches(40))):
                    got |= {(a, int(o), at) for a, at, others in zip(*(b.column(k).to_pylist() for k in range(3))) for o in np.frombuffer(others, np.int32) if a != o}
        assert sorted(got) == want
    # the first pass: each row with the first of its run and the one before it
    firsts, last, pairs = [], {}, []
    for i in range(n):
        k = next((k for k in firsts if close(k, i)), None)
        if k is None:
            firsts.append(i)
        else:
            pairs += [(j, i) for j in dict.fromkeys([k, last[k]]) if node[j] != node[i] and close(j, i)]
        last[i if k is None else k] = i
    corner = [rows[i].tobytes() + np.array([i, 0, 0, 0], np.float32).tobytes() for i in range(n)]
    t = pa.table({"bucket": pa.array(np.zeros(n, np.int64)), "node": pa.array(node), "corner": pa.array(corner, pa.binary())})
    found = [np.frombuffer(p, np.float32)[[0, 4]] for b in M._bucket_matches(iter(t.to_batches(40))) for p in b.column(2).to_pylist()]
    assert sorted(tuple(sorted(map(int, f))) for f in found) == sorted(pairs)
