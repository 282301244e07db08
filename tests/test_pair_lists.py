"""Pairs of participants leave Python in lists, and results are rounded without a decimal of each."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewspan.operators import correlation as C
from viewspan.plans.registry import rounded


def sorts(spark, n=70, gaps=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.permutation(np.repeat(np.arange(-2, 3), [1, 2, 3, 2, 1])).astype(float) for _ in range(n)])
    x[3] = 1.0  # constant
    x[rng.random(x.shape) < gaps] = np.nan
    ids = np.sort(rng.choice(5000, n, replace=False))
    rows = [("a", str(p), int(p), j + 1, None if np.isnan(v) else float(v)) for p, r in zip(ids, x, strict=True) for j, v in enumerate(r)]
    return ids, x, spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double")


@pytest.mark.parametrize("kind", ["pearson", "spearman", "kendall", "packed"])
@pytest.mark.parametrize("gaps", [0.0, 0.2])
def test_pairs_of_lists(spark, monkeypatch, kind, gaps):
    ids, x, s = sorts(spark, gaps=gaps)
    of = {**C.CORRELATIONS, "packed": C.packed_correlation}[kind]
    got = {(r.p_i, r.p_j): (r.r, getattr(r, "n_pair", None)) if "n_pair" in r else r.r for r in of(s, 8).collect()}
    if kind == "packed":
        whole = ~np.isnan(x).any(axis=1)
        r = np.where(whole[:, None] & whole[None], C._masked_r(x, x)[0], np.nan)
        assert sorted(got) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
        np.testing.assert_allclose([got[a, b] for i, a in enumerate(ids) for b in ids[i + 1 :]], r[np.triu_indices(len(x), 1)], atol=1e-12)
    else:
        r, n = C.KERNELS[kind][1](x, x)
        want = {(a, b): (None if np.isnan(r[i, j]) else r[i, j], n[i, j]) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j and n[i, j] > 0}
        assert sorted(got) == sorted(want)
        assert all(got[k][1] == v[1] and (got[k][0] is None) == (v[0] is None) and (v[0] is None or abs(got[k][0] - v[0]) < 1e-9) for k, v in want.items())
    # far fewer rows than pairs leave Python
    monkeypatch.setattr(C, "_spread", lambda lists: lists)
    monkeypatch.setattr(C, "_defined", lambda lists: lists)
    assert of(s, 64).count() <= 2 * len(x) * 6 < len(got)


def test_rounded_as_round(spark):
    rng = np.random.default_rng(2)
    ties = [k / 128 for k in range(-400, 400)] + [0.1234565, -0.1234565, 1.0000005, 2.5e-7, -5e-7, 4.9999999e-7]
    x = [*ties, *rng.uniform(-2, 2, 20_000).tolist(), *(10.0 ** rng.uniform(-12, 300, 500)).tolist(), 0.0, -0.0, float("nan"), float("inf"), -float("inf"), None, 999.9999995, 1e9 + 0.1234567]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", (rounded(F.col("x")) + F.lit(0.0)).alias("a"), (F.round("x", 6) + F.lit(0.0)).alias("b"))
    assert df.where("not (a <=> b)").collect() == []


@pytest.mark.parametrize("kind", ["pearson", "spearman", "kendall"])
def test_groups_of_gaps_share_pieces(monkeypatch, kind):
    """A group of rows meets all groups of the other side in one piece; r and n are those of each pair."""
    rng = np.random.default_rng(4)
    x, y = (np.stack([rng.permutation(np.repeat(np.arange(-2.0, 3), [1, 2, 3, 2, 1])) for _ in range(60)]) for _ in range(2))
    for z in (x, y):
        z[::3, 2] = z[1::3, 5] = np.nan
    y[5] = [1.0, *[np.nan] * 8]
    monkeypatch.setattr(C, "FEW", 4)
    pieces = list(C._row_pieces(x, y, kind))
    assert len(pieces) == 3 < len(list(C._pieces(x, y, kind)))
    r, n = np.full((60, 60), 9.0), np.full((60, 60), -1)
    for i, j, part, common in pieces:
        r[np.ix_(i, j)], n[np.ix_(i, j)] = part, common
    want_r, want_n = C.KERNELS[kind][1](x, y)
    assert (n == want_n).all()
    np.testing.assert_allclose(r, want_r, atol=1e-9)
