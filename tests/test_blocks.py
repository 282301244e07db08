"""What is found where two blocks of participants meet, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewspan.operators import correlation as C
from viewspan.operators import factors as V
from viewspan.operators.study import SORTS


def made(spark, kind):
    """40 sorts far apart in p_idx: gaps of few kinds or of many, a constant sort, a copy and a sort that others share one statement with."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (40, 9)).astype(float)
    x[7] = x[3]
    x[11] = 2.0
    if kind != "whole":
        x[::3, 2] = x[1::5, 4] = np.nan
    if kind == "many":
        x[rng.random(x.shape) < 0.3] = np.nan
    idx = np.where(np.arange(40) % 4 == 0, np.arange(40) * 90_000, np.arange(40)) + 1
    rows = [("s", f"n{i}", int(idx[i]), j + 1, None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(40) for j in range(9)]
    return spark.createDataFrame(rows, SORTS), idx[np.argsort(idx)], x[np.argsort(idx)]


def all_pairs(idx, x, method="pearson"):
    d = pd.DataFrame(x.T)
    r = d.corr(method, min_periods=1).to_numpy()
    n = (~np.isnan(x)).astype(int) @ (~np.isnan(x)).astype(int).T
    for i in range(len(x)):
        for j in range(len(x)):
            c = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if c.sum() and (np.ptp(x[i][c]) == 0 or np.ptp(x[j][c]) == 0):
                r[i, j] = np.nan
    return r, n


@pytest.mark.parametrize("kind", ["whole", "few", "many"])
def test_what_blocks_find_equals_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(C, "FEW", {"whole": 1, "few": 1, "many": 10**9}[kind])
    s, idx, x = made(spark, kind)
    r, n = all_pairs(idx, x)
    off = ~np.eye(len(idx), dtype=bool)
    for block in (7, 512):
        sums = C.pearson_sums(s, block=block).toPandas().sort_values("p_idx")
        assert list(sums.p_idx) == list(idx)
        np.testing.assert_allclose(sums.r_sum, np.nansum(np.where(off, r, np.nan), axis=1), atol=1e-9)
        assert list(sums.n_r) == list((off & ~np.isnan(r)).sum(1))
        assert list(sums.n_undefined) == list((off & np.isnan(r) & (n > 0)).sum(1))
        near = {(a.p_i, a.p_j): a for a in C.near_pairs(s, 0.6, block).collect()}
        i, j = np.nonzero(np.triu(np.nan_to_num(r) > 0.6, 1))
        assert sorted(near) == sorted(zip(idx[i], idx[j]))
        for a, b in zip(i, j):
            assert near[idx[a], idx[b]]["identical"] == bool(((x[a] == x[b]) | np.isnan(x[a]) | np.isnan(x[b])).all())
        best = {a.p_i: a.p_j for a in C.nearest(s, block).collect()}
        rounded = np.where(off & ~np.isnan(r), np.round(r, 12), -np.inf)
        assert best == {int(idx[k]): int(idx[rounded[k].argmax()]) for k in range(len(idx)) if rounded[k].max() > -np.inf}


def test_weighted_sums_and_factors(spark):
    s, idx, x = made(spark, "few")
    r, _ = all_pairs(idx, x)
    r = np.nan_to_num(np.where(np.eye(len(idx), dtype=bool), 0, r))
    w = np.stack([np.cos(idx), idx % 3], axis=1)
    got = C.pearson_sums(s, F.array(F.cos("p_idx"), (F.col("p_idx") % 3).cast("double")), block=7).toPandas().sort_values(["p_idx", "at"])
    np.testing.assert_allclose(got.r_sum.to_numpy().reshape(-1, 2), r @ w, atol=1e-9)
    flags = s.select("study_id", "p_idx").distinct().select("*", (F.col("p_idx") % 2 + 1).cast("int").alias("factor"), F.lit(True).alias("flagged"))
    pairs = C.pearson(s).withColumn("f", F.col("p_i") % 2 + 1).where("p_i % 2 = p_j % 2").groupBy("f").agg(F.avg("r").alias("r"), F.count("r").alias("n"))
    own = {a.factor: (a.mean_r, a.n_pairs) for a in V.defining_correlations(s, flags).collect()}
    for a in pairs.collect():
        assert own[a.f][0] == pytest.approx(a.r) and own[a.f][1] == a.n


def test_a_far_p_idx_adds_no_blocks(spark):
    """A participant of index 1,000,000 made every other one travel 1,953 times."""
    s, _, _ = made(spark, "whole")
    sent = C._chunks(s, ["study_id"], 512)
    assert sent.select("bi", "bj").distinct().count() == 1
    assert sent.select(F.sum(F.size("who"))).first()[0] == 40


@pytest.mark.parametrize("kind", ["whole", "few"])
def test_sums_of_few_kinds_of_gaps_need_no_blocks(spark, kind, monkeypatch):
    monkeypatch.setattr(C, "FEW", 1)
    s, idx, x = made(spark, kind)
    r, n = all_pairs(idx, x)
    monkeypatch.setattr(C, "_sums_by_blocks", lambda rest, *a, f=C._sums_by_blocks: f(rest, *a) if rest.count() == 0 else pytest.fail("blocks"))
    sums = C.pearson_sums(s).toPandas().sort_values("p_idx")
    off = ~np.eye(len(idx), dtype=bool)
    np.testing.assert_allclose(sums.r_sum, np.nansum(np.where(off, r, np.nan), axis=1), atol=1e-9)
    assert list(sums.n_undefined) == list((off & np.isnan(r) & (n > 0)).sum(1))


@pytest.mark.parametrize("kind", ["whole", "few", "many"])
def test_near_pairs_are_counted_without_rows(spark, kind):
    s, idx, x = made(spark, kind)
    r, _ = all_pairs(idx, x)
    for block in (7, 512):
        assert C.near_counts(s, 0.6, block).first()["n"] == (np.triu(np.nan_to_num(r), 1) > 0.6).sum()
    assert C.near_counts(s, 1.5).count() == 0
