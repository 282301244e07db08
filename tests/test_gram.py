"""Sums over participants against the same algebra on the whole matrix."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewspan.functions import linalg as L
from viewspan.operators import correlation as C
from viewspan.operators import extraction as X
from viewspan.operators import gram as S

RNG = np.random.default_rng(8)


def study(n, j, seed, groups=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, j))
    x = base[rng.integers(0, groups, n)] * rng.choice([1, 1, -1], (n, 1)) + 0.8 * rng.normal(size=(n, j))
    return np.argsort(np.argsort(x, axis=1), axis=1) // 2 - j // 4 + 0.0


DATA = {"a": study(60, 24, 1), "b": study(9, 30, 2), "c": study(300, 12, 3)}
HOLED = study(20, 15, 4)
HOLED[3, 2] = HOLED[7, 11] = np.nan
CONSTANT = study(8, 14, 5)
CONSTANT[2] = 1.0
ALL = DATA | {"holed": HOLED, "constant": CONSTANT}


@pytest.fixture(scope="module")
def sorts(spark):
    rows = [(s, f"p{i}", i + 1, k + 1, None if np.isnan(v) else float(v)) for s, x in ALL.items() for i, r in enumerate(x) for k, v in enumerate(r)]
    return spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double").repartition(6).cache()


def matrix(df, study, value):
    p = df.where(F.col("study_id") == study).toPandas()
    return p.pivot(index="p_idx", columns="factor", values=value).to_numpy()


def r_of(x):
    r = np.nan_to_num(pd.DataFrame(x.T).corr().to_numpy())
    np.fill_diagonal(r, 1.0)
    return r


@pytest.mark.parametrize("rotation", ["none", "varimax", "quartimax", "oblimin", "promax"])
def test_loadings(sorts, rotation):
    got = X.extract(sorts, 3, "pca", rotation).cache()
    assert got.count() == 3 * sum(len(x) for x in ALL.values())
    for name, x in ALL.items():
        want = L.signed(L.rotate(L.extract(r_of(x), 3, "pca"), rotation))
        assert np.allclose(np.abs(matrix(got, name, "loading")), np.abs(want), atol=2e-5), name
        assert (np.abs(matrix(got, name, "loading")).max(axis=0) - matrix(got, name, "loading").max(axis=0) < 1e-9).all()


@pytest.mark.parametrize("rotation", ["varimax", "oblimin", "promax"])
def test_pattern_structure_and_correlations(sorts, rotation):
    """The rotated solution says the same of the correlations as the unrotated one."""
    plain, pattern, phi = (df.cache() for df in (X.extract(sorts, 3), X.extract(sorts, 3, "pca", rotation), X.factor_correlations(sorts, 3, rotation)))
    both = X.structure(pattern, phi).cache()
    for name in DATA:
        a, p, s = matrix(plain, name, "loading"), matrix(pattern, name, "loading"), matrix(both, name, "structure")
        f = phi.where(F.col("study_id") == name).toPandas().pivot(index="f", columns="g", values="phi").to_numpy()
        assert np.allclose(np.diag(f), 1, atol=1e-6) and np.allclose(f, f.T)
        assert np.allclose(p @ f @ p.T, a @ a.T, atol=1e-6) and np.allclose(s, p @ f, atol=1e-9)
        assert (np.abs(f - np.eye(3)).max() > 1e-3) == (rotation != "varimax")


def test_eigenvalues_and_quality(sorts):
    got = X.eigenvalues(sorts).toPandas()
    quality = X.quality_metrics(sorts).toPandas().set_index("study_id")
    for name, x in ALL.items():
        own = got[got["study_id"] == name].sort_values("k")
        w = L.eigen(r_of(x))[0]
        assert np.allclose(own["eigenvalue"], w, atol=1e-8) and np.allclose(own["cumulative"], np.cumsum(w) / len(w), atol=1e-8)
        r = r_of(x)
        assert quality.loc[name, "avg_r"] == pytest.approx(r[np.tril_indices(len(r), -1)].mean())
        assert np.isnan(quality.loc[name, "kmo"]) == (name in ("a", "c")) or name in ("holed", "constant")
        assert quality.loc[name, "kmo"] == pytest.approx(L.kmo(r), nan_ok=True)


def test_pairwise_correlations_in_blocks(sorts):
    by = {m: f(sorts, 7).toPandas() for m, f in (("pearson", C.pearson), ("spearman", C.spearman))}
    for method, got in by.items():
        for name, x in ALL.items():
            want = pd.DataFrame(x.T).corr(method=method).to_numpy()
            own = got[got["study_id"] == name]
            assert len(own) == len(x) * (len(x) - 1) // 2
            r = own["r"].to_numpy(float)
            assert np.allclose(r, want[own["p_i"] - 1, own["p_j"] - 1], atol=1e-6, equal_nan=True), (method, name)


def test_missing_rows_are_missing_cells(sorts):
    a, b = (C.pearson(s).orderBy("study_id", "p_i", "p_j").toPandas() for s in (sorts, sorts.where("value is not null")))
    pd.testing.assert_frame_equal(a, b)


def test_weights_are_one_multinomial_draw():
    sizes = [50, 30, 20]
    w = np.array([np.concatenate([S.block_weights(sizes, k, 5, b) for k in range(3)]) for b in range(4000)])
    assert (w.sum(axis=1) == 100).all()
    assert np.abs(w.mean(axis=0) - 1).max() < 0.08 and abs(w.var(axis=0).mean() - 0.99) < 0.03
    assert abs(np.cov(w[:, :50].sum(axis=1), w[:, 50:80].sum(axis=1))[0, 1] + 15) < 3  # -n p q


def test_bootstrap_of_weights(sorts, monkeypatch):
    """Each replicate's loadings are those of the drawn rows, turned to the original ones, and z-scores follow."""
    one = sorts.where("study_id in ('a', 'b')")
    got = X.bootstrap(one, 2, 6, seed=9).toPandas()
    for name in ("a", "b"):
        x = DATA[name]
        target = L.signed(L.rotate(L.pca(L.correlation(x), 2)[0], "varimax"))
        for b in range(6):
            w = S.block_weights([len(x)], 0, 9, b)
            drawn = np.repeat(np.arange(len(x)), w)
            load = L.procrustes(L.rotate(L.pca(L.correlation(x[drawn]), 2)[0], "varimax"), target[drawn])
            own = got[(got["study_id"] == name) & (got["b"] == b)]
            mine = own[own["kind"] == "loading"].pivot(index="item", columns="factor", values="value")
            there = np.flatnonzero(w)
            assert list(mine.index) == list(there + 1)
            want = np.stack([load[drawn == i][0] for i in there])
            assert np.abs(mine.to_numpy() - want).max() < 2e-4
            z = own[own["kind"] == "zscore"].pivot(index="item", columns="factor", values="value").to_numpy()
            assert np.allclose(z, X._zscores(x[drawn], load, S.flagged_loads(load, x.shape[1])).T, atol=5e-3, equal_nan=True)


@pytest.mark.parametrize("rotation", ["varimax", "none"])
def test_bootstrap_depends_on_no_partition(spark, sorts, monkeypatch, rotation):
    monkeypatch.setattr(S, "BLOCK", 40)
    one = sorts.where("study_id = 'c'")
    frames = []
    for parts in (4, 211):
        rows = X.bootstrap(one.repartition(parts), 3, 20, rotation=rotation).toPandas()
        frames.append(rows.sort_values(["b", "kind", "item", "factor"]).reset_index(drop=True))
    pd.testing.assert_frame_equal(*frames, atol=1e-9)


def test_bootstrap_reports(sorts):
    samples = X.bootstrap(sorts, 2, 30).cache()
    original = X.original_solution(sorts, 2).cache()
    assert {r["study_id"]: r["status"] for r in X.bootstrap_success(samples, 30).collect()} == dict.fromkeys(ALL, "ok")
    ci = X.bootstrap_ci(samples, original)
    assert ci.where("kind = 'loading'").count() == 2 * sum(len(x) for x in ALL.values())
    flags = original.where("kind = 'loading'").select("study_id", F.col("item").alias("p_idx"), "factor", (F.abs("value") > 0.5).alias("flagged"))
    agree = {r["study_id"]: r["mean"] for r in X.flag_agreement(samples, flags).collect()}
    assert set(agree) == set(ALL) and all(0.5 < a <= 1 for a in agree.values())
    assert X.stability_verdict(ci).where("phi > 0.9").count() >= 6
