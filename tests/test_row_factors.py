"""Centroid and minres factors from unit rows and their sums, against the kernels on the matrix of all pairs."""

import numpy as np
import pytest

from viewspan.functions import linalg as L
from viewspan.operators import extraction as X
from viewspan.operators import gram as S
from viewspan.operators.study import SORTS

DECK = np.repeat(np.arange(-2, 3), [1, 2, 3, 2, 1]).astype(float)


def sorts_of(n, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 3)) @ rng.normal(size=(3, 9)) + noise * rng.normal(size=(n, 9))
    return DECK[np.argsort(np.argsort(y, axis=1), axis=1)]


def frame(spark, x):
    return spark.createDataFrame([("s", f"p{i}", i + 1, j + 1, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], SORTS)


@pytest.mark.parametrize("candidates", [1, 7, 4096])
def test_centroid_of_rows_is_centroid_of_all_pairs(candidates):
    x = sorts_of(150)
    np.testing.assert_allclose(L.centroid_of_rows(x, 3, candidates=candidates), L.centroid(L.correlation(x), 3), atol=1e-10)


@pytest.mark.parametrize("noise", [1.0, 0.05])
def test_minres_from_sums_is_minres_of_all_pairs(spark, noise, monkeypatch):
    x = sorts_of(280, 1, noise)
    full = L.minres(L.correlation(x), 2, most=3000, tol=1e-11)
    monkeypatch.setattr(L, "correlation", lambda x: pytest.fail("a matrix of participants by participants"))
    got = S.minres(S.whole_rows(frame(spark, x)), 2).toPandas().sort_values(["p_idx", "factor"])
    np.testing.assert_allclose(got.loading.to_numpy().reshape(-1, 2), full, atol=1e-7)


def test_rows_held_to_a_length(monkeypatch):
    monkeypatch.setattr(L, "HEYWOOD", 0.97)
    x = np.vstack([sorts_of(300, 2), sorts_of(30, 3, 0.05)])
    u = L.unit_rows(x)
    z, mu = L.minres_start(u.T @ u, 4)
    for _ in range(S.MINRES_PASSES):
        z, mu = L.minres_step(L.minres_sums(u, z, mu), mu)
    load = L.minres_rows(u, z, mu)[0]
    full = L.minres(L.correlation(x), 4, most=3000, tol=1e-11)
    assert (full**2).sum(axis=1).max() == pytest.approx(L.HEYWOOD**2)
    np.testing.assert_allclose(load * np.sign((load * full).sum(axis=0)), full, atol=2e-3)  # held rows are held in another order here


def test_no_group_holds_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(X, "_pairwise_r", lambda x: pytest.fail("a matrix of participants by participants"))
    s = frame(spark, sorts_of(300))
    for method in ("centroid", "minres"):
        assert X.extract(s, 2, method).count() == 600
