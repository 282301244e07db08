"""Invariants of extraction, rotation and alignment."""

import numpy as np
import pytest

from viewspan.functions import linalg as L

RNG = np.random.default_rng(4)
X = RNG.integers(-4, 5, (10, 27)).astype(float)


def test_pca():
    r = L.correlation(X)
    load, w = L.pca(r, 10)
    assert w.sum() == pytest.approx(10) and np.allclose(load @ load.T, r)
    assert np.allclose(load.T @ load, np.diag(w[:10]))


def test_small_gram_is_the_same():
    x = RNG.normal(size=(40, 12))
    a, w = L.pca(L.correlation(x), 3)
    b, v = L.pca_of_rows(x, 3)
    assert np.allclose(a, b, atol=1e-8) and np.allclose(w, v, atol=1e-8)


def test_centroid():
    base = RNG.normal(size=(1, 30))
    x = np.vstack([base + 0.4 * RNG.normal(size=(6, 30)), -base + 0.4 * RNG.normal(size=(3, 30))])
    f = L.centroid(L.correlation(x), 2)
    assert (f[:6, 0] > 0.6).all() and (f[6:, 0] < -0.6).all()
    assert abs(np.corrcoef(f[:, 0], L.pca(L.correlation(x), 1)[0][:, 0])[0, 1]) > 0.99


def test_minres_recovers():
    true = np.vstack([np.column_stack([RNG.uniform(0.5, 0.9, 8), np.zeros(8)]), np.column_stack([np.zeros(7), RNG.uniform(0.5, 0.9, 7)])])
    r = true @ true.T
    np.fill_diagonal(r, 1)
    f = L.minres(r, 2)
    off = ~np.eye(15, dtype=bool)
    assert np.abs((f @ f.T - r)[off]).max() < 1e-3


@pytest.mark.parametrize("method", ["varimax", "quartimax"])
def test_orthogonal(method):
    load = L.pca(L.correlation(X), 3)[0]
    out = L.rotate(load, method)
    assert np.allclose(out @ out.T, load @ load.T)
    var = lambda x: (x**4).sum() - (method == "varimax") * ((x**2).sum(0) ** 2).sum() / len(x)
    h = np.sqrt((load**2).sum(1))[:, None] if method == "varimax" else 1
    assert var(out / h) >= var(load / h) - 1e-9


@pytest.mark.parametrize("method", ["oblimin", "promax"])
def test_oblique(method):
    load = L.pca(L.correlation(X), 3)[0]
    out, t, phi = {"oblimin": L.oblimin, "promax": L.promax}[method](load)
    assert np.allclose(np.diag(phi), 1, atol=1e-6) and np.allclose(out @ phi @ out.T, load @ load.T, atol=1e-6)


def test_procrustes():
    t = np.array([[0.8, 0.1], [0.7, 0.2], [0.1, 0.8], [0.2, 0.7]])
    assert np.corrcoef(L.procrustes(t[:, ::-1], t).ravel(), t.ravel())[0, 1] > 0.99
    assert np.allclose(L.procrustes(-t[:, :1], t[:, :1]), t[:, :1])
    big = RNG.normal(size=(30, 3))
    cycle = big[:, [1, 2, 0]] * [1, -1, 1]
    assert np.corrcoef(L.align_by_curves(cycle, big).ravel(), big.ravel())[0, 1] > 0.95
