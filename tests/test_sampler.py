"""The sampler's sweep over grid columns of forced sorts, and where it starts."""

import numpy as np
import pytest

from viewspan.operators import bayes as B

DECK = np.repeat(np.arange(-2, 3), [1, 2, 3, 2, 1]).astype(float)


def sorts(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(DECK) for _ in range(n)])


def test_tables_of_the_normal_distribution():
    u, z = np.random.default_rng(1).random(50_000), np.linspace(-7.9, 7.9, 50_001)
    np.testing.assert_allclose(B._cdf(B._quantile(u)), u, atol=1e-7)
    np.testing.assert_allclose(B._quantile(B._cdf(z[z < 5])), z[z < 5], atol=1e-5)


def test_slices_sample_what_cells_sample():
    x = sorts(200)
    mean = np.tile(np.random.default_rng(2).normal(size=9), (200, 1)) * (x != 9)
    start = np.argsort(np.argsort(x + 1e-6 * np.random.default_rng(3).random(x.shape), axis=1), axis=1) / 3.0 - 1.3
    moments = []
    for latents, shape in ((B._latents, B._columns(x)), (B._forced_latents, B._forced(x))):
        y, rng, total = start.copy(), np.random.default_rng(4), 0.0
        for it in range(600):
            y = latents(y, mean, shape, rng)
            if it >= 100:
                total = total + np.stack([[y[x == c].mean() for c in np.unique(x)], [(y[x == c] ** 2).mean() for c in np.unique(x)]])
        for c in np.unique(x)[:-1]:
            assert (np.where(x <= c, y, -np.inf).max(1) <= np.where(x > c, y, np.inf).min(1) + 1e-8).all()
        moments.append(total / 500)
    np.testing.assert_allclose(*moments, atol=0.05)
    assert B._forced(np.where(x == 2, np.nan, x)) is None and B._forced(np.vstack([x, x[:1] + 1])) is None


def test_chains_start_without_correlations_of_all_pairs(monkeypatch):
    monkeypatch.setattr(B.L, "correlation", lambda x: pytest.fail("a matrix of participants by participants"))
    load, f = B.sample(sorts(60), 2, 12, 6, 2, 1)[-1]
    assert load.shape == (60, 2) and f.shape == (2, 9)
