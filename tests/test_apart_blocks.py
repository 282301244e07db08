"""Blocks whose participants are all in order give the same pairs as blocks in which they have to be picked."""

import numpy as np
import pytest

from viewspan.operators import correlation as C


@pytest.mark.parametrize("kind", ["pearson", "spearman", "kendall"])
@pytest.mark.parametrize("gaps", [False, True])
def test_apart_blocks(monkeypatch, kind, gaps):
    monkeypatch.setattr(C, "_blocked", lambda sorts, block, make, schema: make)
    monkeypatch.setattr(C, "_defined", lambda made: made)
    make = C._pairs(None, 512, kind)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (50, 9)).astype(float)
    if gaps:
        x[rng.random(x.shape) < 0.1] = np.nan
    block = lambda rows: (rows, x[rows], np.zeros((len(rows), 0)))
    pairs = lambda left, right: {(int(i), int(j)): (r, int(n)) for out in make(block(left), block(right)) for i, j, r, n in zip(*out, strict=True)}
    apart, all_rows = pairs(np.arange(20), np.arange(20, 50)), pairs(np.arange(50), np.arange(50))
    assert len(all_rows) == 1225
    assert set(apart) == {(i, j) for i in range(20) for j in range(20, 50)}
    for key, (r, n) in apart.items():
        assert n == all_rows[key][1] and np.isclose(r, all_rows[key][0], rtol=0, atol=1e-12, equal_nan=True)
