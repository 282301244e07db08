"""Distribution functions and exact tests against enumeration and known values."""

import itertools
import math

import numpy as np
import pytest

from viewspan.functions import stats as S


def test_distributions():
    assert S.norm_sf2(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert S.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert S.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    assert S.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert S.t_sf2(0.0, 5) == pytest.approx(1.0)


@pytest.mark.parametrize("x", [[1, 2, 3, -1, 0], [1, 1, -1, 2, 2, 0, 0], [3, -2, 5, 4]])
def test_signed_rank_by_enumeration(x):
    x = np.array(x, float)
    r = S.mid_ranks(np.abs(x))[x != 0]
    up = x[x != 0] > 0
    t = r[up].sum()
    every = [sum(v for v, s in zip(r, signs) if s) for signs in itertools.product([0, 1], repeat=len(r))]
    p = np.mean([abs(e - r.sum() / 2) >= abs(t - r.sum() / 2) - 1e-9 for e in every])
    assert S.signed_rank(x, 0)["p"] == pytest.approx(p)


@pytest.mark.parametrize("x,y", [([1, 2, 2], [2, 3, 4, 4]), ([5, 1, 1], [1, 1, 2]), ([1, 2, 3], [4, 5, 6, 7])])
def test_mann_whitney_by_enumeration(x, y):
    r = S.mid_ranks(np.array(x + y, float))
    w, mean = r[: len(x)].sum(), len(x) * (len(r) + 1) / 2
    every = [sum(c) for c in itertools.combinations(r, len(x))]
    p = np.mean([abs(e - mean) >= abs(w - mean) - 1e-9 for e in every])
    t = S.mann_whitney(np.array(x, float), np.array(y, float))
    assert t["exact"] and t["p"] == pytest.approx(p)
    assert t["ps"] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in x for b in y]))


def test_constant_and_empty():
    assert math.isnan(S.mann_whitney(np.ones(3), np.ones(4))["p"]) and math.isnan(S.signed_rank(np.zeros(5), 0)["p"])
    assert math.isnan(S.kruskal([np.ones(3), np.ones(2)])["h"])


def test_hodges_lehmann():
    x = np.array([1.0, 2, 3, 4, 7])
    walsh = np.median([(a + b) / 2 for i, a in enumerate(x) for b in x[i:]])
    est, lo, hi = S.hodges_lehmann_one(x)
    assert est == pytest.approx(walsh, abs=0.3) and lo <= est <= hi
    est, lo, hi = S.hodges_lehmann_two(np.full(12, 2.0) + np.arange(12) % 2 * 0.01, np.full(12, -2.0) + np.arange(12) % 3 * 0.01)
    assert est == pytest.approx(4, abs=0.05)
