"""Intervals and agreement of a bootstrap found by blocks of participants equal those of its rows."""

import numpy as np
import pytest

from viewspan.operators import extraction as X
from viewspan.operators import gram as S


def close(got, want):
    a, b = (sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=lambda r: str([x for x in r if not isinstance(x, float)])) for df in (got, want))
    assert len(a) == len(b) and a
    for x, y in zip(a, b):
        for u, v in zip(x, y, strict=True):
            assert (u is None) == (v is None) and (u == v or abs(u - v) < 1e-9), (x, y)


@pytest.mark.parametrize("replicates", [3, 40])
def test_blocks_equal_rows(spark, monkeypatch, replicates):
    rng = np.random.default_rng(11)
    deck = np.repeat([-2.0, -1, 0, 1, 2], [1, 2, 3, 2, 1])
    rows = [(s, f"p{i}", i, j + 1, None if s == "gaps" and i == 4 and j == 2 else float(v)) for s in ("whole", "gaps") for i in range(50) for j, v in enumerate(rng.permutation(deck) + (i % 2) * np.arange(9))]
    sorts = spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double")
    monkeypatch.setattr(S, "BLOCK", 16)
    monkeypatch.setattr(S, "SLICE", 5)
    samples, original = X.bootstrap(sorts, 2, replicates).cache(), X.original_solution(sorts, 2).cache()
    ci, stable = X.bootstrap_ci(samples, original).cache(), X.stability(samples, original).cache()
    ci.count(), stable.count()
    monkeypatch.setattr(S, "bootstrap", lambda *a, **k: pytest.fail("rows of replicates"))
    close(X.bootstrap_ci(X.bootstrap(sorts, 2, replicates, level=0.95), original), ci)
    close(X.bootstrap_stability(sorts, 2, replicates), stable)
