"""Nulls of parallel analysis by blocks of participants, against nulls of the whole matrix."""

import numpy as np
import pytest

from viewspan.functions import linalg as L
from viewspan.operators import extraction as X
from viewspan.operators import gram as S
from viewspan.operators.study import SORTS


def test_shares_of_a_permutation_are_the_whole_column():
    sizes, counts = np.array([5, 3, 4, 7, 2]), [np.array([9, 12]), np.array([1, 15, 5])]
    shares = [S.permuted_share(counts, sizes, at, 3, 8) for at in range(5)]
    for k, c in enumerate(counts):
        assert (sum(s[k] for s in shares) == c).all()
        assert [int(s[k].sum()) for s in shares] == list(sizes)


@pytest.mark.parametrize("null", ["permute_columns", "pooled_resample"])
def test_blocks_give_the_null_of_the_matrix(spark, null, monkeypatch):
    """No task holds the study: with blocks of 16 the thresholds are those of nulls drawn of the whole matrix."""
    monkeypatch.setattr(S, "BLOCK", 16)
    replicated = X._replicated
    monkeypatch.setattr(X, "_replicated", lambda sorts, n: replicated(sorts, n) if sorts.isEmpty() else pytest.fail("a whole study in one row"))
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (70, 5)).astype(float) + np.arange(5) / 4
    x[np.ptp(x, axis=1) == 0, 0] += 1
    s = spark.createDataFrame([("s", f"n{i}", i + 1, j + 1, float(x[i, j])) for i in range(70) for j in range(5)], SORTS)
    got = X.parallel_analysis(s, 200, null=null, seed=4).orderBy("k").toPandas()
    assert len(got) == 70
    draw = (lambda: np.stack([rng.permutation(c) for c in x.T]).T) if null == "permute_columns" else (lambda: rng.choice(x.ravel(), size=x.shape))
    want = np.quantile([L.pca_of_rows(draw(), 1)[1] for _ in range(400)], 0.95, axis=0)
    np.testing.assert_allclose(got.threshold, want, rtol=0.05, atol=1e-6)
