"""Flag frequencies counted by blocks equal those of the replicates' rows."""

import numpy as np
import pandas as pd
import pytest

from viewspan.operators import extraction as X
from viewspan.operators import gram as S
from viewspan.operators.study import SORTS


def test_counts_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3, 8))
    x = base[np.arange(40) % 3] + rng.normal(size=(40, 8)) * 0.7
    s = spark.createDataFrame([("s", f"n{i}", i + 1, j + 1, float(x[i, j])) for i in range(40) for j in range(8)], SORTS)
    keys = ["study_id", "p_idx", "factor"]
    want = X.flag_frequency(X.bootstrap(s, 3, 30)).toPandas().sort_values(keys).reset_index(drop=True)
    monkeypatch.setattr(X, "bootstrap", lambda *a, **k: pytest.fail("rows of replicates"))
    got = X.bootstrap_flags(s, 3, 30).toPandas().sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
