"""Ranks of small groups of rows are found without pandas and are the same."""

import numpy as np
import pandas as pd
import pytest

from viewspan.operators import correlation as C


def test_small_groups_need_no_frames(monkeypatch):
    x = np.random.default_rng(4).integers(-2, 3, (40, 11)).astype(float)
    want = pd.DataFrame(x.T).rank().to_numpy().T
    monkeypatch.setattr(C, "PIECE", 1)
    np.testing.assert_array_equal(C._mid_ranks(x), want)
    monkeypatch.undo()
    monkeypatch.setattr(C.pd, "DataFrame", lambda *_: pytest.fail("a frame for each small group"))
    np.testing.assert_array_equal(C._mid_ranks(x), want)
    np.testing.assert_array_equal(C._unit_ranks(x), C._unit(want))
