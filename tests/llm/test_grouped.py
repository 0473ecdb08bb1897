"""Grouping by one sort of packed numbers gives what np.unique gives."""

import numpy as np
import pytest

from typoforge.llm.lm_scoring import grouped


@pytest.mark.parametrize("values", [[], [0], [5, 3, 5, 0, 3, 3], [2**62, 1, 2**62], list(np.random.default_rng(1).integers(0, 50, 1000))])
def test_grouped(values):
    v = np.array(values, np.int64)
    want = np.unique(v, return_index=True, return_inverse=True, return_counts=True)
    assert all(np.array_equal(a, np.reshape(b, -1)) for a, b in zip(grouped(v), want, strict=True))
