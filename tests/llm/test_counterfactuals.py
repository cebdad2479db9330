"""Counterfactual changes, however many."""

import numpy as np
from kelpgraph.llm import toxicity


def test_later_kinds_count_beyond_200000_changes():
    kinds = [[np.array([k]) for k in range(11)], [np.array([11]), np.array([12, 13])]]
    feature, value = np.repeat([0, 12], [21_000, 3]), np.repeat([0.5, 2.0], [21_000, 3])
    gram, number = toxicity.counterfactuals(feature, value, kinds, 14)
    assert number == 210_003
    want = np.zeros((14, 14))
    for other in range(1, 11):
        c = np.eye(14)[other] - np.eye(14)[0]
        want += 21_000 * 0.25 * np.outer(c, c)
    c = np.eye(14)[11] - np.eye(14)[12] - np.eye(14)[13]
    assert np.allclose(gram, want + 3 * 4 * np.outer(c, c))
