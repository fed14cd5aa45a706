"""Discounts of counts of counts that do not fall evenly."""

import numpy as np
import pytest

from treeloom.llm import katz as L

#: n-grams that occur 1 .. 6 times in the training fold of the test tables
KINDS = [
    [16698, 3601, 1290, 594, 471, 213], [45315, 4880, 1537, 331, 336, 86], [49663, 12919, 5197, 2729, 2383, 1067],
    [193655, 25105, 6496, 2179, 2497, 618], [207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580],
]


@pytest.mark.parametrize("kinds", KINDS)
def test_good_turing_is_applied(kinds):
    r = np.arange(1, L.CUT + 1)
    b = np.polyfit(np.log(np.arange(1, L.CUT + 2)), np.log(kinds), 1)[0]
    s = lambda x: np.asarray(x, float) ** b
    rest = (L.CUT + 1) * s(L.CUT + 1) / s(1)
    d = L.discounts(np.array(kinds))
    assert d[1:] == pytest.approx(((r + 1) * s(r + 1) / (r * s(r)) - rest) / (1 - rest))
    assert (np.diff(d[1:]) > 0).all() and d[1] > 0 and d[L.CUT] < 1
    assert np.ptp(r * (1 - d[1:])) > 0.05  # not one amount off every count


def test_counts_that_do_not_fall():
    for kinds in ([10, 10, 10, 10, 10, 10], [0, 0, 0, 0, 0, 0], [7, 0, 0, 0, 0, 0]):
        d = L.discounts(np.array(kinds))
        assert ((d[1:] > 0) & (d[1:] < 1)).all()
