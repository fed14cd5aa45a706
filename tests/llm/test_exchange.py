"""Packed exchanges send rows and do work in proportion to their keys, however many homes there are."""

import numpy as np
import pytest

from treeloom.llm import katz as L
from treeloom.llm import substring_dedup as S


@pytest.mark.parametrize("homes", [8, 1_000, 1_000_000, 1 << 31])
def test_rows_are_bounded_by_keys(homes):
    rng = np.random.default_rng(homes)
    keys = np.sort(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2))
    parts = S._buckets(keys, homes)
    assert len(parts) <= min(homes, len(keys)) and parts[0][1] == 0 and parts[-1][2] == len(keys)
    assert all(a[0] < b[0] and a[2] == b[1] for a, b in zip(parts, parts[1:], strict=False)) and all(0 <= i < homes and x < y for i, x, y in parts)
    home = L._home(keys, homes)
    dealt = L.Dealt(home)
    seen = np.concatenate([own for _, own in dealt])
    assert len(list(dealt)) <= min(homes, len(keys)) and sorted(seen.tolist()) == list(range(len(keys)))
    assert all((home[own] == i).all() and (dealt.of(i) == own).all() for i, own in dealt)
    assert len(dealt.of(homes + 1)) == 0


def test_no_keys():
    none = np.zeros(0, np.uint64)
    assert S._buckets(none, 7) == [] and list(L.Dealt(L._home(none, 7))) == []


def test_rows_grow_in_proportion():
    """Four sizes of a corpus: batches and ranges grow with it, rows sent stay under the keys."""
    rng = np.random.default_rng(1)
    sent = []
    for size in (1, 4, 16, 64):
        batches, ranges = 4 * size, size
        sent.append(sum(len(S._buckets(np.sort(rng.integers(0, 1 << 63, 200, dtype=np.uint64)), ranges * 50)) for _ in range(batches)))
    assert all(b <= 4.5 * a or b <= 4 * 64 * 200 for a, b in zip(sent, sent[1:], strict=False)) and sent[-1] <= 4 * 64 * 200
