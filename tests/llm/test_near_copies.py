"""SimHash near-duplicates up to a similarity against brute force."""

import numpy as np
import pytest

from treeloom.llm import near_copies as J
from treeloom.llm.simhash import planes_of, within

from .conftest import EDGE, lower, words


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def kept(rows, least=0.8):
    """Ids that stay: the smallest of each group (ids are distinct here)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9 > 0:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def test_texts_of_similarity_08_are_one(docs, texts):
    assert {r.doc_id for r in J.near_distinct_documents(docs).collect()} == kept(list(texts.items()))


@pytest.mark.parametrize("sample, tile", [(1, J.TILE), (16, J.TILE), (1, 2)])
def test_groups_at_the_bound(spark, monkeypatch, sample, tile):
    """Copies with more and more words changed, a chain, a passage that all share, and short texts."""
    monkeypatch.setattr(J, "SAMPLE", sample)
    monkeypatch.setattr(J, "TILE", tile)
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    base, common = [word() for _ in range(204)], [word() for _ in range(30)]
    out = [base]
    for changes in range(1, 14):
        own = list(base)
        for at in rng.choice(204, changes, replace=False):
            own[at] = word()
        out.append(own)
    now = [word() for _ in range(120)]
    for _ in range(6):
        now = [*now[8:], *(word() for _ in range(8))]
        out.append(now)
    out += [[*common, *(word() for _ in range(k))] for k in (0, 1, 3, 7, 8, 40, 41)]
    out += [["a", "b"], ["A", "b"], ["a", "b", "c"], []]
    rows = [(i, " ".join(w)) for i, w in enumerate(out)]
    got = J.near_distinct_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == kept(rows)


@pytest.mark.parametrize("tile", [4, 16])
def test_large_groups_in_tiles(spark, monkeypatch, tile):
    """Two large groups of copies that are candidates of each other but not similar, with bridges between some."""
    monkeypatch.setattr(J, "TILE", tile)
    rng = np.random.default_rng(tile)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    base = [word() for _ in range(150)]
    half = [*base[:128], *(word() for _ in range(22))]
    rows = []
    for root in (base, half):
        for _ in range(25):
            own = list(root)
            for at in rng.choice(150, 2, replace=False):
                own[at] = word()
            rows.append(own)
    rows += [[word() for _ in range(60)] for _ in range(5)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    assert {r.doc_id for r in J.near_distinct_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == kept(rows)


def test_edges(edge, none):
    out = J.near_distinct_documents(edge)
    assert out.columns == edge.columns
    sets = [frozenset(shingles(t)) for _, t, _ in EDGE]
    assert out.count() == len(set(sets)) - 1  # the passage with a word before and after is like the passage
    assert J.near_distinct_documents(none).count() == 0
    with pytest.raises(ValueError):
        J.near_distinct_documents(edge, least=0.7)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 26, 40])
def test_comparison_is_exact_at_any_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fp = base[rng.integers(0, 8, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    planes = planes_of(fp)
    for d in (1, 2, 63, 64, 100):
        same = np.zeros(planes.shape[1] * 64, bool)
        same[: len(fp) - d] = True
        hit = np.unpackbits(within(planes, d, np.packbits(same, bitorder="little").view("<u8"), radius).view(np.uint8), bitorder="little")
        assert hit[: len(fp) - d].tolist() == [int(bin(int(x) ^ int(y)).count("1") <= radius) for x, y in zip(fp[:-d], fp[d:], strict=True)]
