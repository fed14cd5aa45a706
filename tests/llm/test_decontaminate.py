import re
from collections import Counter

import numpy as np
import pytest

from treeloom.llm.decontaminate import FMIndex, WaveletMatrix, find_leaks, suffix_array

from .conftest import EDGE, PASSAGE, lower


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def expected(rows, items, window=10):
    phrases = {}
    for item, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k and item is not None else 0):
            phrases.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = {len(p) for p in phrases}
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if own := phrases.get(tuple(w[a : a + k])):
                    hit |= set(range(a, a + k))
                    found |= own
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return Counter(out)


def show(df):
    return Counter((r.doc_id, r.leak_n_words, sum(s.stop - s.start for s in r.leak_spans), ",".join(r.leak_items)) for r in df.collect())


@pytest.mark.parametrize("slice_bytes", [1 << 20, 500])
def test_against_brute_force(spark, sf, docs, texts, slice_bytes):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert show(find_leaks(docs, bench, slice_bytes=slice_bytes)) == expected(texts.items(), items)


def test_edges(spark, edge, none):
    items = [(1, PASSAGE.upper()), (1, PASSAGE), (2, "a B c"), (3, None), (None, "a b"), (4, ""), (5, "?!"), (6, "é中 b")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = find_leaks(edge, bench)
    assert show(out) == expected([(i, t) for i, t, _ in EDGE], items)
    assert out.columns[: len(edge.columns)] == edge.columns
    assert find_leaks(none, bench).count() == 0
    assert show(find_leaks(edge, bench.limit(0))) == expected([(i, t) for i, t, _ in EDGE], [])
    with pytest.raises(ValueError):
        find_leaks(edge.withColumnRenamed("source", "leak_spans"), bench)


def test_planted_passage(spark):
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "clean words only"), (2, f"x, {PASSAGE}! y"), (3, " ".join(PASSAGE.split()[:9]))], "doc_id bigint, text string")
    assert {r.doc_id for r in find_leaks(docs, bench).where("size(leak_spans) > 0").collect()} == {2}


@pytest.mark.parametrize("seed", range(20))
def test_fm_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    text = np.append(rng.integers(0, 4, int(rng.integers(1, 80))), 0).astype(np.int32)
    fm = FMIndex(text, 3)
    for size in (1, 2, 4):
        phrases = rng.integers(1, 4, (10, size)).astype(np.int32)
        low, high = fm.search(phrases, np.full(10, size))
        for p, a, b in zip(phrases, low, high, strict=True):
            at = [i for i in range(len(text) - size + 1) if (text[i : i + size] == p).all()]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == at


def test_suffix_array_sorts_separators_by_place():
    text = np.array([1, 1, 0, 1, 1, 0])
    key = lambda i: [(x, -1 if x else j) for j, x in enumerate(text.tolist()[i:], i)]
    assert suffix_array(text).tolist() == sorted(range(6), key=key)


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    seq = rng.integers(0, 13, 500)
    w = WaveletMatrix(seq, 12)
    at = rng.integers(0, 500, 50)
    sym, before = w.access(at)
    assert (sym == seq[at]).all()
    assert before.tolist() == [(seq[:i] == seq[i]).sum() for i in at]
    assert w.rank(np.full(50, 7), at).tolist() == [(seq[:i] == 7).sum() for i in at]
