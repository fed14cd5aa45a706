"""Substring, exact, near and line deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from treeloom.llm import simhash as S
from treeloom.llm.exact_dedup import distinct_documents, exact_dedup
from treeloom.llm.fuse import FuseFilter
from treeloom.llm.line_dedup import line_dedup
from treeloom.llm.substring_dedup import substring_dedup

from .conftest import EDGE, PASSAGE, lower, words


def by_brute_substring(rows, window=13):
    """Expected (id, n_words, n_removed, kept text), one per row."""
    holders = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            holders[tuple(w[k : k + window])].add(float("inf") if i is None else i)
    out = []
    for i, t in rows:
        w, own = words(t), float("inf") if i is None else i
        gone = set()
        for k in range(len(w) - window + 1):
            if min(holders[tuple(w[k : k + window])]) < own:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def test_substring_dedup(docs, texts):
    got = Counter(map(tuple, substring_dedup(docs).collect()))
    assert got == by_brute_substring(texts.items())


def test_substring_dedup_edges(edge, none):
    got = Counter(map(tuple, substring_dedup(edge).collect()))
    assert got == by_brute_substring([(i, t) for i, t, _ in EDGE])
    assert substring_dedup(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(edge, window=5)


def test_planted_passage_is_removed_once(spark):
    rows = [(i, f"start{i} {PASSAGE} end{i}") for i in range(20)]
    out = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out[0].n_removed == 0
    assert all(out[i].kept_text == f"start{i} end{i}" for i in range(1, 20))


# ---- exact ---------------------------------------------------------------


def exact_expected(rows):
    groups = defaultdict(list)
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    for i, t in rows:
        groups[norm(t)].append((i, len(t or "")))
    out = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min(own, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup(docs, texts, edge, none):
    show = lambda df: Counter(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest"))).collect()))
    assert show(exact_dedup(docs)) == exact_expected(texts.items())
    assert show(exact_dedup(edge)) == exact_expected([(i, t) for i, t, _ in EDGE])
    assert exact_dedup(none).count() == 0


def test_distinct_documents_keeps_whole_rows(edge, none):
    out = distinct_documents(edge)
    assert out.columns == edge.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    norm = ["".join((t or "").split()) for _, t in rows]
    assert len(set(norm)) == len(norm)  # one of each
    assert set(norm) == {"".join((t or "").split()) for _, t, _ in EDGE}
    assert distinct_documents(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 30000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    f = FuseFilter.load(FuseFilter.build(keys).dump())
    assert f.holds(keys).all()
    assert f.holds(rng.integers(0, 1 << 63, 20000, dtype=np.uint64)).mean() < 0.001


# ---- near ----------------------------------------------------------------


def fingerprint(text, shingle=3):
    w = words(lower(text))
    sh = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def near_expected(rows, radius=3):
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, fps[i], least.get(find(i))) for i, (key, _) in enumerate(rows))


def show_groups(df):
    return Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in df.collect())


def test_simhash_groups(docs, texts, edge, none):
    assert show_groups(S.simhash_groups(docs)) == near_expected(list(texts.items()))
    assert show_groups(S.simhash_groups(edge)) == near_expected([(i, t) for i, t, _ in EDGE])
    assert S.simhash_groups(none).count() == 0


def test_simhash_hot_key_is_tiled(spark, monkeypatch):
    """Many near copies share a key; dealt to pairs of tiles they form one group all the same."""
    monkeypatch.setattr(S, "TILE", 16)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate(range(0, 400, 4))]
    got = show_groups(S.simhash_groups(spark.createDataFrame(rows, "doc_id bigint, text string")))
    assert got == near_expected(rows)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_forest(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 12, dtype=np.uint64)[rng.integers(0, 12, 150)]
    for _ in range(2):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    run = np.sort(rng.integers(0, 4, 150))

    def groups(pairs):
        parent = list(range(150))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in pairs:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        return [find(i) for i in range(150)]

    exact = [(i, j) for i in range(150) for j in range(i) if run[i] == run[j] and bin(int(fp[i] ^ fp[j])).count("1") <= radius]
    a, b = S._forest(run, fp, radius)
    assert len(a) < 150
    assert groups(zip(a.tolist(), b.tolist(), strict=True)) == groups(exact)


# ---- lines ---------------------------------------------------------------


def lines_expected(rows):
    """Rows with equal id and text are one document listed twice."""
    order = lambda i, h: (i is not None, i or 0, h)
    first = {}
    keyed = [(i, h, (t or "").split("\n")) for i, t, h in rows]
    for i, h, ls in keyed:
        for k in range(len(ls) - 2):
            w, at = tuple(ls[k : k + 3]), (*order(i, h), k)
            first[w] = min(at, first.get(w, at))
    out = []
    for i, h, ls in keyed:
        gone = {k + j for k in range(len(ls) - 2) if (*order(i, h), k) > first[tuple(ls[k : k + 3])] for j in range(3)}
        out.append((i, len(ls), len(gone), "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return Counter(out)


def test_line_dedup(docs, edge, none):
    for df in (docs, edge):
        rows = [(r[0], r[1], r[2]) for r in df.select("doc_id", "text", F.xxhash64("text")).collect()]
        assert Counter(map(tuple, line_dedup(df).collect())) == lines_expected(rows)
    assert line_dedup(none).count() == 0


def test_line_dedup_runs_no_python(docs):
    plan = line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
