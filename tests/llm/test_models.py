"""Toxicity and language model."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm import katz as L
from treeloom.llm import toxicity as X

from .brute_chain import BruteChain
from .conftest import EDGE, lower, words

CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def labelled(spark, n=600, start=0):
    """Toxic texts hold two of some insults; low quality ones a mark."""
    rng = np.random.default_rng(start)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(start, start + n):
        toxic, low = int(rng.random() < 0.2), int(rng.random() < 0.3)
        own = list(rng.choice(vocabulary, 40)) + (["zzz"] if low else []) + (list(rng.choice(["idiot", "moron", "clown", "scum"], 2)) if toxic else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own).capitalize()))
        marks.append((i, 1 - low, toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    chain = X.train(docs, labels, CATEGORIES)
    fresh, truth = labelled(spark, start=10_000)
    out = X.score(fresh, chain).join(truth, "doc_id").collect()
    hits = [r.p_toxic >= 0.4 for r in out if r.toxic]
    false = [r.p_toxic >= 0.4 for r in out if not r.toxic]
    assert np.mean(hits) > 0.95 and np.mean(false) < 0.02
    low = [(r.p_low_quality >= 0.5) == (r.quality == 0) for r in out]
    assert np.mean(low) > 0.95


def test_chain_equals_brute_force(spark, sf, docs, texts):
    """The chain on the test tables and on made texts, against dense fits of the same objective."""
    made, marks = labelled(spark, 400)
    fresh, _ = labelled(spark, 200, start=5_000)
    real = spark.read.parquet(f"{sf}/labels.parquet")
    for own, labels, asked in ((made, marks, fresh), (docs, real, docs)):
        rows = own.join(labels, "doc_id").select("text", (F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"), F.xxhash64("doc_id", "text").alias("k"))
        brute = BruteChain([(r[0], r[1:3]) for r in sorted(rows.collect(), key=lambda r: r.k)])
        scored = X.score(asked, X.train(own, labels, CATEGORIES, rounds=200)).collect()
        expected = brute.predict([r.text for r in scored])
        got = np.array([[r.p_low_quality, r.p_toxic] for r in scored])
        # features are hashed and steps end at a small gain: single texts may differ a little, decisions not
        assert np.abs(got - expected).max() < 0.1 and np.abs(got - expected).mean() < 0.005
        assert ((got[:, 1] >= 0.4) == (expected[:, 1] >= 0.4)).all()


def test_later_links_use_earlier_categories():
    """The second label equals the first; the text tells it only through the first."""
    n = 400
    y = (np.arange(n) % 2).astype(float)
    row, col = np.arange(n), np.where(y == 1, 5, 6)
    chain = X.Chain.fit(("a", "b"), row, col, np.ones(n, np.float32), np.stack([y, y], 1))
    assert chain.links[1].earlier.shape == (1,)
    assert chain.links[1].earlier[0] > 0


def test_training_is_bounded_and_repeatable(spark):
    docs, labels = labelled(spark, 200)
    a, b = (X.train(docs.repartition(k), labels, CATEGORIES, max_train=50) for k in (1, 5))
    assert np.allclose(a.links[1].weights, b.links[1].weights)


def test_toxicity_edges(spark, edge, none):
    docs, labels = labelled(spark, 100)
    bad = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (999999, 1, 1), (5, 1, 0)], labels.schema))
    chain = X.train(docs, bad, CATEGORIES)
    out = X.score(edge, chain)
    assert out.columns == [*edge.columns, "p_low_quality", "p_toxic"]
    assert out.count() == len(EDGE) and out.where("p_toxic is null").count() == 0
    assert X.score(none, chain).count() == 0
    assert X.score(none, X.train(none, labels.limit(0), CATEGORIES)).count() == 0
    empty = X.score(edge, X.train(none, labels, CATEGORIES))
    assert empty.where("p_toxic > 0.01").count() == 0
    with pytest.raises(ValueError):
        X.score(edge.withColumnRenamed("source", "p_toxic"), chain)


# ---- Katz ----------------------------------------------------------------


def simple_good_turing(counts):
    """Factors for counts 1 .. CUT, written apart from the operator: r* / r from a line through the
    logarithms of the counts of counts (zeros spread over neighbours), less the mass beyond the cut."""
    kinds = [sum(v == r for v in counts.values()) for r in range(1, L.CUT + 2)]
    seen = [r for r, n in enumerate(kinds, 1) if n]
    if len(seen) > 1:
        xs, ys = [], []
        for k, r in enumerate(seen):
            before = seen[k - 1] if k else 0
            after = seen[k + 1] if k + 1 < len(seen) else 2 * r - before
            xs.append(math.log(r))
            ys.append(math.log(kinds[r - 1] / (0.5 * (after - before))))
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
        if slope < -1:
            smooth = lambda r: r**slope
            beyond = (L.CUT + 1) * smooth(L.CUT + 1) / smooth(1)
            return {r: ((r + 1) * smooth(r + 1) / (r * smooth(r)) - beyond) / (1 - beyond) for r in range(1, L.CUT + 1)}
    one, two = kinds[0], kinds[1]
    part = min(max((one + 0.5) / (one + 2 * two + 1), 0.05), 0.95)
    return {r: (r - part) / r for r in range(1, L.CUT + 1)}


class Brute:
    """Katz backoff of any order over plain counters; discounts computed here."""

    def __init__(self, rows, order=2):
        self.order, self.counts = order, [Counter() for _ in range(order)]
        for t in rows:
            own = [*words(lower(t)), None]
            for k, c in enumerate(self.counts):
                padded = [0] * k + own
                c.update(tuple(padded[i : i + k + 1]) for i in range(len(own)))
        self.factors = [simple_good_turing(c) for c in self.counts]
        first = self.counts[0]
        self.n, self.v = sum(first.values()), len(first)
        kept = sum(self.d(1, c) * c for c in first.values())
        total = self.n if kept < self.n else self.n + 1
        self.p1 = {w: self.d(1, c) * c / total for (w,), c in first.items()}
        self.unknown = 1 - kept / total
        self.after = [None, *(defaultdict(dict) for _ in range(order - 1))]
        for c, after in zip(self.counts[1:], self.after[1:], strict=True):
            for g, n in c.items():
                after[g[:-1]][g[-1]] = n

    def d(self, level, c):
        return self.factors[level - 1][c] if c <= L.CUT else 1.0

    def p(self, context, w):
        if not context:
            return self.p1.get(w, self.unknown)
        level, own = len(context) + 1, self.after[len(context)].get(context)
        if own is None:
            return self.p(context[1:], w)
        total, kept = sum(own.values()), sum(self.d(level, c) * c for c in own.values())
        bottom = total if kept < total else total + 1
        if w in own:
            return self.d(level, own[w]) * own[w] / bottom
        return (1 - kept / bottom) / (1 - sum(self.p(context[1:], x) for x in own)) * self.p(context[1:], w)

    def score(self, t):
        own = [*words(lower(t)), None]
        padded = [0] * (self.order - 1) + own
        base = sum(math.log10((self.counts[0].get((w,), 0) + 1) / (self.n + self.v + 1)) for w in own)
        score = sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), w)) for i, w in enumerate(own))
        return len(own), sum(self.counts[0].get((w,), 0) > 0 for w in own), base, score


def in_training(i):
    return zlib.crc32(str(i).encode()) % 7 != 2


def fold():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2


@pytest.mark.parametrize("order, split", [(2, L.SPLIT), (2, 50), (3, L.SPLIT), (3, 50), (1, L.SPLIT), (4, L.SPLIT)])
def test_katz_scores(docs, texts, order, split):
    some = {i: t for i, t in texts.items() if i < 60} if order > 2 else texts
    brute = Brute((t for i, t in some.items() if in_training(i)), order)
    for r in L.katz_scores(docs.where(F.col("doc_id").isin(list(some))), fold(), split=split, order=order).collect():
        n, known, base, score = brute.score(texts[r.doc_id])
        assert (r.train, r.n_tokens, r.n_known, r.train_tokens) == (in_training(r.doc_id), n, known, brute.n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_distributions_sum_to_one(texts):
    brute = Brute(texts.values())
    for a in [(0,), *list(brute.after[1])[:5], ("never seen",)]:
        assert sum(brute.p(a, w) for (w,) in [*brute.counts[0], ("unknown",)]) == pytest.approx(1)


def test_katz_beats_the_base_on_held_out_text(docs):
    held = L.katz_scores(docs, fold()).where("not train").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held.s > held.b


def test_katz_edges(edge, none):
    rows = [(i, t) for i, t, _ in EDGE]
    brute = Brute(t for i, t in rows if in_training("" if i is None else i))
    got = sorted((r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in L.katz_scores(edge, fold()).collect())
    assert np.allclose(got, sorted(tuple(round(x, 6) for x in brute.score(t)) for _, t in rows), atol=1e-5)
    assert L.katz_scores(none, fold()).count() == 0
    silent = L.katz_scores(edge, F.lit(False)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in silent)


def test_discounts():
    d = L.discounts(np.array([1000, 400, 250, 180, 140, 110]))
    assert ((d[1:] > 0) & (d[1:] < 1)).all()
    fallback = L.discounts(np.array([5, 0, 0, 1, 0, 0]))
    assert ((fallback[1:] > 0) & (fallback[1:] < 1)).all()
