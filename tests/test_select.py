import json
import random

import pytest

from treeloom.functions import tree as T
from treeloom.operators import nodes as N
from treeloom.operators import rewrite as W
from treeloom.plans.select import NotColumnar, select

SELECTORS = [
    W.Is(1), W.Is("a"), W.Is(None), W.EmptyObj(), W.Is([]), W.Is(2.5), W.Is(True), W.OfKind(T.INT | T.ARRAY), W.Not(W.Is(1)), W.NotNil(), W.ObjNot(W.Has({"k": 1})), W.ObjNot(W.Is({})), W.In(1, "a", None), W.HasType("A"),
    W.Has({"k": W.In(1, 2)}), W.Has({"k": W.Has({"x": W.NotNil()})}), W.HasFields({"k": True, "x": False}), W.AnyElem(W.Is(1)), W.All(W.OfKind(T.INT)), W.All(W.Has({"k": W.Any_()})), W.And(W.OfKind(T.OBJECT), W.Not(W.Has({"@type": "A"}))),
    W.And(W.Has({"k": W.AnyElem(W.Is("a"))}), W.HasFields({"@type": True})), W.Not(W.AnyElem(W.Not(W.Is(1)))),
]


def tree(r, depth=3):
    kind = r.random()
    if depth == 0 or kind < 0.4:
        return r.choice([1, 2, "a", "b", None, 2.5, True, [], {}])
    if kind < 0.65:
        return [tree(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {k: tree(r, depth - 1) if k != "@type" else r.choice("AB") for k in r.sample(["k", "x", "@type", "y"], r.randint(0, 3))}


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(7)
    trees = [tree(r) for _ in range(60)]
    return trees, N.shred(spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "doc_id bigint, doc string")).cache()


@pytest.mark.parametrize("i", range(len(SELECTORS)))
def test_plan_equals_interpreter(corpus, i):
    trees, table = corpus
    sel = SELECTORS[i]
    expected = set()
    for d, t in enumerate(trees):
        at = [0]

        def visit(n, d=d, at=at):
            if sel.matches(n):
                expected.add((d, at[0]))
            at[0] += 1

        T.walk(t, visit)
    out = select(table, sel).select("doc_id", "pre").collect()
    assert len(out) == len(set(out))
    assert {(r.doc_id, r.pre) for r in out} == expected


def test_not_columnar(corpus):
    for sel in (W.Var("x"), W.Is({"a": 1}), W.Has({"k": W.Var("x")})):
        with pytest.raises(NotColumnar):
            select(corpus[1], sel)
