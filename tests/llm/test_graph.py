"""Connected components in one task and in rounds."""

import random

import pytest

from treeloom.llm import graph as G


def expected(edges):
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return {(n, r) for n, r in root.items() if n != r}


@pytest.mark.parametrize("alone", [0, G.ALONE])
def test_components(spark, monkeypatch, alone):
    """Chains, a hub, loops, repeated and reversed edges, numbers of both signs; no edges at all."""
    monkeypatch.setattr(G, "ALONE", alone)
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 2000 + i) for i in range(300)] + [(-5, -5), (7, 7)] + [(r.randrange(-50, 0), r.randrange(-50, 0)) for _ in range(30)]
    edges += [(b, a) for a, b in edges[::3]] + edges[::5]
    r.shuffle(edges)
    got = G.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)).collect()
    assert len(got) == len(set(got)) and {tuple(x) for x in got} == expected(edges)
    assert G.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_components(spark, monkeypatch):
    """Estimated sizes don't grow from round to round; the result of one run is joined and goes into another."""
    monkeypatch.setattr(G, "ALONE", 0)
    chain = [(i, i + 1) for i in range(300)]
    first = G.components(spark.createDataFrame(chain, "a bigint, b bigint"))
    edges = first.join(first.withColumnRenamed("root", "other"), "node").selectExpr("node a", "other b")
    assert {tuple(x) for x in G.components(edges).collect()} == {(i, 0) for i in range(1, 301)}
