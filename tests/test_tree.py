import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.functions import roles as R
from treeloom.functions import tree as T
from treeloom.functions import uast as U
from treeloom.operators import nodes as N

SCALARS = st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.integers(0, (1 << 64) - 1).map(T.Uint) | st.floats(allow_nan=False) | st.text()
TREES = st.recursive(SCALARS, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=15)


@pytest.mark.parametrize(
    "a, b, equal, hashed",
    [
        (None, None, True, True), (None, [], False, False), (None, {}, False, False), ([], {}, False, False), (1, T.Uint(1), True, False), (-1, T.Uint(1), False, False),
        (1, 1.0, False, False), (True, 1, False, False), ("a", "a", True, True), ({"a": None}, {}, False, False), ({"a": 1, "b": [2]}, {"b": [2], "a": 1}, True, True),
        ([1, 2], [2, 1], False, False), ({"a": {"b": 1.5}}, {"a": {"b": 1.5}}, True, True), ([None], [], False, False), ("1", 1, False, False),
    ],
)
def test_equality_and_hash(a, b, equal, hashed):
    assert T.equal(a, b) is equal and T.equal(b, a) is equal
    assert (T.hash_of(a) == T.hash_of(b)) is hashed


def test_hash_filter_keeps_keys():
    a, b = {"@pos": {"x": 1}, "n": 1}, {"@pos": {"x": 2}, "n": 1}
    assert U.hash_no_pos(a) == U.hash_no_pos(b) and U.hash_no_pos(a) != U.hash_no_pos({"n": 1})


def test_orders():
    root = [{"k1": 1, "k2": 2}, "v"]
    assert list(T.iterate(root)) == [root, root[0], 1, 2, "v"]
    assert list(T.iterate(root, T.POST)) == [1, 2, root[0], "v", root]
    assert list(T.iterate(root, T.LEVEL)) == [root, root[0], "v", 1, 2]
    obj = {"a": {"x": 1}, "b": 5, "c": [{"y": 1}, [{"z": 1}], "s"], "d": {}}
    assert list(T.iterate(obj, T.CHILDREN)) == [{"x": 1}, {"y": 1}, {"z": 1}, {}]
    assert T.children_count(obj) == 5 and T.children_count([1, 2]) == 2 and T.children_count("x") == 0


def test_counts_and_walks():
    root = {"a": [1, None], "b": {"c": "x", "d": 2.5}, "e": None}
    assert (T.count(root), T.count(root, T.NOT_NIL), T.count(root, T.VALUES)) == (8, 6, 3)
    seen = []
    T.walk(root, lambda n: (seen.append(n), not isinstance(n, list))[1])
    assert None in seen and 1 not in seen
    paths = []
    T.walk_paths(root, lambda n, p: paths.append(p))
    assert ("b", "d") in paths and ("a", 1) in paths


def test_apply_is_bottom_up_and_shares():
    root = {"a": [1, 2], "b": {"c": 3}}
    order = []

    def up(n):
        order.append(n)
        return (n + 1, True) if n == 2 else (n, False)

    out, changed = T.apply(root, up)
    assert changed and out == {"a": [1, 3], "b": {"c": 3}} and root["a"] == [1, 2]
    assert out["b"] is root["b"] and order[-1] == out
    assert T.apply(root, lambda n: (n, False)) == (root, False)


def test_kinds_and_values():
    assert T.split_kinds(T.STRING | T.BOOL) == [T.STRING, T.BOOL] and T.kind_name(T.NIL) == "Nil"
    assert T.same([], []) is False and T.same(1, 1) and not T.same(1, T.Uint(1))
    assert T.to_node({"a": 2.0, "b": 2.5, "c": (1,)}) == {"a": 2, "b": 2.5, "c": [1]}
    assert isinstance(T.to_node(2.0), int)
    with pytest.raises(TypeError):
        T.to_node(object())
    assert T.to_node(object(), lambda _: "x") == "x"
    with pytest.raises(ValueError):
        T.Uint(-1)
    texts = [(None, ""), (True, "true"), (3, "3"), (T.Uint(1 << 63), str(1 << 63)), (0.1, "0.1"), (1234567.5, "1.2345675e+06"), (1e-5, "1e-05"), (123456.5, "123456.5"), (-0.0001, "-0.0001"), (1e100, "1e+100")]
    assert [T.to_string(v) for v, _ in texts] == [s for _, s in texts]


@settings(max_examples=60, deadline=None)
@given(TREES)
def test_numbering(root):
    rows = N.node_rows(1, root)
    assert [r["pre"] for r in rows] == list(range(len(rows))) and len(rows) == T.count(root)
    by = {r["pre"]: r for r in rows}
    for r in rows[1:]:
        up = by[r["parent"]]
        assert up["pre"] < r["pre"] <= r["pre"] + r["size"] <= up["pre"] + up["size"] and r["level"] == up["level"] + 1
    post = sorted(rows, key=lambda r: r["pre"] + r["size"] - r["level"])
    assert [r["pre"] + r["size"] - r["level"] for r in post] == list(range(len(rows)))
    assert T.equal(T.clone(root), root) and T.hash_of(T.clone(root)) == T.hash_of(root)


# ---- typed nodes ---------------------------------------------------------


def test_registry():
    made = U.TYPES.to_node("uast:Alias", {"Name": {"@type": "uast:Identifier", "Name": "a"}, "Node": 1})
    assert made == {"@type": "uast:Alias", "Name": {"@type": "uast:Identifier", "Name": "a"}, "Node": 1}
    assert U.TYPES.node_as(made | {"extra": 1}, "uast:Alias") == {"@pos": None, "Name": made["Name"], "Node": 1}
    assert U.TYPES.node_as({}, "uast:Bool")["Value"] is False
    for bad in ({"@type": "uast:Bool"}, "text", {"Name": 5}):
        with pytest.raises(TypeError):
            U.TYPES.node_as(bad, "uast:Identifier")
    with pytest.raises(KeyError):
        U.TYPES.to_node("uast:Bool", {"Wrong": 1})
    with pytest.raises(ValueError):
        U.TYPES.register("uast", {})
    with pytest.raises(KeyError):
        U.TYPES.lookup("uast:None")


def test_tokens_content_roles():
    ident = {"@type": "uast:Identifier", "Name": "foo"}
    assert U.content_of(ident) == "foo" and U.content_of({"@type": "uast:Bool", "Value": True}) == "true"
    assert U.content_of("x") == "x" and U.content_of([1]) == "" and U.content_of({"@token": 5}) == "5"
    tree = {"@token": "a", "k": [{"@token": "b"}, {"@token": ""}, {"z": {"@token": "c"}}]}
    assert U.tokens(tree) == ["a", "b", "c"]
    assert U.roles_of({"@type": "x", "@role": ["Name", "nonsense", 1]}) == ["Name", "Invalid", "Identifier"]
    assert U.roles_of({"@type": "go:x"}) == ["Unannotated"] and U.roles_of(ident) == [] and U.roles_of({}) == []
    assert R.valid("Name") and not R.valid("Invalid") and len(R.ROLES) == 118


def test_positions():
    p = [U.position(*x) for x in ((3, 4, 1), (0, 1, 1), (0, 0, 0))]
    own = [{"@type": "uast:Identifier", "@pos": {"@type": "uast:Positions", "start": x}} for x in p]
    assert U.positional(own) == [own[1], own[0], own[2]]
    assert U.less(p[1], p[0]) and not U.less(p[2], p[0]) and U.less(p[0], p[2])
    assert not U.valid(p[2]) and U.has_offset(p[1]) and U.positions_of({"x": 1}) == {}


def test_imports():
    s = lambda v: {"@type": "uast:String", "Value": v}
    i = lambda v: {"@type": "uast:Identifier", "Name": v}
    tree = [
        {"@type": "uast:Import", "Path": i("a")}, {"@type": "uast:RuntimeImport", "Path": s("a")},
        {"@type": "uast:RuntimeReImport", "Path": {"@type": "uast:QualifiedIdentifier", "Names": [i("a"), i("b")]}}, {"@type": "uast:InlineImport", "Path": {"@type": "uast:Alias", "Name": i("q"), "Node": s("c")}},
    ]
    assert U.import_paths(tree) == ["a", "a/b", "c"]


# ---- the table against the model -----------------------------------------

SAMPLE = {
    "@type": "ns:A", "@token": "t", "@role": ["Name", 2], "n": None, "f": 2.5, "list": [1, "x", None, {"@type": "B", "@token": "u"}, [True]], "big": (1 << 64) - 1,
    "@pos": {"@type": "uast:Positions", "start": {"@type": "uast:Position", "offset": 3, "line": 1, "col": 4}},
}


@pytest.fixture(scope="module")
def sample(spark):
    docs = [(1, json.dumps(SAMPLE)), (2, "[]"), (3, "{bad"), (4, None), (5, json.dumps({"@type": "B", "f": 3.0}))]
    return spark.createDataFrame(docs, "doc_id bigint, doc string")


def test_shred(spark, sample):
    table = N.shred(sample).cache()
    assert {r.doc_id for r in table.select("doc_id").distinct().collect()} == {1, 2, 5}
    assert {r.doc_id for r in N.rejects(sample).collect()} == {3, 4}
    root = table.where("doc_id = 1 and pre = 0").first()
    assert (root.ns, root.local, root.token, root.roles) == ("ns", "A", "t", ["Name", "Qualified"])
    assert root.attrs["start-col"] == ["4"] and root.attrs["role"] == ["Name", "Qualified"] and root.attrs["list"] == ["1", "x", ""] and root.attrs["n"] == [""]
    assert {(r.doc_id, r.n) for r in N.counts(table, T.VALUES).collect()} == {(1, T.count(T.to_node(SAMPLE), T.VALUES)), (2, 0), (5, 2)}
    for order in (T.PRE, T.POST, T.LEVEL):
        got = [r.kind for r in N.ranked(table, order).where("doc_id = 1").orderBy("rank").collect()]
        assert got == [T.kind_of(n) & ~T.INT | (T.INT if T.kind_of(n) == T.INT else 0) for n in T.iterate(N.parse_json(json.dumps(SAMPLE)), order)]
    counts = {(r.doc_id, r.pre): r.n for r in N.children_counts(table).collect()}
    assert counts[1, 0] == T.children_count(SAMPLE) and counts[2, 0] == 0
    assert {r.doc_id: r.tokens for r in N.tokens(table).collect()} == {1: ["t", "u"]}
    texts = {(r.doc_id, r.pre): r.t for r in table.select("doc_id", "pre", N.scalar_text().alias("t")).collect()}
    assert sorted(t for (d, _), t in texts.items() if d == 5 and t is not None) == ["3", "B"]
    pruned = N.pruned(table, F.col("kind") == T.ARRAY)
    assert pruned.where("doc_id = 1 and kind = 4").count() == 2 and pruned.where("doc_id = 1").count() < table.where("doc_id = 1").count()
    assert N.subtrees(table, table.where("doc_id = 1 and field = 'list'")).count() == 1 + table.where("doc_id = 1 and field = 'list'").first().size
    assert N.object_parents(table).where("obj is not null").count() == 3


def test_hashes_tell_trees_apart(spark):
    trees = [{"a": 1}, {"a": 1}, {"a": "1"}, [1], {"a": [1]}, {"a": None}, {}, [], {"@pos": {"x": 1}}, {"@pos": {"x": 2}}]
    table = N.shred(spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "doc_id bigint, doc string"))
    h = {r.doc_id: r.hash for r in N.hashes(table).collect()}
    for i in h:
        for j in h:
            assert (h[i] == h[j]) == (T.hash_of(trees[i]) == T.hash_of(trees[j]))
    p = {r.doc_id: r.hash for r in N.hashes(table, drop_positions=True).collect()}
    assert p[8] == p[9] != p[6]


@pytest.mark.parametrize("part", [1, 2, 3, 5, 1 << 16])
def test_hashes_of_subtrees_do_not_depend_on_parts(spark, monkeypatch, part):
    monkeypatch.setattr(N, "_PART", part)
    deep = {"a": [{"a": [1, {"b": None}], "c": "x" * 100}, {"a": [1, {"b": None}], "c": "x" * 100}, {"a": [{"b": None}, 1], "c": "x" * 99}]}
    trees = [deep, {"z": deep, "y": [deep, "1", 1]}, [], {}, 1, None, {"@pos": {"x": 1}, "k": [1]}, {"@pos": {"x": 2}, "k": [1]}]
    table = N.shred(spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "doc_id bigint, doc string"))
    h = {(r.doc_id, r.pre): r.hash for r in N.subtree_hashes(table).collect()}
    own = {}
    for i, t in enumerate(trees):
        todo, pre = [T.to_node(t)], 0
        while todo:  # pre-order, nils included
            n = todo.pop()
            own[i, pre], pre = n, pre + 1
            todo += [n[k] for k in sorted(n, reverse=True)] if isinstance(n, dict) else n[::-1] if isinstance(n, list) else []
    assert own.keys() == h.keys()
    assert all((h[a] == h[b]) == (T.hash_of(own[a]) == T.hash_of(own[b])) for a in h for b in h)
    p = {(r.doc_id, r.pre): r.hash for r in N.subtree_hashes(table, drop_positions=True).collect()}
    assert p[6, 0] == p[7, 0] and h[6, 0] != h[7, 0]


def test_subtree_hashes_of_deep_trees(spark):
    """One plan without a job before it, whatever the depth; trees are read once."""
    docs = [(i, '{"a":' * 3000 + str(i % 2) + "}" * 3000) for i in range(4)]
    found = N.subtree_hashes(N.shred(spark.createDataFrame(docs, "doc_id bigint, doc string")))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert found.agg(F.count(F.lit(1)), F.countDistinct("hash")).first()[:] == (12004, 6002)


def test_rules_on_rows(spark, sample):
    table = N.shred(sample)
    out = N.annotate_type(table, "B", "Name", "Body").where("type = 'B'").collect()
    assert [r.roles for r in out] == [["Name", "Body"]] * 2
    assert {r.type for r in N.default_namespace(table, "x").where("type <> ''").collect()} >= {"x:B", "ns:A"}
    assert {(r.local, r.n) for r in N.forbidden_types(table, ["A", "B", "C"]).collect()} == {("A", 1), ("B", 2)}
    assert table.where(N.has_type("B") & N.has_field("f")).count() == 1


def test_float_text(spark):
    values = [0.5, -0.5, 1234567.5, 12345678.25, 1e-5, 0.00025, -0.00025, 3.0, 1e15 + 0.5, 123456.789, 1e300, 999.001]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.float_text(F.col("v")).alias("t"))
    for r in df.collect():
        expected = T.to_string(T.to_node(r.v)) if r.v < 9e18 else T.shortest_float(r.v)
        assert r.t.replace("E", "e+") == expected or float(r.t) == r.v
    plain = {r.v: r.t for r in df.collect()}
    assert plain[1234567.5] == "1.2345675e+06" and plain[3.0] == "3" and plain[0.00025] == "0.00025" and plain[12345678.25] == "1.234567825e+07"
