"""Compiled rules against the interpreter."""

import json

import pytest
from pyspark.sql import functions as F

from treeloom import queries as Q
from treeloom.operators import rewrite as W
from treeloom.plans import builders as B
from treeloom.plans import columns as K
from treeloom.plans import pipeline as D
from treeloom.plans.select import NotColumnar
from treeloom.sources.relational import documents, structs

from .test_rewrite import CASES

V = W.Var


def part(src, dst):
    return W.MapPart("_", W.MapObj(W.Obj(src), W.Obj(dst)))


def turns(name):
    return W.Obj({"turns": W.Each("t", W.Part("_", W.Obj({name: V("r")})))})


SYSTEM = W.Opt("has", W.Part("sys", W.Obj({"role": "system"})))
STATES = {"F": W.String("finished"), "O": W.String("open"), None: W.String("other")}
TALKS = {
    "each": [W.MapPart("_", W.MapObj(turns("role"), turns("speaker")))],
    "append": [part({"turns": W.Append(V("head"), W.Arr(V("last")))}, {"head": V("head"), "last": V("last")})],
    "prepend": [part({"turns": W.PrependOne(V("first"), V("rest"))}, {"first": V("first"), "rest": V("rest")})],
    "array with": [part({"turns": W.ArrWith(V("rest"), SYSTEM)}, {"system": SYSTEM, "turns": V("rest")})],
    "one": [part({"turns": W.One(V("t"))}, {"turn": V("t")})],
    "field roles": [W.AnnotateType("Conversation", W.FieldRoles({"turns": W.FieldRole(arr=True, roles=["Body"])}), "Module")],
    "several rules": [W.Mappings(W.AnnotateType("Conversation", None, "Module"), W.AnnotateType("Turn", None, "Statement"), W.AnnotateIfNoRoles("Turn", "Name"))],
    "two stages": [W.Map(W.Part("_", W.Obj({"@type": "Turn", "role": V("r")})), W.Part("_", W.Obj({"@type": "uast:Identifier", "Name": V("r")}))), W.AnnotateType("Conversation", None, "Module")],
    "errors of items": [part({"turns": W.Each("t", W.Part("_", W.Obj({"role": W.LookupVar("r", {"user": "U", "system": "S"})})))}, {"turns": W.Each("t", W.Part("_", W.Obj({"who": V("r")})))})],
    "errors of rules on items": [W.Map(W.Part("_", W.Obj({"@type": "Turn", "role": W.LookupVar("r", {"user": "U"})})), W.Part("_", W.Obj({"@type": "Turn", "who": V("r")})))],
    "rules on strings": [W.Map(W.Is("user"), W.Is("USER"))],
    "uncovered fields": [W.Map(W.Obj({"turns": V("t")}), W.Obj({"t": V("t")}))],
}
ORDERS = {
    "lookup with errors": [part({"o_orderpriority": W.LookupVar("p", {"1-URGENT": 1, "2-HIGH": 2})}, {"priority": V("p")})],
    "lookup of operations": [part({"o_orderstatus": V("s")}, {"o_orderstatus": V("s"), "state": W.LookupOpVar("s", STATES)})],
    "if": [part({"o_orderpriority": W.If("urgent", W.Is("1-URGENT"), V("p"))}, {"when": W.If("urgent", W.String("now"), V("p"))})],
    "cases": [part({"o_orderpriority": W.Cases("c", W.Is("1-URGENT"), W.Is("2-HIGH"), W.AnyNode())}, {"grade": W.Cases("c", W.String("A"), W.String("B"), W.String("Z"))})],
    "kinds": [part({"o_totalprice": W.VarKind("p", 64)}, {"price": V("p")})],
    "same variable": [part({"o_orderkey": V("x"), "o_orderstatus": V("x")}, {"x": V("x")})],
    "duplicate field": [part({"o_orderstatus": V("s")}, {"o_orderpriority": V("s")})],
    "not empty": [part({"lineitems": W.NotEmpty(V("l"))}, {"lines": V("l")})],
}


def shown(df):
    return {r.doc_id: (json.loads(r.doc), sorted(e.split(":")[0] for e in r.errors)) for r in df.collect()}


@pytest.mark.parametrize("name", [*TALKS, *ORDERS])
def test_compiled_equals_interpreted(spark, sf, name):
    level = B.conversation_level(spark, sf) if name in TALKS else B.order_level(spark, sf)
    if name in ORDERS:
        level.parent = ""
    rules = TALKS.get(name) or ORDERS[name]
    try:
        got = shown(K.as_json(structs(level), *rules, shape=level))
    except NotColumnar:
        assert name in ("duplicate field",)  # known beforehand to fail in every row
        return
    assert got == shown(D.rewrite(documents(level), *rules))


def test_cases_of_the_algebra(spark):
    """Every case of the algebra whose input has a type: forward and, with what comes out, backward."""
    done = 0
    for name, src, dst, given, made in CASES:
        for rule, before, after in ((W.Map(src, dst), given, made), (W.Map(dst, src), made, given)):
            if not isinstance(before, dict) or not before:
                continue
            text = json.dumps({"root": before})
            try:
                kind = spark.range(1).select(F.schema_of_json(F.lit(text))).first()[0]
                docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").select("doc_id", F.from_json("text", kind)["root"].alias("doc"))
                n, _ = K.compiled(docs, doc="doc")
                new, errors = K._applied(rule, n, True)
            except NotColumnar:
                continue
            if json.loads(docs.select(n.json()).first()[0]) != before:
                continue  # no column holds it
            row = docs.select(new.json().alias("doc"), (errors if errors is not None else F.lit(None).cast("string")).alias("e")).first()
            assert (json.loads(row.doc), row.e) == (json.loads(json.dumps(after)), None), name
            done += 1
    assert done >= 20


@pytest.mark.parametrize("mode", [D.NATIVE, D.PREPROCESSED, D.ANNOTATED, D.SEMANTIC, 0])
def test_pipelines(spark, sf, mode):
    """Modes of a pipeline, one whose preprocessing fails for some documents."""
    level = B.conversation_level(spark, sf)
    fails = W.Mappings(W.MapPart("_", W.MapObj(W.Obj({"conv_id": W.LookupVar("c", {i: i + 1000 for i in range(10)})}), W.Obj({"conv_id": V("c")}))))
    turn = W.Map(W.Part("_", W.Obj({"@type": "Turn", "role": V("r")})), W.Part("_", W.Obj({"@type": "uast:Identifier", "Name": V("r")})))
    for before in ([], [fails]):
        pipeline = D.Transforms("talk", before, [], [W.Mappings(turn)], [W.Mappings(W.AnnotateType("Conversation", None, "Module"), W.AnnotateType("Turn", None, "Statement"))])
        made = K.transform(structs(level), pipeline, mode, shape=level)
        told = D.transform(documents(level), pipeline, mode)
        assert sorted((r.doc_id, [e.split(":")[0] for e in r.errors]) for r in made.collect()) == sorted((r.doc_id, [e.split(":")[0] for e in r.errors]) for r in told.collect())
        types = {r.doc_id: r.t for r in made.select("doc_id", F.col("doc.`@type`").alias("t")).collect()}
        assert types == {r.doc_id: json.loads(r.doc)["@type"] for r in told.collect()}
    with pytest.raises(NotColumnar):
        K.transform(structs(level), D.Transforms(code=[None]), shape=level)


def test_not_columnar(spark):
    docs = spark.createDataFrame([(1, {"a": 1})], "doc_id bigint, doc struct<a:bigint>")
    for rule in (W.Map(W.Obj({"a": V("x")}), W.Obj({"b": V("y")})), W.Map(W.Obj({"a": V("x")}), W.Obj({})), W.Map(W.Obj({"a": W.Quote(V("x"))}), W.Obj({"a": V("x")}))):
        with pytest.raises(NotColumnar):
            K.rewrite(docs, rule)
    two_types = W.Map(W.Obj({"a": W.If("i", W.Is(1), V("x"))}), W.Obj({"a": W.If("i", W.String("one"), V("x"))}))
    with pytest.raises(NotColumnar):
        K.rewrite(docs, two_types)


def test_absent_and_nil_fields(spark):
    docs = spark.createDataFrame([(1, ("x", None)), (2, (None, 5)), (3, None)], "doc_id bigint, doc struct<a:string,b:bigint>")
    rule = W.Map(W.Fields(W.Field("a", V("a"), optional="has"), W.Field("b", V("b"))), W.Fields(W.Field("c", V("a"), optional="has"), W.Field("d", V("b"))))
    get = lambda absent: {r.doc_id: (r.doc, r.errors) for r in K.as_json(docs, rule, absent=absent).collect()}
    assert get(False) == {1: ('{"c":"x","d":null}', []), 2: ('{"c":null,"d":5}', []), 3: ("null", [])}
    assert get(True) == {1: ('{"a":"x"}', []), 2: ('{"d":5}', []), 3: ("null", [])}


COMPILED = [
    "rule_rename_field", "rule_partial", "rule_optional_field", "rule_lookup", "rule_lookup_op", "rule_if", "rule_cases", "rule_opt", "rule_any_elem", "rule_all", "rule_selectors", "rule_each", "rule_append", "rule_prepend", "rule_arr_with", "rule_one", "field_roles",
    "rule_reverse_roundtrip", "rule_drop_field", "rule_typed_obj", "rule_join", "rule_scopes", "rule_cases_obj", "operator_roles", "map_semantic", "uast_type", "comment_text",
]


@pytest.mark.parametrize("name", COMPILED)
def test_plans_hold_no_python(spark, sf, name):
    plan = Q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("MapInArrow", "MapInPandas", "EvalPython", "FlatMapGroups"))


def test_columns_are_pruned_to_the_scan(spark, sf):
    plan = Q.queries()["rule_partial"](spark, sf).select("uid")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint>" in plan
    plan = Q.queries()["rule_all"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "collect_list" not in plan
