import json

import pytest

from treeloom.functions import tree as T
from treeloom.functions.text import Comment, quote, unquote
from treeloom.operators import rewrite as W
from treeloom.plans import pipeline as D

V, F = W.Var, W.Field


def typed(**fields):
    return {"@type": "x", **fields}


#: name, source, destination, input, expected; every case runs forward, backward and as identities
CASES = [
    ("constant", W.Is(5), W.Is("five"), 5, "five"),
    ("constant tree", W.Is({"a": [1, None]}), W.EmptyObj(), {"a": [1, None]}, {}),
    ("variable", W.Obj({"a": V("x")}), W.Obj({"b": V("x")}), {"a": [1, {"c": None}]}, {"b": [1, {"c": None}]}),
    ("kind of variable", W.Obj({"a": W.VarKind("x", T.STRING)}), W.Obj({"b": V("x")}), {"a": "s"}, {"b": "s"}),
    ("same variable twice", W.Obj({"a": V("x"), "b": V("x")}), W.Obj({"c": V("x")}), {"a": 1, "b": T.Uint(1)}, {"c": 1}),
    ("nested", W.Obj({"a": W.Obj({"b": V("x")})}), W.Obj({"c": V("x")}), {"a": {"b": 1}}, {"c": 1}),
    ("part", W.Part("p", W.Obj({"a": V("x")})), W.Part("p", W.Obj({"b": V("x")})), {"a": 1, "z": 2, "y": None}, {"b": 1, "z": 2, "y": None}),
    ("join", W.JoinObj(W.Obj({"a": V("x")}), W.Part("p", W.Obj({"b": V("y")}))), W.JoinObj(W.Obj({"a": V("y")}), W.Part("p", W.Obj({"b": V("x")}))), {"a": 1, "b": 2, "c": 3}, {"a": 2, "b": 1, "c": 3}),
    ("optional there", W.Fields(F("a", V("x"), optional="o")), W.Fields(F("b", V("x"), optional="o")), {"a": None}, {"b": None}),
    ("optional missing", W.Fields(F("a", V("x"), optional="o")), W.Fields(F("b", V("x"), optional="o")), {}, {}),
    ("opt nil", W.Obj({"a": W.Opt("o", V("x"))}), W.Obj({"b": W.Opt("o", V("x"))}), {"a": None}, {"b": None}),
    ("opt", W.Obj({"a": W.Opt("o", V("x"))}), W.Obj({"b": W.Opt("o", V("x"))}), {"a": 3}, {"b": 3}),
    ("lookup", W.Obj({"a": W.LookupVar("x", {1: "one", "2": None})}), W.Obj({"a": V("x")}), {"a": 1}, {"a": "one"}),
    ("lookup nil", W.Obj({"a": W.LookupVar("x", {1: "one", "2": None})}), W.Obj({"a": V("x")}), {"a": "2"}, {"a": None}),
    ("if then", W.If("i", W.Is("a"), V("x")), W.If("i", W.Is("b"), W.Obj({"v": V("x")})), "a", "b"),
    ("if else", W.If("i", W.Is("a"), V("x")), W.If("i", W.Is("b"), W.Obj({"v": V("x")})), "c", {"v": "c"}),
    ("cases", W.Cases("c", W.Is(1), W.Is(2)), W.Cases("c", W.Is("1"), W.Is("2")), 2, "2"),
    ("cases of objects", W.CasesObj("c", W.Obj({"k": V("k")}), [W.Obj({"t": 1}), W.Obj({"t": 2})]), W.CasesObj("c", W.Obj({"k": V("k")}), [W.Obj({"u": "a"}), W.Obj({"u": "b"})]), {"k": 0, "t": 2}, {"k": 0, "u": "b"}),
    ("array", W.Arr(W.Is(1), V("x")), W.Arr(V("x"), W.Is(1)), [1, 2], [2, 1]),
    ("one", W.One(V("x")), W.Obj({"v": V("x")}), [5], {"v": 5}),
    ("each", W.Each("e", W.Obj({"a": V("x")})), W.Each("e", W.Obj({"b": V("x")})), [{"a": 1}, {"a": 2}], [{"b": 1}, {"b": 2}]),
    ("each of nothing", W.Each("e", V("x")), W.Each("e", W.Arr(V("x"))), [], []),
    ("each of nil", W.Each("e", V("x")), W.Each("e", W.Arr(V("x"))), None, None),
    ("append", W.Append(V("h"), W.Arr(W.Is("t"))), W.Append(V("h"), W.Arr(W.Is("u"), W.Is("v"))), [1, 2, "t"], [1, 2, "u", "v"]),
    ("append arrays", W.AppendArr(W.Arr(V("a")), W.Arr(V("b"))), W.AppendArr(W.Arr(V("b")), W.Arr(V("a"))), [1, 2], [2, 1]),
    ("prepend", W.PrependOne(V("f"), V("r")), W.Obj({"f": V("f"), "r": V("r")}), [1, 2, 3], {"f": 1, "r": [2, 3]}),
    ("array with", W.Obj({"a": W.ArrWith(V("r"), W.Obj({"k": V("k")}))}), W.Obj({"k": V("k"), "r": V("r")}), {"a": [1, {"k": 5}]}, {"k": 5, "r": [1]}),
    ("scope", W.Arr(W.OpScope("s", V("x")), V("x")), W.Arr(V("x"), W.OpScope("s", V("x"))), [1, 2], [2, 1]),
    ("quote", W.Quote(V("x")), W.Obj({"s": V("x")}), '"a\\né"', {"s": "a\né"}),
    ("uncomment line", W.UncommentCLike("x"), W.Obj({"s": V("x")}), "// text", {"s": " text"}),
    ("uncomment block", W.UncommentCLike("x"), W.Obj({"s": V("x")}), "/* a\nb */", {"s": " a\nb "}),
    ("uncomment", W.Uncomment("x", "<!--", "-->"), W.Obj({"s": V("x")}), "<!--a-->", {"s": "a"}),
    ("sequence", W.Seq(V("x")), W.Obj({"s": V("x")}), 5, {"s": 5}),
    ("check", W.Check(W.Not(W.Is(0)), V("x")), W.Obj({"s": V("x")}), 5, {"s": 5}),
    ("roles after", W.Part("_", W.Fields(W.RolesField("r"))), W.Part("_", W.Fields(W.RolesField("r"))), {"@role": ["Name"], "a": 1}, {"@role": ["Name"], "a": 1}),
    ("lookup of operations", W.Obj({"a": V("k"), "b": W.LookupOpVar("k", {1: W.Is("one"), None: V("x")})}), W.Obj({"a": V("k"), "c": W.LookupOpVar("k", {1: W.Is("uno"), None: V("x")})}), {"a": 1, "b": "one"}, {"a": 1, "c": "uno"}),
    ("lookup of arrays", W.Obj({"a": V("k"), "b": W.LookupArrOpVar("k", {1: W.Arr(W.Is(1)), None: W.Arr()})}), W.Obj({"a": V("k"), "c": W.LookupArrOpVar("k", {1: W.Arr(W.Is(2)), None: W.Arr()})}), {"a": 7, "b": []}, {"a": 7, "c": []}),
    ("typed", W.UASTType("uast:Identifier", {"Name": V("n")}), W.Obj({"n": V("n")}), {"@type": "uast:Identifier", "Name": "x"}, {"n": "x"}),
    ("comment", W.CommentText("/*", "*/", "c"), W.CommentNode(True, "c"), "/* a\n * b */", {"@type": "uast:Comment", "Block": True, "Text": "a\nb", "Prefix": " ", "Suffix": " ", "Tab": " * "}),
]


def once(rule, n):
    st = W.State()
    assert rule.src.check(st, n)
    out = rule.dst.build(st)
    st.validate()
    return out


@pytest.mark.parametrize("name, src, dst, before, after", CASES, ids=[c[0] for c in CASES])
def test_both_directions(name, src, dst, before, after):
    copy = T.clone(before)
    rule = W.Map(src, dst)
    assert T.equal(once(rule, before), after)
    assert T.equal(before, copy)
    assert T.equal(once(W.Reverse(rule), after), before)
    assert T.equal(once(W.Identity(src), before), before)
    assert T.equal(once(W.Identity(dst), after), after)


NO_MATCH = [
    (W.Is(5), "5"), (W.Obj({"a": V("x")}), {}), (W.Obj({"a": W.Is(1)}), {"a": 2}), (W.Arr(V("x")), [1, 2]), (W.Arr(V("x")), {}), (W.NotEmpty(V("x")), []), (W.NotEmpty(V("x")), None),
    (W.Each("e", W.Is(1)), [1, 2]), (W.Append(V("h"), W.Arr(W.Is(1))), []), (W.PrependOne(V("a"), V("b")), []), (W.CommentText("/*", "*/", "c"), "// x"), (W.StringConv(V("x"), str, str), 5),
    (W.Cases("c", W.Is(1), W.Is(2)), 3), (W.If("i", W.Is(1), W.Is(2)), 3), (W.Part("p", W.Obj({"a": V("x")})), {"b": 1}), (W.UASTType("uast:Identifier", {"Name": V("n")}), {"@type": "uast:Bool", "Name": "x"}),
]


@pytest.mark.parametrize("pattern, n", NO_MATCH)
def test_no_match(pattern, n):
    assert pattern.check(W.State(), n) is False


ERRORS = [
    ("unused field", W.Obj({"a": V("x")}), {"a": 1, "b": 2}), ("variable redeclared", W.Obj({"a": V("x"), "b": V("x")}), {"a": 1, "b": 2}), ("unhandled value", W.LookupVar("x", {1: 2}), 3),
    ("variable not defined", W.Obj({"a": W.LookupOpVar("k", {1: V("x")}), "b": V("k")}), {"a": 1, "b": 1}), ("unhandled value", W.Fields(F("b", V("k")), F("a", W.LookupOpVar("k", {1: V("x")}))), {"a": 1, "b": 2}),
]


@pytest.mark.parametrize("kind, pattern, n", ERRORS)
def test_errors(kind, pattern, n):
    with pytest.raises(W.RuleError) as e:
        pattern.check(W.State(), n)
    assert e.value.kind == kind


def test_construction_errors():
    with pytest.raises(W.RuleError, match="ambiguous"):
        W.LookupVar("x", {1: "a", 2: "a"})
    with pytest.raises(W.RuleError, match="duplicate"):
        W.JoinObj(W.Obj({"a": V("x")}), W.Obj({"a": V("y")}))
    W.JoinObj(W.Obj({"a": 1}), W.Obj({"a": 1}))
    with pytest.raises(W.RuleError, match="undefined"):
        W.UASTType("uast:Identifier", {"Wrong": V("x")})
    with pytest.raises(ValueError):
        W.MapPart("p", W.Map(W.Obj({}), W.Part("q", W.Obj({}))))
    with pytest.raises(ValueError):
        W.CasesObj("c", None, [W.Obj({"a": 1}), W.Obj({"b": 1})])
    with pytest.raises(ValueError):
        W.ObjectToNode(line_key="l").mapping()
    for bad in (W.FieldRole(arr=True, opt=True, roles=["Name"]), W.FieldRole(opt=True), W.FieldRole(skip=True, roles=["Name"]), W.FieldRole(skip=True, rename="x")):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(W.RuleError, match="duplicate"):
        once(W.Map(W.Part("p", W.Obj({"a": V("x")})), W.Part("p", W.Obj({"b": V("x")}))), {"a": 1, "b": 2})
    with pytest.raises(W.RuleError, match="unused"):
        once(W.Map(W.Obj({"a": V("x")}), W.EmptyObj()), {"a": 1})


@pytest.mark.parametrize(
    "sel, yes, no",
    [
        (W.OfKind(T.INT | T.STRING), [1, "a"], [None, T.Uint(1), [], True]), (W.Not(W.OfKind(T.NIL)), [1, {}], [None]), (W.NotNil(), [0, ""], [None]), (W.ObjNot(W.Has({"a": 1})), [{}, {"a": 2}], [{"a": 1}, 5]),
        (W.Has({"a": W.In(1, None)}), [{"a": 1, "b": 2}, {"a": None}], [{}, {"a": 2}, 5]), (W.HasType("x"), [{"@type": "x"}], [{"@type": "y"}, {}]), (W.HasFields({"a": True, "b": False}), [{"a": None}], [{}, {"a": 1, "b": 2}]),
        (W.In(1, "a", None), [1, "a", None], [T.Uint(1), 1.0, "b", []]), (W.AnyElem(W.Is(1)), [[2, 1]], [[], [2], 1]), (W.All(W.Is(1)), [[], [1, 1]], [[1, 2], 1]), (W.And(W.OfKind(T.OBJECT), W.Has({"a": 1})), [{"a": 1}], [{}, 1]),
        (W.EmptyObj(), [{}], [[], None, {"a": 1}]), (W.UintIs(3), [T.Uint(3), 3], [3.0, "3"]), (W.Bool(True), [True], [1, False]),
    ],
)
def test_selectors(sel, yes, no):
    assert all(sel.matches(n) for n in yes) and not any(sel.matches(n) for n in no)


def test_guards_bind_nothing():
    st = W.State()
    assert W.Check(W.Has({"a": V("x")}), W.AnyNode()).check(st, {"a": 1}) and not st.vars


def test_drop_and_any():
    drop = W.Map(W.Fields(F("a", W.Is(1), drop=True), F("b", V("x"))), W.Obj({"b": V("x")}))
    assert once(drop, {"a": 1, "b": 2}) == {"b": 2} and once(drop, {"b": 2}) == {"b": 2}
    assert once(W.Reverse(drop), {"b": 2}) == {"a": 1, "b": 2}
    assert once(W.Map(W.AnyNode(), W.AnyVal(5)), {"x": 1}) == 5 and once(W.Map(W.Any_(), W.Any_()), 1) is None


# ---- rule lists and stages -----------------------------------------------


def test_dispatch():
    a = W.Map(W.Part("_", W.Obj({"@type": "A"})), W.Part("_", W.Obj({"@type": "B", "a": 1})))
    b = W.Map(W.Part("_", W.Obj({"@type": "B"})), W.Part("_", W.Obj({"@type": "C", "b": 1})))
    any_ = W.Map(W.Check(W.HasFields({"seen": False}), W.Part("_", W.Obj({"@type": V("t")}))), W.Part("_", W.Obj({"@type": V("t"), "seen": True})))
    stage = W.Mappings(a, b, any_)
    assert stage.types == ["A", "B"]
    assert stage.do({"@type": "A"}) == {"@type": "B", "a": 1, "seen": True}  # candidates are those of A
    assert stage.do({"@type": "D", "k": [{"@type": "B"}]}) == {"@type": "D", "seen": True, "k": [{"@type": "C", "b": 1, "seen": True}]}


def test_errors_keep_the_node():
    rule = W.Map(W.Obj({"a": W.LookupVar("x", {1: "one"})}), W.Obj({"b": V("x")}))
    tree, errors = W.Mappings(rule).run([{"a": 1}, {"a": 2}, {"a": 3}])
    assert tree == [{"b": "one"}, {"a": 2}, {"a": 3}] and len(errors) == 2
    with pytest.raises(W.MultiError, match="received 2 errors"):
        W.Mappings(rule).do([{"a": 2}, {"a": 3}])
    with pytest.raises(W.RuleError):
        W.Mappings(rule).do([{"a": 2}])


def test_annotations():
    rule = W.AnnotateType("If", W.FieldRoles({"cond": W.FieldRole(roles=["Condition"]), "body": W.FieldRole(arr=True, roles=["Body"]), "else": W.FieldRole(opt=True, roles=["Else"]), "op": W.FieldRole(rename="@token")}), "Statement", "If")
    tree = {"@type": "If", "cond": {"@type": "c"}, "body": [{"@type": "s", "@role": ["Call"]}], "else": None, "op": "if", "more": 1}
    out = W.Mappings(rule).do(tree)
    assert out == {"@type": "If", "@role": ["Statement", "If"], "cond": {"@type": "c", "@role": ["Condition"]}, "body": [{"@type": "s", "@role": ["Call", "Body"]}], "else": None, "@token": "if", "more": 1}
    assert W.Mappings(W.AnnotateType("x", None, "Name")).do(typed(**{"@role": ["Call"]})) == typed(**{"@role": ["Call", "Name"]})
    guarded = W.Mappings(W.AnnotateIfNoRoles("x", "Name"))
    assert guarded.do(typed()) == typed(**{"@role": ["Name"]}) and guarded.do(typed(**{"@role": ["Call"]})) == typed(**{"@role": ["Call"]})
    by_type = W.Map(W.EachObjectRolesByType("v", {"x": []}), W.EachObjectRolesByType("v", {"x": ["Name"], "": ["Value"]}, "Body"))
    assert W.AnnotateTypeCustomMap("x", None, lambda t: ["Alias"] if t == "x" else [], None, "Name").dst is not None and by_type.src is not None
    typed_each = W.Map(W.Obj({"v": W.Each("e", W.Part("p", W.Obj({"@type": V("t")})))}), W.Obj({"v": W.Each("e", W.Part("p", W.Fields(F("@type", V("t")), F("@role", W.LookupArrOpVar("t", W.StringToRolesMap({"a": ["Name"]}) | {None: W.Roles("Value")})))))}))
    assert once(typed_each, {"v": [{"@type": "a"}, {"@type": "b"}]}) == {"v": [{"@type": "a", "@role": ["Name"]}, {"@type": "b", "@role": ["Value"]}]}
    assert W.RolesDedup().do(typed(**{"@role": ["Name", "Call", "Name"]})) == typed(**{"@role": ["Name", "Call"]})
    operator = W.Map(W.Obj({"op": V("o")}), W.Operator("o", W.StringToRolesMap({"+": ["Add"]}), "Binary"))
    assert once(operator, {"op": "+"}) == {"@type": "uast:Operator", "@token": "+", "@role": ["Add", "Expression", "Operator", "Binary"]}


def test_semantic():
    pos = {"@type": "uast:Positions", "start": {"@type": "uast:Position", "offset": 1}}
    rule = W.MapSemantic("Name", "uast:Identifier", W.MapObj(W.Obj({"@token": V("n")}), W.Obj({"Name": V("n")})))
    assert once(rule, {"@type": "Name", "@token": "x", "@pos": pos}) == {"@type": "uast:Identifier", "Name": "x", "@pos": pos}
    part = W.Map(W.Obj({"n": V("n"), "k": V("k")}), W.UASTTypePart("p", "uast:Identifier", {"Name": V("n")}))
    assert part.dst.full is False
    to = W.ObjectToNode(type_key="t", offset_key="o", line_key="l", column_key="c", end_offset_key="e")
    with pytest.raises(W.RuleError, match="duplicate"):
        to.mapping()  # start is given twice
    native = W.Mappings(W.ObjectToNode(type_key="t", line_key="l", column_key="c"))
    assert native.do({"t": "x", "l": 1, "c": 2, "k": 3}) == {"@type": "x", "k": 3, "@pos": {"@type": "uast:Positions", "start": {"@type": "uast:Position", "offset": 0, "line": 1, "col": 2}}}
    assert native.do({"t": "x"}) == {"@type": "x", "@pos": {"@type": "uast:Positions"}}
    assert W.ResponseMetadata().do({"root": {"a": 1}}) == {"a": 1} and W.ResponseMetadata(True).do({"root": 1}) == {"root": 1}
    assert W.DefaultNamespace("ns").do([{"@type": "a"}, {"@type": "b:c"}, {"x": 1}]) == [{"@type": "ns:a"}, {"@type": "b:c"}, {"x": 1}]


@pytest.mark.parametrize(
    "source, start, end, text, prefix, suffix, indent",
    [
        ("// text", "//", "", "text", " ", "", ""), ("/* text */", "/*", "*/", "text", " ", " ", ""), ("/*\n  a\n  b\n*/", "/*", "*/", "a\nb", "\n  ", "\n", "  "), ("/* a\n * b\n * c\n */", "/*", "*/", "a\nb\nc", " ", "\n ", " * "),
        ("/* a\nb\n  c */", "/*", "*/", "a\nb\n  c", " ", " ", ""), ("/**/", "/*", "*/", "", "", "", ""), ("/*  */", "/*", "*/", "", "  ", "", ""), ("# a", "#", "", "a", " ", "", ""), ("/* é\n\t x\n\t\ty*/", "/*", "*/", "é\n x\n\ty", " ", "", "\t"),
        ("/*a\nb*/", "/*", "*/", "a\nb", "", "", ""), ("<!-- a -->", "<!--", "-->", "a", " ", " ", ""),
    ],
)
def test_comments(spark, source, start, end, text, prefix, suffix, indent):
    from pyspark.sql import functions as F

    from treeloom.functions.text import comment_columns

    c = Comment.split(source, start, end)
    assert (c.text, c.prefix, c.suffix, c.indent) == (text, prefix, suffix, indent)
    assert c.join() == source
    row = spark.createDataFrame([(source,)], "s string").select(*(v.alias(k) for k, v in comment_columns(F.col("s"), start, end).items())).first()
    assert (row.text, row.prefix, row.suffix, row.indent) == (text, prefix, suffix, indent)
    assert Comment.split("x" + source, start, end) is None and Comment.split("  " + source, start, end, trim=True).text == text


def test_quote():
    for s in ("", "a\tb\\\"'", "é\x00\x7f", "\U0001f600\u200b"):
        assert unquote(quote(s)) == s
    assert unquote("`a\\n`") == "a\\n" and unquote("'x'") == "x" and unquote('"\\x41\\101\\U0001F600"') == "AA😀"
    for bad in ("", '"', "'ab'", '"\\q"', '"a', 'a"', '"a"b"', "\"\\'\""):
        with pytest.raises(ValueError):
            unquote(bad)


def test_rules_over_documents(spark):
    rule = W.Map(W.Obj({"a": W.LookupVar("x", {1: "one"})}), W.Obj({"b": V("x")}))
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 5}'), (3, None), (4, "bad"), (5, json.dumps([{"a": 1}] * 3))], "doc_id bigint, doc string")
    out = {r.doc_id: (r.doc, r.errors) for r in D.rewrite(docs, rule).collect()}
    assert out[1] == ('{"b":"one"}', []) and out[3] == (None, []) and out[5][0] == '[{"b":"one"},{"b":"one"},{"b":"one"}]'
    assert out[2][0] == '{"a":5}' and len(out[2][1]) == 1 and out[4][0] == "bad" and len(out[4][1]) == 1
    assert {r.doc_id for r in D.matching(docs, W.Has({"a": W.In(1)})).where("matched").collect()} == {1}
