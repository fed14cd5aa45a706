import json

import pytest

from treeloom.functions import roles as R
from treeloom.operators import nodes as N
from treeloom.plans import xpath as X
from treeloom.sources.relational import Level, Trees, documents

ROOT = {"@type": "A", "key": "val", "keys": ["a", "b"], "one": {"@type": "B"}, "sub": [{"@type": "C"}, {"@type": "d:X"}]}
IDENTS = [
    {"@type": "uast:Identifier", "Name": "Foo", "@pos": {"@type": "uast:Positions", "start": {"@type": "uast:Position", "offset": 7, "line": 1, "col": 3}}},
    {"@type": "Ident", "@token": "A", "@role": [R.number("Identifier"), R.number("Name")]},
]


@pytest.fixture(scope="module")
def table(spark):
    docs = [(1, json.dumps(ROOT)), (2, json.dumps(IDENTS))]
    return N.shred(spark.createDataFrame(docs, "doc_id bigint, doc string")).cache()


def pres(table, q, doc=1):
    return sorted(r.pre for r in X.execute(table, q).where(f"doc_id = {doc}").collect())


# pre-order numbers in ROOT: A 0, @type 1, key 2, keys 3 (a 4, b 5), one/B 6 (@type 7), sub 8 (C 9, @type 10, X 11, @type 12)
NODE_SETS = [
    ("/", [0]), ("/A", [0]), ("/A/one", [6]), ("/A/one/B", [6]), ("/A/sub", [8]), ("/A/sub/C", [9]), ("//one", [6]), ("//B", [6]), ("//C", [9]), ("//d:X", [11]), ("//X", []), ("//d:*", [11]), ("/A/key", [2]),
    ("/A/key[text() = 'val']", [2]), ("/A/keys", [3]), ("//*[text() = 'a']", [3]), ("//A[@key='val']", [0]), ("//A[@keys='a']", [0]), ("//A[@keys='c']", []), ("//A[@keys or @key]", [0]), ("//A[@keys and @no]", []),
    ("//C/..", [8]), ("//C/../..", [0]), ("//C/ancestor::A", [0]), ("//C/ancestor::*", [0, 8]), ("//C/ancestor::node()", [0, 0, 8]), ("//C/ancestor-or-self::C", [9]), ("//sub/*[2]", [11]), ("//sub/*[last()]", [11]),
    ("//sub/*[position()=1]", [9]), ("//C/following-sibling::*", [11]), ("//d:X/preceding-sibling::*", [9]), ("//d:X/preceding-sibling::*[1]", [9]), ("//key/following-sibling::one", [6]), ("//B/following::C", [9]), ("//C/preceding::B", [6]),
    ("//C | //B", [6, 9]), ("//C | //C", [9]), ("//A[not(zzz)]/sub/C", [9]), ("//A[zzz]/sub/C", []), ("//A[one/B]", [0]), ("//A[.//d:X]", [0]), ("//A[count(sub/*)=2]", [0]), ("//A[key/text()='val' or zzz]", [0]),
    ("//*[name()='d:X']", [11]), ("//*[local-name()='X']", [11]), ("/A/keys/text()", [4, 5]), ("/A/keys/text()[2]", [5]), ("//sub/self::sub", [8]), ("//sub/self::one", []), ("//A[one = '']", [0]), ("//A[contains(@key, 'a')]", [0]),
    ("//A[starts-with(@key, 'v') and string-length(@key) = 3]", [0]), ("//A[@key != 'val']", []), ("//A[substring(@key, 2, 1) = 'a']", [0]), ("//A[translate(@key, 'v', 'w') = 'wal']", [0]), ("(//C | //B)[1]", [6]), ("//A/sub/*[name()='C' or name()='d:X']", [9, 11]),
    ("//A[concat(@key, '!') = 'val!']", [0]), ("//A[normalize-space(' a  b ') = 'a b']", [0]), ("//A[substring-before(@key, 'l') = 'va' and substring-after(@key, 'v') = 'al']", [0]), ("/descendant::C", [9]), ("/descendant-or-self::node()/C", [9]),
    ("//A[true() and not(false())]", [0]), ("//comment()", []), ("//A[key = one]", [0]), ("//A[keys/text() = key/text()]", []), ("//A[sub/C][one]", [0]),
]


@pytest.mark.parametrize("q, expected", NODE_SETS, ids=[q for q, _ in NODE_SETS])
def test_node_sets(table, q, expected):
    assert pres(table, q) == expected


@pytest.mark.parametrize(
    "q, expected",
    [
        ("boolean(//*[@blah])", False), ("boolean(/A)", True), ("name(//A)", "A"), ("name(//d:X)", "d:X"), ("local-name(//d:X)", "X"), ("count(//*)", 12.0), ("string(/A/keys/text())", "a"), ("string(/A)", ""), ("1 + 2 * 3 - 4 div 2", 5.0), ("7 mod 4", 3.0),
        ("not(//zzz)", True), ("count(//C) = 1", True), ("concat('a', 1, true())", "a1true"), ("number('12.5')", 12.5), ("round(2.5) + floor(2.9) + ceiling(2.1)", 8.0), ("sum(//zzz)", 0.0), ("'a' = 'b' or 2 > 1", True), ("-(3)", -3.0), ("lower-case('AbC')", "abc"),
        ("ends-with('abc', 'bc') and matches('abc', '^a')", True),
    ],
)
def test_scalars(table, q, expected):
    assert {r.doc_id: r.value for r in X.execute(table, q).collect()}[1] == expected


@pytest.mark.parametrize(
    "q, expected",
    [("//uast:Identifier[@Name='Foo']", 1), ("//uast:Identifier/Name[text() = 'Foo']/..", 1), ("//*[@start-col=3]", 1), ("//Identifier", 0), ("//*[name() = 'uast:Identifier']", 1), ("//Ident", 1), ("//Ident[text() = 'A']", 1), ("//Ident[@role = 'Name']", 1), ("//Ident[@role = 'Identifier']", 1), ("//Ident[@role = 'Invalid']", 0), ("//Ident[@token='A']", 1), ("//*[@start-offset > 5 and @start-line < 2]", 1)],
)
def test_identifiers(table, q, expected):
    assert len(pres(table, q, 2)) == expected


def test_attributes(table):
    got = sorted((r.name, r.value) for r in X.execute(table, "/A/@*").where("doc_id = 1").collect())
    assert got == [("@type", "A"), ("key", "val"), ("keys", "a"), ("keys", "b")]
    assert [r.value for r in X.execute(table, "//A/@keys[. = 'b']").collect()] == ["b"]


@pytest.mark.parametrize("q", ["//*[@role='Variable']*//Name", "//[", "foo(", "//a[1", "a b", "//a[@]", "", "unknown(1)", "wrong::a", "//a]"])
def test_malformed(q):
    with pytest.raises(X.XPathError):
        X.prepare(q)


@pytest.mark.parametrize("q", ["translate('a', 'b')", "substring('a')", "count(1)", "sum('a')", "not()", "true(1)", "concat('a')"])
def test_wrong_arguments(q):
    with pytest.raises(X.XPathError):
        X.prepare(q)


@pytest.mark.parametrize(
    "q, expected",
    [
        ("substring('12345', 2, 1 div 0)", "2345"), ("substring('12345', 1.5, 2.6)", "234"), ("substring('12345', 0, 3)", "12"), ("substring('12345', 0 div 0, 3)", ""), ("substring('12345', 1, 0 div 0)", ""),
        ("substring('12345', -42, 1 div 0)", "12345"), ("substring('12345', -1 div 0, 1 div 0)", ""), ("substring('12345', 4)", "45"), ("substring('12345', 9)", ""), ("translate('bar', string('abc'), 'AB')", "BAr"), ("translate('--aaa--', 'abc-', string('ABC'))", "AAA"),
        ("string(1 div 0)", "Infinity"), ("string(-1 div 0)", "-Infinity"), ("string(0 div 0)", "NaN"), ("floor(1 div 0)", float("inf")), ("ceiling(1.2)", 2.0), ("ceiling(-1.2)", -1.0), ("round(2.5)", 3.0), ("round(-2.5)", -2.0), ("floor(12345678901234567890)", 12345678901234567890.0),
    ],
)
def test_functions(table, q, expected):
    assert {r.value for r in X.execute(table, q).collect()} == {expected}


def test_sums_and_whole_numbers(spark):
    docs = spark.createDataFrame([(1, '{"a": [{"@type": "B", "v": "1"}, {"@type": "B", "v": "q"}]}'), (2, '{"a": [{"@type": "B", "v": "1"}, {"@type": "B", "v": 2.5}]}'), (3, '{"a": [{"@type": "B", "v": 3}]}'), (4, "{}")], "doc_id bigint, doc string")
    got = {r.doc_id: (r.value, r.whole) for r in X.execute(N.shred(docs), "sum(//B/@v)").collect()}
    assert got[1][0] != got[1][0] and got[1][1] is None
    assert got[2] == (3.5, None) and got[3] == (3.0, 3) and got[4] == (0.0, 0)
    held = lambda q: {r.doc_id for r in X.execute(N.shred(docs), q).where("value").collect()}
    assert held("//B/@v > 2") == {2, 3} and held("//B/@v < 1 + 1") == {1, 2} and held("//B/@v >= //B/@v") == {1, 2, 3} and held("//B/@v < //B/@v") == {2} and held("//B/@v != //B/@v") == {1, 2}


def test_results_are_typed():
    assert [X.prepare(q).result for q in ("//a", "count(//a)", "name(//a)", "//a = 1", "//a | //b")] == ["nodes", "number", "string", "boolean", "nodes"]


# ---- relational trees ----------------------------------------------------


@pytest.fixture(scope="module")
def relational(spark):
    kids = spark.createDataFrame([(10, 1, "x", 1.5), (11, 1, "y", 2.0), (12, 2, None, -0.25)], "k int, p int, name string, n double")
    leaves = spark.createDataFrame([(10, True, 3), (10, False, 4), (12, None, 5)], "kid int, flag boolean, ord bigint")
    top = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, label string")
    leaf = Level("t:Leaf", leaves, "ord", ["flag", "ord"], parent="kid", order=["ord"])
    kid = Level("Kid", kids, "k", ["k", "name", "n"], parent="p", order=["k"], children={"leaves": leaf})
    return Level("Top", top, "id", ["id", "label"], children={"kids": kid})


def test_relational_trees_equal_shredded_documents(relational):
    cols = ["doc_id", "pre", "size", "level", "parent", "field", "ord", "kind", "type", "ns", "local", "s", "i", "f", "b"]
    show = lambda df: sorted(map(str, (tuple(x if x != "" else None for x in r) for r in df.select(*cols).collect())))
    assert show(Trees(relational).table()) == show(N.shred(documents(relational)))
    attrs = lambda df: {(r.doc_id, r.pre): r.attrs for r in df.where("kind = 2").collect()}
    assert attrs(Trees(relational).table()) == attrs(N.shred(documents(relational)))


@pytest.mark.parametrize("q", ["//Kid", "/Top/kids/Kid[@n > 1]/name/text()", "//t:Leaf/ancestor::Kid", "//Kid[leaves/t:Leaf]/@k", "//Kid[1]", "//*[@flag='true']", "//Kid/..", "//Kid/following-sibling::*", "//t:Leaf/preceding::name", "//node()", "count(//Kid)", "/Top[not(kids/Kid)]/@id", "//Kid[count(leaves/*) = 2] | //t:Leaf"])
def test_summary_prunes_without_changing_results(relational, q):
    show = lambda df: sorted(map(str, df.collect()))
    trees = Trees(relational)
    assert show(X.execute(trees, q)) == show(X.execute(trees.table(), q))


KEYED = [
    "//Kid", "//Kid/@name", "/Top/kids/Kid[@n > 1]/name/text()", "//Kid[leaves/t:Leaf]/@k", "//Kid[not(leaves/t:Leaf)]/@k", "//Kid[leaves/t:Leaf[@flag='true']]/@k", "//t:Leaf/@ord", "//t:Leaf/../../@k", "//Kid[@n > 1]//t:Leaf/@ord", "//Kid/name[text()='x']/../@k", "count(//t:Leaf)",
    "sum(//Kid/@n)", "boolean(//Kid[@name='y'])", "/Top[not(kids/Kid)]/@id", "//Kid[count(leaves/t:Leaf) = 2]/@k", "//Kid[count(leaves/t:Leaf) < 1]/@k", "//flag/text()", "//*[@flag='true']/@ord", "/Top/@label", "//t:Leaf[ord/text()='4']/@flag", "sum(//Kid/@name)",
    "//Top[kids/Kid/leaves/t:Leaf[@ord=5]]/@id", "//Kid[not(@name='x') and leaves]/@k", "//nothing", "//Kid[nothing]", "//t:Leaf/ancestor::Top/@id", "//t:Leaf[@flag='true']/ancestor::*/@k", "//Kid/ancestor-or-self::Kid/@k", "//Kid[1]/@k", "//Kid/following-sibling::*/@k", "//leaves/..",
]


@pytest.mark.parametrize("q", KEYED)
def test_keys_give_the_same_values(relational, q):
    trees = Trees(relational)
    expected = X.execute(trees.table(), q)
    show = lambda df: sorted(map(str, df.select([c for c in ("doc_id", "cls", "name", "value") if c in df.columns]).collect()))
    assert show(X.values(trees, q)) == show(expected)


def test_keyed_plans_number_nothing(relational):
    plan = X.values(Trees(relational), "//Kid[leaves/t:Leaf[@flag='true']]/@k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and "Union" not in plan


def test_only_reachable_branches_are_planned(relational):
    plan = X.execute(Trees(relational), "//Kid[@n > 1]/leaves/t:Leaf")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
