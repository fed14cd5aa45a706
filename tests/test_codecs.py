import json

import pytest
from hypothesis import given, settings
from pyspark.sql import functions as F

from treeloom.functions import roles as R
from treeloom.functions import tree as T
from treeloom.functions import uast as U
from treeloom.operators import nodes as N
from treeloom.operators import rewrite as W
from treeloom.plans import pipeline as D
from treeloom.sources import codecs as S
from treeloom.sources import graph as G
from treeloom.sources import manifest as M
from treeloom.sources import yaml_text as Y

from .test_tree import TREES

SIZES = [
    ([{"k": ["A"], "k2": 42}], 46), ({"@type": "node", "k": ["A"], "k2": 42, "k3": {"@type": "node"}}, 73), ({"@type": "node", "k": {"@type": "node", "k": None}}, 48),
    ([{"@type": "node", "k": ["n1", "n2"]}, {"@type": "node", "k": ["n1", "n2"]}], 61), ([[], {}], 22),
]


@pytest.mark.parametrize("tree, size", SIZES)
def test_graph_sizes(tree, size):
    raw = G.write_tree(tree)
    assert len(raw) == size and T.equal(G.read_tree(raw), tree)


def test_raw_graph():
    g = G.read_graph(G.write_tree(SIZES[2][0]))
    assert (g.root, g.last) == (1, 6)
    assert [(n.id, n.kind, n.value, n.keys, n.values) for n in g.nodes.values()] == [(1, 2, None, [2, 3], [4, 5]), (2, 8, "@type", [], []), (3, 8, "k", [], []), (4, 8, "node", [], []), (5, 2, None, [2, 3], [4, 0])]


@settings(max_examples=80, deadline=None)
@given(TREES)
def test_graph_round_trip(tree):
    back = G.read_tree(G.write_tree(tree))
    assert T.equal(back, tree) and T.hash_of(back) == T.hash_of(tree)


def test_bad_graphs():
    good = G.write_tree({"a": 1})
    for bad in (b"", b"xxxx" + good[4:], good[:4] + b"\x02" + good[5:], good[:-1]):
        with pytest.raises(G.GraphError):
            G.read_tree(bad)
    head = G.MAGIC + b"\x01\0\0\0"
    loop = head + G.framed(b"\x10\x01") + G.framed(G._numbers(8, [1]))
    with pytest.raises(G.GraphError, match="tree"):
        G.read_tree(loop)
    two = G.read_graph(head + G.framed(b"") + G.framed(b"\x12\x01a") + G.framed(b"\x12\x01b"))
    assert two.tree() == ["a", "b"]
    with pytest.raises(G.GraphError, match="limit"):
        list(G.messages(G.varint(11 << 20)))
    assert G.skip_message(G.framed(b"abc") + b"x", 0) == 4


def test_graph_frames(spark):
    docs = spark.createDataFrame([(1, '{"a": [1, 2.5, null]}'), (2, None)], "doc_id bigint, doc string")
    files = G.encode(docs)
    assert {r.doc_id: r.doc for r in G.decode(files).collect()} == {1: '{"a": [1, 2.5, null]}', 2: None}
    assert G.raw_nodes(files).count() == 5
    broken = files.withColumn("graph", F.lit(b"no"))
    assert all(r.error for r in G.decode(broken).collect())


YAML = [
    (None, "~"), ([], "[]"), ({}, "{}"), ("a", "a"), ("@type", "'@type'"), (["a"], "[a]"), (["a", 1, True], "[a, 1, true]"), ([{}], "[\n   {},\n]"), (["a", 1, {}], "[\n   a,\n   1,\n   {},\n]"), ("no", "'no'"), ("it's", "'it''s'"), ("a\tb", '"a\\tb"'), (1.5, "1.5"),
    ({"@type": "ns:type", "@token": ":=", "@role": ["Alias", "Expression", "Anonymous"], "@pos": {"@type": "uast:Positions", "start": U.position(5, 1, 1), "end": U.position(6, 1, 2)}, "key": "val", "raw": ":="},
     "{ '@type': \"ns:type\",\n   '@token': \":=\",\n   '@role': [Alias, Anonymous, Expression],\n   '@pos': { '@type': \"uast:Positions\",\n      start: { '@type': \"uast:Position\",\n         offset: 5,\n         line: 1,\n         col: 1,\n      },\n"
     "      end: { '@type': \"uast:Position\",\n         offset: 6,\n         line: 1,\n         col: 2,\n      },\n   },\n   key: \"val\",\n   raw: \":=\",\n}"),
]


@pytest.mark.parametrize("tree, text", YAML)
def test_yaml(tree, text):
    assert Y.encode(tree) == text
    back = Y.decode(text)
    if isinstance(tree, dict) and "@role" in tree:
        tree = tree | {"@role": sorted(tree["@role"])}
    assert T.equal(back, tree)


def test_yaml_roles():
    assert "Unannotated" in Y.encode({"@type": "go:x"}) and "Unannotated" not in Y.encode({"@type": "go:x"}, force_roles=False)
    with pytest.raises(ValueError):
        Y.decode("1: a")


def test_legacy():
    tree = {
        "@type": "ns:F", "@token": "t", "@role": ["Function"], "name": "f", "n": 1, "nil": None, "body": [{"@type": "b", "@pos": {"start": U.position(9, 1, 10)}}, {"@type": "c", "in": {"@type": "d", "@pos": {"start": U.position(4, 1, 5)}}}],
        "@pos": {"@type": "uast:Positions", "start": U.position(1, 1, 2), "end": U.position(20, 2, 1), "mid": U.position(6, 1, 7)}, "arg": ["x"],
    }
    n = S.legacy(tree)
    assert (n["InternalType"], n["Token"], n["Roles"], n["Properties"]) == ("F", "t", [R.number("Function")], {"name": "f", "n": "1"})
    assert n["StartPosition"]["offset"] == 1 and n["EndPosition"]["line"] == 2
    assert [c["InternalType"] or c["Token"] for c in n["Children"]] == ["c", "Position", "b", "x"]
    assert n["Children"][1]["EndPosition"] == {"offset": 7, "line": 1, "col": 8}
    assert S.legacy(None) is None and len(S.legacy(["a", "b"])["Children"]) == 2 and S.legacy(["a"])["Token"] == "a"
    shown = json.loads(S.viewer("go", "code", tree))
    assert shown["uast"]["Roles"] == ["Function"] and shown["uast"]["StartPosition"] == {"Offset": 1, "Line": 1, "Col": 2}


def test_dot(spark):
    docs = spark.createDataFrame([(1, '{"@type": "A", "k": [1, null, "q\\"q"], "@pos": {}, "z": null}'), (2, "[]"), (3, "{")], "doc_id bigint, doc string")
    texts = {r.doc_id: r.dot for r in S.to_dot(docs, positions=False, nils=False, colors={"A": "red"}).collect()}
    lines = texts[1].split("\n")
    assert lines[0] == "digraph tree {" and lines[-2:] == ["}", ""]
    assert lines[1:-2] == [
        '  n0 [shape=ellipse, label="A", style=filled, fillcolor="red"];', '  n0 -> n3 [label="k"];', '  n3 [shape=diamond, label=""];', '  n3 -> n4 [label="#0"];', '  n4 [shape=box, label="1"];',
        '  n3 -> n6 [label="#2"];', '  n6 [shape=box, label="q\\"q"];',
    ]
    assert set(texts) == {1, 2}
    assert S.to_dot(docs).where("doc_id = 1").first().dot.count("->") == 6


def test_html():
    t = S.html_tree('<p class="x">a<br>b<b>c</p><img src=y>')
    p, img = t["children"]
    assert p["@type"] == "html:p" and p["class"] == "x" and [c["@type"] for c in p["children"]] == ["html:Text", "html:br", "html:Text", "html:b"] and img["src"] == "y"
    items = S.html_tree("<ul>" + "<li>x<ul><li>y</ul>" * 3000)["children"][0]["children"]
    assert len(items) == 3000 and all([c["@type"] for c in i["children"]] == ["html:Text", "html:ul"] for i in items)
    table = S.html_tree("<table><tr><td>1<td>2<tr><th>3<p>a<p>b</table>z")["children"]
    assert [r["@type"] for r in table[0]["children"]] == ["html:tr", "html:tr"] and [len(r["children"]) for r in table[0]["children"]] == [2, 1] and table[1]["@token"] == "z"


BAD = ["[" * 100_000 + "]" * 100_000, '["\\ud800", {"\\udfff": 1}]', f"[{-(2**70)}, {2**64}, {10**30}]", "{", '{"a": 1, "a": 2}', "[NaN]", '{"@type": "A", "@pos": {"start": {"offset": "x"}}}', "[" * 50 + "1", '{"@role": [99999]}', "9" * 6000]


def test_no_document_ends_a_job(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*BAD, None, '{"fine": 1}'])], "doc_id bigint, doc string")
    nodes = N.shred(docs)
    read, refused = {r.doc_id for r in nodes.select("doc_id").distinct().collect()}, {r.doc_id for r in N.rejects(docs).collect()}
    assert read | refused == set(range(len(BAD) + 2)) and not read & refused
    assert {0, 1, 2, len(BAD) + 1} <= read and {3, 4, 5, 6, 7, len(BAD)} <= refused
    assert nodes.where("doc_id = 0").count() == 100_000
    assert [r.s for r in nodes.where("doc_id = 1 and kind = 8").collect()] == ["\ufffd"]
    for out in (S.to_yaml(docs), S.to_legacy(docs), S.to_viewer(docs.withColumns({"code": F.lit(""), "lang": F.lit("")})), G.encode(docs), N.import_paths(docs), D.rewrite(docs, W.AnnotateType("A", None, "Body"))):
        assert out.count() == len(BAD) + 2
    assert G.raw_nodes(G.encode(docs).withColumn("graph", F.lit(b"x"))).where("error is not null").count() == len(BAD) + 2
    assert S.dump_json(N.parse_json(BAD[0])) == BAD[0]
    pages = spark.createDataFrame([(1, "<div>" * 3000), (2, "<li>" * 3000), (3, None), (4, "<![x")], "page_id bigint, html string")
    assert N.shred(S.from_html(pages)).where("type = 'html:div'").count() == 3000


def test_what_is_json(spark):
    good = ["{}", "[]", '{"a": [1, {"b": null}]}', '"s"', " 5 ", "-1.5e3", "true", "null", '{"a":1}\t', '["]"]']
    bad = ['{"c":1} x', '{"a": [1,2', "[1]]", "[1],[2]", "1,2", "01", "nul", "{'a': 1}", "", '"a" "b"', "[1,]", "+1", "NaN"]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    assert [r[0] for r in df.select(S.is_json(F.col("t"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_long_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text(json.dumps({"a": "x" * (5 << 20)}) + "\n[2]\n")
    got = S.read_json_lines(spark, str(tmp_path)).selectExpr("length(doc) as n", "error").collect()
    assert sorted((r.n, r.error) for r in got) == [(3, None), ((5 << 20) + 9, None)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"a": 1}\nnot json\n\n[1]\n')
    got = sorted((r.doc or "", r.error or "") for r in S.read_json_lines(spark, str(tmp_path)).collect())
    assert got == [("", "invalid JSON"), ("[1]", ""), ('{"a": 1}', "")]
    S.write_json_lines(spark.createDataFrame([('{"b":2}',), (None,)], "doc string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"b":2}']


def test_responses(spark):
    lines = ['{"status": "OK", "ast": {"a": 1}}', '{"status": "error", "errors": ["x", "y"], "ast": {"a": 1}}', '{"status": "fatal", "errors": ["z"], "ast": {"a": 1}}', '{"status": "new"}', None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").select("i", S.outcome(S.response(F.col("s"))).alias("o"))
    got = {r.i: tuple(r.o) for r in df.collect()}
    assert got == {0: ('{"a":1}', "ok", None), 1: ('{"a":1}', "syntax", "x\ny\n"), 2: (None, "fatal", "z"), 3: (None, "unknown", "unexpected status new"), 4: (None, "fatal", "malformed answer")}


def test_encodings(spark):
    df = spark.createDataFrame([("é\n",)], "c string")
    for name in ("utf8", "UTF-8", "base64", "Base64"):
        assert df.select(S.decode_content(S.encode_content(F.col("c"), name), name)).first()[0] == "é\n"
    with pytest.raises(ValueError):
        S.encode_content(F.col("c"), "latin1")
    with pytest.raises(ValueError):
        S.decode_content(F.col("c"), "latin1")


def test_fixtures(spark, tmp_path):
    for name in ("a.go", "_bad.go", "b.txt"):
        (tmp_path / name).write_text(name)
    assert [r.content for r in S.fixtures(spark, str(tmp_path), ".go").collect()] == ["a.go"]


def test_manifest(spark):
    text = 'name = "Go"\nlanguage = "go"\nstatus = "beta"\nfeatures = ["ast"]\n[documentation]\ndescription = "d"\n'
    m = M.decode(text)
    assert m["documentation"] == {"description": "d"} and m["aliases"] == [] and M.decode(M.encode(m)) == m
    df = spark.createDataFrame([("go", "pre-alpha", ["ast"])], "language string, status string, features array<string>")
    sent = M.to_message(df).first()
    assert (sent.status, sent.features) == ("PRE_ALPHA", ["AST"]) and M.from_message(M.to_message(df)).first() == df.first()
    assert [r.language for r in M.order(spark.createDataFrame([("b", "beta", ["ast"]), ("a", "beta", ["ast"]), ("c", "mature", [])], df.schema)).collect()] == ["c", "a", "b"]
    mod = spark.createDataFrame([("require (\n x.org/kit v1.2.3\n x.org/kit/v3 v3.1.0\n y v9\n)",)], "t string")
    assert mod.select(M.sdk_version(F.col("t"), "x.org/kit")).first()[0] == "3.1.0"
    assert mod.select(M.major(F.lit("3.1")), M.major(F.lit("")), M.for_current(F.lit("3.0"))).first() == (3, 0, True)


def test_graph_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"a": [1]}'), (2, None), (3, "[]")], "doc_id bigint, doc string")
    made = G.write_files(docs, f"file://{tmp_path}/g").collect()
    assert {(r.doc_id, r.bytes) for r in made} == {(1, len(G.write_tree({"a": [1]}))), (3, len(G.write_tree([])))}
    (tmp_path / "g/bad.graph").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.doc, r.error) for r in G.read_files(spark, str(tmp_path / "g"), "*.graph").collect()}
    assert got["1.graph"] == ('{"a": [1]}', None) and got["3.graph"] == ("[]", None) and got["bad.graph"][0] is None


def test_data_source(spark, tmp_path):
    from treeloom.sources.datasource import register

    register(spark)
    docs = spark.createDataFrame([(1, '{"a": [1]}'), (2, None), (3, "[]")], "doc_id bigint, doc string")
    docs.write.format("treegraph").mode("append").save(f"file://{tmp_path}/s")
    (tmp_path / "s/bad.graph").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.doc, r.error) for r in spark.read.format("treegraph").load(f"file://{tmp_path}/s").collect()}
    assert got["1.graph"] == ('{"a": [1]}', None) and got["3.graph"] == ("[]", None) and got["bad.graph"][0] is None and len(got) == 3
