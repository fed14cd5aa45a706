import json
import sys
import textwrap

import pytest

from treeloom.operators import positions as P
from treeloom.operators import rewrite as W
from treeloom.plans import pipeline as D
from treeloom.streaming import parse as Q

V = W.Var


def pipeline():
    return D.Transforms(
        namespace="ns", preprocess=[W.Mappings(W.ObjectToNode(type_key="t", offset_key="o"))], code=[P.FromOffset()],
        normalize=[W.Mappings(W.MapSemantic("Id", "uast:Identifier", W.MapObj(W.Obj({"n": V("n")}), W.Obj({"Name": V("n")}))))], annotate=[W.Mappings(W.AnnotateType("Other", None, "Name"))],
    )


def test_modes():
    p, tree = pipeline(), [{"t": "Id", "o": 1, "n": "x"}, {"t": "Other", "o": 0}]
    assert p.do(D.NATIVE, "ab", tree) == tree
    pre = p.do(D.PREPROCESSED, "ab", tree)
    assert pre[0]["@type"] == "Id" and pre[0]["@pos"]["start"]["col"] == 2
    annotated = p.do(D.ANNOTATED, "ab", tree)
    assert annotated[0]["@type"] == "Id" and annotated[1]["@role"] == ["Name"]
    for mode in (D.SEMANTIC, 0):
        semantic = p.do(mode, "ab", tree)
        assert semantic[0]["@type"] == "uast:Identifier" and semantic[1]["@type"] == "ns:Other"
    with pytest.raises(ValueError):
        p.do(16, "", tree)
    with pytest.raises(ValueError):
        p.do(D.SEMANTIC, "", [{"t": "Id", "o": 9, "n": "x"}])
    assert [D.parse_mode(m) for m in ("native", "annotated", "semantic")] == [1, 4, 8]
    with pytest.raises(ValueError):
        D.parse_mode("preprocessed")
    assert D.join_errors(["a", "b"]) == "a\nb\n" and D.join_errors(["a"]) == "a" and D.join_errors([]) == ""
    one = ValueError("a")
    assert D.join([one]) is one and str(D.join([one, one])) == "a\na\n" and str(D.join([])) == ""


def test_over_documents(spark):
    docs = spark.createDataFrame([(1, '{"t": "Other", "o": 0}', "x"), (2, '{"t": "Other", "o": 99}', "x"), (3, None, "x")], "doc_id bigint, doc string, code string")
    out = {r.doc_id: r for r in D.transform(docs, pipeline(), code="code").collect()}
    assert json.loads(out[1].doc)["@type"] == "ns:Other" and out[1].errors == []
    assert "out of bounds" in out[2].errors[0] and out[3].doc is None
    with pytest.raises(ValueError):
        D.transform(docs, pipeline(), 99)


def lines_driver():
    def parser(code):
        if "fatal" in code:
            return {"status": "fatal", "errors": ["f"], "ast": {"x": 1}}
        if "boom" in code:
            raise RuntimeError("boom")
        status = "error" if "bad" in code else "OK"
        return {"status": status, "errors": ["e"] if status == "error" else [], "ast": {"@type": "File", "lines": code.split("\n")}}

    return D.Driver(parser, {"language": "lines", "aliases": ["text"]}, D.Transforms(namespace="ln"))


REQUESTS = [
    ('{"content": "a\\nb"}', "ok", True), ('{"content": "YmFk", "encoding": "base64"}', "syntax", True), ('{"content": "fatal"}', "fatal", False), ('{"content": "boom"}', "fatal", False), ("not json", "fatal", False),
    ('{"content": "a", "language": "text"}', "ok", True), ('{"content": "a", "language": "other"}', "fatal", False), ('{"content": 5}', "fatal", False), ("{}", "fatal", False),
]


def test_driver():
    d = lines_driver()
    for line, status, tree in REQUESTS:
        own = Q.answer(d, line)
        assert own["status"] == status and (own["ast"] is not None) == tree
    assert [json.loads(x)["status"] for x in Q.serve(d, iter(r[0] for r in REQUESTS))] == [r[1] for r in REQUESTS]
    with pytest.raises(ValueError):
        D.Driver(None, {}, D.Transforms())


def test_batch_and_stream(spark, tmp_path):
    batch = spark.createDataFrame([(r[0],) for r in REQUESTS], "value string")
    got = {r.request: (r.status, r.doc is not None) for r in Q.parse(batch, lines_driver).collect()}
    assert got == {line: (status, tree) for line, status, tree in REQUESTS}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(r[0] for r in REQUESTS))
    stream = Q.parse(spark.readStream.text(str(tmp_path / "in")), lines_driver)
    run = stream.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert {r.request: (r.status, r.doc is not None) for r in spark.table("answers").collect()} == got


PROCESS = textwrap.dedent("""
    import json, sys, time
    for line in sys.stdin:
        code = json.loads(line)["content"]
        if code == "die":
            sys.exit(1)
        if code == "sleep":
            time.sleep(20)
        print("garbage" if code == "garbage" else json.dumps({"status": "ok", "errors": [], "ast": {"code": code}}), flush=True)
""")


def test_native_process():
    p = Q.NativeProcess([sys.executable, "-c", PROCESS], timeout=10)
    assert p("a")["ast"] == {"code": "a"}
    with pytest.raises(RuntimeError, match="died"):
        p("die")
    assert p("b")["ast"] == {"code": "b"}
    with pytest.raises(RuntimeError, match="malformed"):
        p("garbage")
    p.timeout = 0.5
    with pytest.raises(TimeoutError):
        p("sleep")
    p.timeout = 10
    for i in range(50):
        assert p(str(i))["ast"] == {"code": str(i)}
    p.close()
    assert p.process is None
    p.close()


def test_status_records():
    from treeloom.streaming import protocol as S

    for error in (None, S.SyntaxErrors("a"), S.BadEncoding("b"), S.LanguageNotDetected("c"), S.BadMode("d"), S.TransformFailure("e"), S.DriverFailure("f"), S.MissingDriver("g")):
        tree, back = S.from_status(S.to_status({"x": 1}, error))
        assert type(back) is type(error) and str(back) == str(error)
        assert (tree is not None) == (error is None or isinstance(error, S.SyntaxErrors))
    assert S.to_status(None, ValueError("x")).code == S.UNKNOWN and type(S.from_status(S.Status(S.INTERNAL, "", None, ["x"]))[1]) is S.DriverFailure
    assert S.is_missing_driver(S.MissingDriver()) and not S.is_missing_driver(None) and S.message_limit() == 100 << 20
    with pytest.raises(ValueError):
        S.message_limit(2048)
