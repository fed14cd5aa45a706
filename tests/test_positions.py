import pytest
from pyspark.sql import functions as F

from treeloom.functions import uast as U
from treeloom.operators import positions as P
from treeloom.operators import rewrite as W

MIXED = "line1\nёёё2\na𝓏b\né4"


def test_line_col():
    i = P.Index("hello\n\nworld")
    for offset, at in ((0, (1, 1)), (4, (1, 5)), (5, (1, 6)), (6, (2, 1)), (7, (3, 1)), (12, (3, 6))):
        assert i.line_col(offset) == at and i.offset(*at) == offset
    for bad in (-1, 13):
        with pytest.raises(ValueError):
            i.line_col(bad)
    for bad in ((0, 1), (4, 1), (1, 0), (1, 9)):
        with pytest.raises(ValueError):
            i.offset(*bad)
    empty = P.Index("")
    assert empty.line_col(0) == (1, 1) and empty.offset(1, 1) == 0 and empty.from_rune_offset(0) == 0


def test_units():
    i, data = P.Index(MIXED), MIXED.encode()
    for n in range(len(MIXED) + 1):
        at = len(MIXED[:n].encode())
        units = len(MIXED[:n].encode("utf-16-le")) // 2
        assert i.from_rune_offset(n) == at == i.from_utf16_offset(units)
        assert i.to_rune_offset(at) == n and i.to_utf16_offset(at) == units
        line = MIXED[:n].count("\n") + 1
        start = MIXED.rfind("\n", 0, n) + 1
        assert i.to_unicode_line_col(at) == (line, n - start + 1)
        assert i.to_utf16_line_col(at) == (line, len(MIXED[start:n].encode("utf-16-le")) // 2 + 1)
    with pytest.raises(ValueError):
        i.from_rune_offset(len(MIXED) + 1)
    with pytest.raises(ValueError):
        i.from_utf16_offset(len("line1\nёёё2\na") + 1)  # inside a pair
    assert len(data) == i.from_rune_offset(len(MIXED))


@pytest.mark.parametrize("code", ["hello\n\nworld", "", MIXED, "\n", "a", "é\n"])
def test_columns_agree_with_the_index(spark, code):
    i, n = P.Index(code), len(code.encode())
    bounds = [len(code[:k].encode()) for k in range(len(code) + 1)]
    df = spark.createDataFrame([(code, b, k) for k, b in enumerate(bounds)], "code string, at bigint, n bigint")
    c, at, size = F.col("code"), F.col("at"), F.octet_length("code")
    starts = P.line_starts(c)
    lc = P.line_col(starts, at, size)
    out = df.select("at", "n", lc.alias("lc"), P.offset_of(starts, lc["line"], lc["col"], size).alias("back"), P.rune_to_byte(c, F.col("n")).alias("b"), P.byte_to_rune(c, at).alias("r"), P.byte_to_utf16(c, at).alias("u"), P.utf16_to_byte(c, P.byte_to_utf16(c, at)).alias("ub"), P.line_col_at(c, at).alias("lc2"))
    for r in out.collect():
        assert tuple(r.lc) == tuple(r.lc2) == i.line_col(r["at"]) and r.back == r["at"] == r.b == r.ub
        assert (r.r, r.u) == (r.n, i.to_utf16_offset(r["at"]))
    outside = df.limit(1).select(P.line_col(starts, F.lit(n + 1), size).alias("a"), P.line_col(starts, F.lit(-1), size).alias("b"), P.rune_to_byte(c, F.lit(len(code) + 1)).alias("c"), P.offset_of(starts, F.lit(99), F.lit(1), size).alias("d")).first()
    assert tuple(outside) == (None,) * 4


def test_lines_and_asof(spark):
    trees = spark.createDataFrame([(1, "a\nbé\n"), (2, "")], "doc_id bigint, code string")
    table = P.lines(trees)
    assert sorted(map(tuple, table.collect())) == [(1, 1, 0, "a"), (1, 2, 2, "bé"), (1, 3, 6, ""), (2, 1, 0, "")]
    asked = spark.createDataFrame([(1, 3), (1, 6), (2, 0)], "doc_id bigint, offset bigint")
    assert sorted(map(tuple, P.locate(asked, table).collect())) == [(1, 3, 2, 2), (1, 6, 3, 1), (2, 0, 1, 1)]


def ident(start, end, **more):
    return {"@type": "I", "@token": "", "@pos": {"@type": "uast:Positions", "start": start, "end": end}} | more


def test_stages():
    code = " var a, b int"
    tree = [ident(U.position(5), U.position(6)), ident(U.position(8), U.position(9), **{"@type": "J"}), {"@type": "K", "@pos": {"start": U.position(10), "end": U.position(13)}}]
    done = P.TokenFromSource().on_code(code).do(tree)
    assert [n.get("@token") for n in done] == ["a", "b", None]
    assert [n.get("@token") for n in P.TokenFromSource(types=("J",)).on_code(code).do(tree)] == ["", "b", None]
    assert P.TokenFromSource(key="Name").on_code(code).do([ident(U.position(10), U.position(13), Name="")])[0]["Name"] == "int"
    P.VerifyToken().verify(code, done)
    with pytest.raises(W.RuleError):
        P.VerifyToken().verify(code, tree)
    P.VerifyToken(types=("K",)).verify(code, tree)
    for source, given in (("offset", U.position(offset=8)), ("linecol", U.position(0, 3, 2)), ("unicode", U.position(offset=8)), ("utf16", U.position(offset=8))):
        out = P.Positioner(source).on_code("hello\n\nwörld").do(given)
        assert (out["offset"], out["line"], out["col"]) == (8, 3, 2)
    with pytest.raises(ValueError):
        P.FromOffset().on_code("ab").do(U.position(offset=5))
    with pytest.raises(ValueError):
        P.Positioner("other")
    assert P.FromUnicodeOffset().on_code("éa\nb").do(U.position(offset=3))["offset"] == 4 and P.FromUTF16Offset().on_code("𝓏a").do(U.position(offset=2))["offset"] == 4 and P.FromLineCol().on_code("a").do(U.position()) == U.position()


def test_many_lines(spark):
    code = "\n".join("x" * (i % 7) for i in range(1000))
    got = spark.createDataFrame([(code,)], "code string").select(P.line_starts(F.col("code"))).first()[0]
    assert got == P.Index(code).lines
