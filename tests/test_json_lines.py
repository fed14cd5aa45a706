from treeloom.sources import codecs as S


def test_long_lines_are_read(spark, tmp_path):
    line = '{"a":"' + "x" * (5 << 20) + '"}'
    (tmp_path / "a.txt").write_text(line + "\n[1]\n" + line[:-1] + "\n")
    got = sorted((len(r.doc or ""), r.error) for r in S.read_json_lines(spark, str(tmp_path)).collect())
    assert got == [(0, "invalid JSON"), (3, None), (len(line), None)]
