"""Queries of positions, fields and typed values, codecs, manifests and the parse service, with DuckDB SQL."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import roles as R
from .functions import text as X
from .functions import tree as T
from .functions import uast as U
from .operators import nodes as N
from .operators import positions as P
from .operators import rewrite as W
from .plans import builders as B
from .plans import columns as K
from .plans import pipeline as D
from .plans import xpath
from .queries import _LINES
from .registry import query
from .sources import codecs as S
from .sources import graph as G
from .sources import manifest as M
from .sources.relational import Trees, documents, structs
from .streaming import parse as Q
from .streaming import protocol as O

_LONG = "bigint"


def json_field(p: str, column: str = "doc") -> Column:
    return F.get_json_object(column, p)


def talks(spark, sf) -> DataFrame:
    return documents(B.conversation_level(spark, sf))


def events(spark, sf) -> DataFrame:
    return N.shred(B.event_documents(spark, sf))


# ---- positions in source text --------------------------------------------

_POINTS = _LINES + """, m AS (SELECT DISTINCT doc_id, strlen(coalesce(text, '')) * q // 4 AS o, coalesce(text, '') AS t FROM documents, range(5) AS r(q)),
found AS (SELECT doc_id, o, max(byte_start) AS s, max(line) AS line FROM m JOIN lines USING (doc_id) WHERE byte_start <= o GROUP BY 1, 2) """


def _points(spark, sf) -> DataFrame:
    """(doc_id, code, offset): the bytes at the quarters of every text, both ends included."""
    size = F.octet_length("code")
    quarters = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(size * i / 4).cast(_LONG)))
    return B.source_documents(spark, sf).select("doc_id", "code", F.explode(quarters).alias("offset"))


@query(_POINTS + "SELECT doc_id, o AS \"offset\", line, o - s + 1 AS col FROM found")
def offset_to_linecol(spark, sf):
    own = _points(spark, sf).select("doc_id", "offset", P.line_col_at(F.col("code"), F.col("offset")).alias("lc"))
    return own.select("doc_id", "offset", "lc.line", "lc.col")


@query(_POINTS + "SELECT doc_id, o AS \"offset\", line, o - s + 1 AS col FROM found")
def offset_to_linecol_asof(spark, sf):
    """The same as an as-of join with the table of lines."""
    return P.locate(_points(spark, sf).select("doc_id", "offset"), P.lines(B.source_documents(spark, sf)))


@query(_POINTS + "SELECT doc_id, line, o - s + 1 AS col, o AS \"offset\" FROM found")
def linecol_to_offset(spark, sf):
    """Lines and columns, from the table of lines, back to offsets."""
    at = offset_to_linecol_asof(spark, sf).select("doc_id", "line", "col")
    sized = B.source_documents(spark, sf).select("doc_id", P.line_starts(F.col("code")).alias("starts"), F.octet_length("code").cast(_LONG).alias("size"))
    return at.join(sized, "doc_id").select("doc_id", "line", "col", P.offset_of(F.col("starts"), F.col("line"), F.col("col"), F.col("size")).alias("offset"))


_RUNES = "SELECT DISTINCT doc_id, length(coalesce(text, '')) * q // 4 AS runes, strlen(substr(coalesce(text, ''), 1, length(coalesce(text, '')) * q // 4)) AS \"offset\" FROM documents, range(5) AS r(q)"


def _rune_points(spark, sf) -> DataFrame:
    quarters = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(F.length("code") * i / 4).cast(_LONG)))
    return B.source_documents(spark, sf).select("doc_id", "code", F.explode(quarters).alias("runes"))


@query(_RUNES)
def rune_to_byte_offset(spark, sf):
    return _rune_points(spark, sf).select("doc_id", "runes", P.rune_to_byte(F.col("code"), F.col("runes")).alias("offset"))


@query(_RUNES)
def byte_to_rune_offset(spark, sf):
    own = _rune_points(spark, sf).select("doc_id", "code", P.rune_to_byte(F.col("code"), F.col("runes")).alias("offset"))
    return own.select("doc_id", P.byte_to_rune(F.col("code"), F.col("offset")).alias("runes"), "offset")


_PLANE = r"[\x{10000}-\x{10FFFF}]"


@query(_LINES + rf""", m AS (SELECT DISTINCT doc_id, substr(coalesce(text, ''), 1, length(coalesce(text, '')) * q // 4) AS head FROM documents, range(5) AS r(q)),
t AS (SELECT doc_id, strlen(head) AS o, string_split(head, chr(10)) AS ls FROM m)
SELECT doc_id, o AS "offset", len(ls) AS line, length(ls[-1]) + 1 AS col, length(ls[-1]) + len(regexp_extract_all(ls[-1], '{_PLANE}')) + 1 AS utf16_col FROM t""")
def unicode_linecol(spark, sf):
    """Lines and columns in characters and in UTF-16 units."""
    own = _rune_points(spark, sf).select("doc_id", "code", P.rune_to_byte(F.col("code"), F.col("runes")).alias("offset"))
    at = own.select("doc_id", "offset", P.unicode_line_col(F.col("code"), F.col("offset")).alias("u"), P.utf16_line_col(F.col("code"), F.col("offset")).alias("v"))
    return at.select("doc_id", "offset", "u.line", "u.col", F.col("v.col").alias("utf16_col"))


def _line_tokens(spark, sf, token: Column) -> tuple[DataFrame, DataFrame]:
    """A node for every line of every text, with its place in the source and a token."""
    trees = B.source_documents(spark, sf)
    zero = F.lit(0).cast(_LONG)
    at = lambda o: F.struct(o.cast(_LONG).alias("offset"), zero.alias("line"), zero.alias("col"))
    span = F.create_map(F.lit("start"), at(F.col("byte_start")), F.lit("end"), at(F.col("byte_start") + F.octet_length("text")))
    have = {"doc_id": F.col("doc_id"), "pre": F.col("line"), "kind": F.lit(T.OBJECT), "type": F.lit("Line"), "token": token, "attrs": F.create_map(F.lit("token"), F.array(token)), "pos": span}
    return P.lines(trees).select(*((have.get(c, F.lit(None))).cast(k).alias(c) for c, k in N.COLUMNS.items())), trees


@query(_LINES + "SELECT doc_id, line, md5(text) AS token FROM lines")
def token_from_source(spark, sf):
    """Every line of every text, cut out of its source by a node's position."""
    return P.token_from_source(*_line_tokens(spark, sf, F.lit(""))).select("doc_id", F.col("pre").alias("line"), F.md5("token").alias("token"))


@query(_LINES + "SELECT doc_id, line, md5(text) AS source FROM lines WHERE text <> lower(text)")
def verify_token(spark, sf):
    """Lines that differ from a token in lower case."""
    return P.mismatched_tokens(*_line_tokens(spark, sf, F.lower("text"))).select("doc_id", F.col("pre").alias("line"), F.md5("source").alias("source"))


@query("SELECT event_id AS doc_id, user_id AS col FROM events")
def xpath_positions(spark, sf):
    """Positions as attributes."""
    at = F.struct(F.col("event_id").alias("offset"), F.lit(2).alias("line"), F.col("user_id").alias("col"))
    doc = F.to_json(F.struct(F.lit("E").alias("@type"), F.struct(at.alias("start")).alias("@pos")))
    own = N.shred(B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), doc.alias("doc")))
    return xpath.execute(own, "//*[@start-line = 2]/@start-col").select("doc_id", F.col("value").cast(_LONG).alias("col"))


_BAD = ["//a[", "foo(1)", "count(1)", "//a[@]", "translate('a')", "wrong::a"]


@query("SELECT * FROM (VALUES ('//a['), ('foo(1)'), ('count(1)'), ('//a[@]'), ('translate(''a'')'), ('wrong::a')) AS v(query)")
def xpath_errors(spark, sf):
    """Queries that are refused before there is a plan."""

    def refused(q: str) -> bool:
        try:
            xpath.prepare(q)
        except xpath.XPathError:
            return True
        return False

    return spark.createDataFrame([(q,) for q in _BAD if refused(q)], "query string")


# ---- values, fields, types -----------------------------------------------


@query("SELECT a.event_id AS doc_id, json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k') AND a.event_type = b.event_type AS same FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def tree_equal(spark, sf):
    """Each event's tree against the next one's, ids aside."""
    own = B.event_structs(spark, sf).select("doc_id", F.struct(F.col("doc.`@type`"), F.col("doc.props")).alias("a"))
    nxt = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    both = own.join(nxt, "doc_id")
    kind = own.schema["a"].dataType
    return both.select("doc_id", K.as_column(K.same(K.of_type(F.col("a"), kind), K.of_type(F.col("b"), kind))).alias("same"))


@query("SELECT count(DISTINCT json_extract_string(props, '$.k')) AS n FROM events")
def unique_values(spark, sf):
    """Scalars that are the same node by kind and value."""
    own = events(spark, sf).where("field = 'k'")
    return own.select(N.unique_key().alias("u")).distinct().agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id AS doc_id, '{"@type":"' || event_type || '","event_id":' || event_id || ',"props":{"k":' || json_extract_string(props, '$.k') || '},"user_id":' || user_id || '}' AS doc FROM events""")
def tree_copy(spark, sf):
    """Trees copied by the interpreter, as canonical text."""
    return D.rewrite(B.event_documents(spark, sf), W.TransformObjFunc(lambda n: (T.clone(n), True))).select("doc_id", "doc")


@query("SELECT event_id AS doc_id, '@type,event_id,props,user_id' AS keys, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def tree_fields(spark, sf):
    """Names of fields, and a value two fields down."""
    own = events(spark, sf)
    roots = own.where("pre = 0")
    names = N.keys(own).where("pre = 0").select("doc_id", F.array_join("keys", ",").alias("keys"))
    found = N.value_at(own, N.value_at(own, roots, "props"), "k").select("doc_id", F.col("i").alias("k"))
    return names.join(found, "doc_id")


@query("SELECT event_id AS doc_id, event_type AS type, CASE WHEN event_type = 'click' THEN user_id::VARCHAR END AS user_id, event_type <> 'click' AS wrong FROM events")
def field_kinds(spark, sf):
    """A field that must be a number and is a text in most documents."""
    user = F.when(F.col("doc.`@type`") == "click", F.to_json(F.struct(F.col("doc.user_id").alias("u")))).otherwise(F.to_json(F.struct(F.col("doc.user_id").cast("string").alias("u"))))
    own = B.event_structs(spark, sf)
    nodes = N.shred(own.select("doc_id", user.alias("doc")))
    kinds = own.select("doc_id", F.col("doc.`@type`").alias("type"))
    return N.field_of(nodes, "u", T.INT | T.UINT).join(kinds, "doc_id").select("doc_id", "type", F.col("text").alias("user_id"), "wrong")


@query("SELECT * FROM (VALUES (0, '\"AFRICA\"'), (1, '[1,null]'), (2, '{\"a\":true}')) AS v(rank, doc)")
def fixed_list(spark, sf):
    return N.fixed_list(spark, ["AFRICA", [1.0, None], {"a": True}]).select(F.col("rank").cast("int").alias("rank"), "doc")


@query("SELECT * FROM (VALUES ('Bool', 'Value'), ('Comment', 'Text'), ('Identifier', 'Name'), ('String', 'Value')) AS v(type, content)")
def type_registry(spark, sf):
    """Registered types that hold text, and where."""
    return spark.createDataFrame([(U.split_type(t)[1], f) for t, f in U.CONTENT.items()], "type string, content string")


@query("SELECT conv_id AS doc_id, turn, '{\"@type\":\"uast:String\",\"Format\":\"\",\"Value\":\"' || role || '\"}' AS doc FROM conversations")
def typed_values(spark, sf):
    """Rows as objects of a registered type, with the fields that were not given."""
    rows = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.struct(F.col("role").alias("Value")).alias("v"))
    return rows.select("doc_id", "turn", K.typed(K.of_type(F.col("v"), rows.schema["v"].dataType), "uast:String").json().alias("doc"))


@query("SELECT conv_id AS doc_id, turn, role = 'user' AS good, role AS name, '' AS format FROM conversations")
def typed_fields(spark, sf):
    """Objects of two types read as one: fields that are missing have defaults."""
    typ = F.when(F.col("role") == "user", "uast:String").otherwise("uast:Identifier")
    rows = B.table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.struct(typ.alias("@type"), F.col("role").alias("Value")).alias("v"))
    fields, good = K.node_as(K.of_type(F.col("v"), rows.schema["v"].dataType), "uast:String")
    own = rows.select("doc_id", "turn", K.as_column(good).alias("good"), fields.column().alias("f"))
    return own.select("doc_id", "turn", "good", F.col("f.Value").alias("name"), F.col("f.Format").alias("format"))


@query("SELECT event_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'u' || user_id END AS content FROM events")
def content_nested(spark, sf):
    """The content of a node in a content field, two levels down, which some lack."""
    name = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
    inner = F.struct(F.lit("uast:Identifier").alias("@type"), F.struct(F.lit("uast:String").alias("@type"), name.alias("Value")).alias("Name"))
    doc = F.to_json(F.struct(F.lit("uast:String").alias("@type"), inner.alias("Value")))
    own = N.shred(B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), doc.alias("doc")))
    return N.contents(own).where("pre = 0").select("doc_id", "content")


@query("SELECT count(DISTINCT json_extract_string(props, '$.k')) AS props, count(*) AS trees FROM events")
def subtree_hashes(spark, sf):
    """Hashes of inner nodes: equal exactly for equal subtrees, wherever they stand."""
    own = events(spark, sf)
    asked = own.where((F.col("field") == "props") | (F.col("pre") == 0)).select("doc_id", "pre", "field")
    found = N.subtree_hashes(own).withColumn("hash", F.unhex("hash")).join(asked, ["doc_id", "pre"])
    count = lambda c: F.countDistinct(F.when(c, F.col("hash")))
    return found.agg(count(F.col("field") == "props").alias("props"), count(F.col("pre") == 0).alias("trees"))


# ---- codecs --------------------------------------------------------------

_TURNS = "array<struct<turn:bigint,role:string,text:string>>"
_TALKS_SQL = "SELECT conv_id AS doc_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY 1"


def _turns(docs: DataFrame) -> DataFrame:
    own = docs.select("doc_id", F.from_json(json_field("$.turns"), _TURNS).alias("t"))
    shown = F.transform("t", lambda t: F.concat(t["turn"].cast("string"), F.lit(":"), t["role"]))
    return own.select("doc_id", F.array_join(shown, ",").alias("turns"), F.md5(F.array_join(F.transform("t", lambda t: t["text"]), "\n")).alias("text"))


@query(_TALKS_SQL)
def graph_roundtrip(spark, sf):
    """Conversations through graph files."""
    return _turns(G.decode(G.encode(talks(spark, sf))))


@query(_TALKS_SQL)
def yaml_roundtrip(spark, sf):
    """Conversations through YAML."""
    return _turns(S.from_yaml(S.to_yaml(talks(spark, sf), force_roles=False)))


@query("SELECT r_regionkey::BIGINT AS doc_id, r_name AS name, true AS written FROM region")
def graph_files(spark, sf):
    """Trees as files, one each, and read back by the data source of files."""
    docs = B.table(spark, sf, "region").select(F.col("r_regionkey").cast(_LONG).alias("doc_id"), F.to_json(F.struct("r_name")).alias("doc"))
    folder = B.scratch(spark, "graphs")
    made = G.write_files(docs, folder).collect()
    read = G.read_files(spark, folder, "*.graph")
    number = F.regexp_extract("path", r"(\d+)\.graph$", 1).cast(_LONG)
    return read.select(number.alias("doc_id"), json_field("$.r_name").alias("name"), number.isin([r.doc_id for r in made]).alias("written"))


@query("SELECT r_regionkey || '.graph' AS name, true AS read FROM region WHERE r_regionkey NOT BETWEEN 1 AND 1")
def fixture_scan(spark, sf):
    """Files of a test corpus, without those named as syntax errors."""
    docs = B.table(spark, sf, "region").select(F.col("r_regionkey").cast(_LONG).alias("doc_id"), F.to_json(F.struct("r_name")).alias("doc"))
    folder = B.scratch(spark, "fixtures")
    G.write_files(docs, folder).collect()
    return S.fixtures(spark, folder, ".graph", syntax_prefix="1").select("name", (F.length("content") > 0).alias("read"))


@query("SELECT json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 10 = 0 THEN 'invalid JSON' END AS error, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END AS props, event_id FROM events) GROUP BY 1, 2")
def json_lines(spark, sf):
    """Lines written and read again, of which every tenth is cut off."""
    e = B.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    folder = B.scratch(spark, "lines")
    S.write_json_lines(e.select(line.alias("doc")), folder)
    return S.read_json_lines(spark, folder).groupBy(json_field("$.k").cast(_LONG).alias("k"), "error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS doc_id, '{' || chr(10) || '   a: \"' || event_type || '\",' || chr(10) || '   b: ' || user_id || ',' || chr(10) || '}' AS yaml FROM events")
def yaml_text(spark, sf):
    """Strings and numbers as YAML writes them."""
    docs = B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.to_json(F.struct(F.col("event_type").alias("a"), F.col("user_id").alias("b"))).alias("doc"))
    return S.to_yaml(docs).select("doc_id", "yaml")


@query("SELECT conv_id AS doc_id, (1 + count(*))::INT AS forced, 0 AS plain FROM conversations GROUP BY 1")
def yaml_roles(spark, sf):
    """The role of objects without one, written if it is forced."""
    count = lambda c: (F.size(F.split(c, "Unannotated")) - 1)
    a, b = (S.to_yaml(talks(spark, sf), force_roles=f).select("doc_id", count(F.col("yaml")).alias(n)) for f, n in ((True, "forced"), (False, "plain")))
    return a.join(b, "doc_id")


@query("""SELECT conv_id AS doc_id, 'Conversation' AS type, conv_id::VARCHAR AS conv_id, count(*)::INT AS n, arg_min(role, turn) AS first, 'Turn turns' AS child, string_agg(turn, ',' ORDER BY turn) AS turns
FROM conversations GROUP BY 1, 3""")
def legacy_nodes(spark, sf):
    """Trees in the flat shape: scalars as properties, lists as children."""
    out = S.to_legacy(talks(spark, sf))
    kids = F.from_json(json_field("$.Children", "legacy"), "array<struct<InternalType:string,Properties:map<string,string>>>")
    own = out.select("doc_id", json_field("$.InternalType", "legacy").alias("type"), json_field("$.Properties.conv_id", "legacy").alias("conv_id"), kids.alias("k"))
    first = F.get("k", F.lit(0))
    child = F.concat(first["InternalType"], F.lit(" "), first["Properties"]["internalRole"])
    return own.select("doc_id", "type", "conv_id", F.size("k").alias("n"), first["Properties"]["role"].alias("first"), child.alias("child"), F.array_join(F.transform("k", lambda x: x["Properties"]["turn"]), ",").alias("turns"))


@query("SELECT conv_id AS doc_id, arg_min(role, turn) AS lang, max(text) AS code, 'Conversation' AS type, 'Unannotated' AS role, count(*)::INT AS n FROM conversations GROUP BY 1")
def viewer_json(spark, sf):
    own = B.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("role", "turn").alias("lang"), F.max("text").alias("code"))
    out = S.to_viewer(talks(spark, sf).join(own, "doc_id"))
    at = lambda p: json_field(p, "json")
    return out.select("doc_id", at("$.lang").alias("lang"), at("$.code").alias("code"), at("$.uast.InternalType").alias("type"), at("$.uast.Roles[0]").alias("role"), F.size(F.from_json(at("$.uast.Children"), "array<string>")).alias("n"))


@query("""SELECT event_id AS doc_id, unnest(['  n0 [shape=ellipse, label="' || event_type || '"];', '  n2 [shape=box, label="' || event_id || '"];', '  n0 -> n2 [label="event_id"];', '  n3 [shape=ellipse, label=""];',
'  n0 -> n3 [label="props"];', '  n4 [shape=box, label="' || json_extract_string(props, '$.k') || '"];', '  n3 -> n4 [label="k"];', '  n5 [shape=box, label="' || user_id || '"];', '  n0 -> n5 [label="user_id"];']) AS line FROM events""")
def dot_graph(spark, sf):
    """Lines of the drawing of every event."""
    return S.dot_lines(events(spark, sf)).select("doc_id", "line")


@query("""SELECT doc_id, md5('"' || replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t') || '"') AS quoted, md5(coalesce(text, '')) AS back FROM documents
WHERE NOT regexp_matches(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F\\x7F]')""".replace("\\\\", "\\"))
def quote(spark, sf):
    """Texts quoted by a reversed rule, and unquoted by the rule."""
    rule = W.Map(W.Obj({"q": W.Var("x")}), W.Obj({"q": W.Quote(W.Var("x"))}))
    docs = B.source_documents(spark, sf).where(~F.col("code").rlike(r"[\x00-\x08\x0B-\x1F\x7F]")).select("doc_id", F.to_json(F.struct(F.col("code").alias("q"))).alias("doc"))
    there = D.rewrite(docs, rule)
    back = D.rewrite(there, W.Reverse(rule)).withColumnRenamed("doc", "back")
    return there.join(back, "doc_id").select("doc_id", F.md5(json_field("$.q")).alias("quoted"), F.md5(json_field("$.q", "back")).alias("back"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def uncomment_markers(spark, sf):
    """Texts between given markers."""
    return B.source_documents(spark, sf).select("doc_id", F.md5(X.uncomment_col(F.concat(F.lit("<!--"), F.col("code"), F.lit("-->")), "<!--", "-->")).alias("text"))


# ---- manifests -----------------------------------------------------------

_STATES = ["inactive", "planning", "pre-alpha", "alpha", "beta", "stable", "mature"]
_MANIFESTS = f"""(SELECT s_name AS language, {_STATES}[s_nationkey % 7 + 1] AS status, s_nationkey % 7 AS r, ['ast', 'uast', 'roles'][1:s_nationkey % 4] AS features, s_nationkey % 4 AS n,
(s_nationkey % 4)::VARCHAR || '.' || s_suppkey || '.0' AS version, s_nationkey % 4 AS major, s_suppkey FROM supplier)"""


def manifests(spark, sf) -> DataFrame:
    s = B.table(spark, sf, "supplier")
    state = F.get(F.array(*map(F.lit, _STATES)), F.col("s_nationkey") % 7)
    version = F.concat((F.col("s_nationkey") % 4).cast("string"), F.lit("."), F.col("s_suppkey").cast("string"), F.lit(".0"))
    features = F.slice(F.array(F.lit("ast"), F.lit("uast"), F.lit("roles")), F.lit(1), F.col("s_nationkey") % 4)
    return s.select(F.col("s_name").alias("language"), state.alias("status"), features.alias("features"), version.alias("version"))


@query(f"SELECT language, row_number() OVER (ORDER BY r DESC, n DESC, language)::INT AS place, r < 3 AS in_development, r >= 4 AND major = 3 AS recommended FROM {_MANIFESTS}")
def manifest_rank(spark, sf):
    """Parsers in their order, by development state, features and name."""
    own = M.order(manifests(spark, sf)).withColumn("_i", F.monotonically_increasing_id())
    place = F.row_number().over(Window.orderBy("_i"))
    return own.select("language", place.alias("place"), M.in_development(F.col("status")).alias("in_development"), M.is_recommended(F.col("status"), F.col("version")).alias("recommended"))


@query(f"SELECT language, n >= 2 AS has_both, n >= 3 AS has_roles FROM {_MANIFESTS}")
def topic_filter(spark, sf):
    return manifests(spark, sf).select("language", M.contains_topics(F.col("features"), ["ast", "uast"]).alias("has_both"), M.supports(F.col("features"), "roles").alias("has_roles"))


@query(f"SELECT language, upper(replace(status, '-', '_')) AS sent, status AS back, upper(array_to_string(features, ',')) AS features FROM {_MANIFESTS}")
def manifest_message(spark, sf):
    """Manifests as protocol records and back."""
    sent = M.to_message(manifests(spark, sf))
    back = M.from_message(sent).select("language", F.col("status").alias("back"))
    return sent.select("language", F.col("status").alias("sent"), F.array_join("features", ",").alias("features")).join(back, "language")


@query(f"SELECT language, status, array_to_string(features, ',') AS features, version FROM {_MANIFESTS}")
def manifest_toml(spark, sf):
    """Manifests through TOML."""
    back = M.from_toml(M.to_toml(manifests(spark, sf)))
    return back.select("language", "status", F.array_join("features", ",").alias("features"), "version")


_PEOPLE = """SELECT n_nationkey AS k, n_name AS name, lower(n_name) || '@x.org' AS email, 'h' || n_nationkey AS handle, 'https://github.com/h' || n_nationkey AS url FROM nation
UNION ALL SELECT n_nationkey, 'Bo', 'bo' || n_nationkey || '@y.org', '', 'mailto:bo' || n_nationkey || '@y.org' FROM nation"""


@query(_PEOPLE)
def maintainers(spark, sf):
    """A file of people per nation: one with a handle, a comment, one without."""
    n, k = F.col("n_name"), F.col("n_nationkey").cast("string")
    text = F.concat(n, F.lit(" <"), F.lower(n), F.lit("@x.org> (@h"), k, F.lit(")\n# nobody\n Bo <bo"), k, F.lit("@y.org>\n"))
    own = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), text.alias("text"))
    return M.maintainers(own).select("*", M.contact_url(F.col("handle"), F.col("email")).alias("url"))


@query("""WITH t AS (SELECT s_nationkey AS repo, s_suppkey % 3 AS a, s_suppkey AS b, x FROM supplier, (VALUES (''), ('-rc.1')) AS v(x)),
o AS (SELECT repo, a || '.' || b || '.0' || x AS v, row_number() OVER (PARTITION BY repo ORDER BY a DESC, b DESC, x) AS i FROM t)
SELECT repo, max(CASE WHEN i = 1 THEN v END) AS latest, string_agg(v, ' ' ORDER BY i) AS versions FROM o GROUP BY 1""")
def versions(spark, sf):
    """Tags of every nation's suppliers: releases and candidates, and tags that are no versions."""
    s = B.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("repo"), F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string"), F.lit("."), F.col("s_suppkey").cast("string"), F.lit(".0")).alias("t"))
    tags = s.select("repo", F.explode(F.array("t", F.concat("t", F.lit("-rc.1")), F.concat(F.lit("w"), "t"), F.lit("v2.9"))).alias("tag"))
    return M.latest_version(tags, ["repo"]).join(M.versions(tags, ["repo"]), "repo").select("repo", "latest", F.array_join("versions", " ").alias("versions"))


@query("""SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN '1.' || n_nationkey WHEN 1 THEN '1.' || (n_nationkey + 1) ELSE n_nationkey::VARCHAR END AS native, '1.' || (n_nationkey + 1) AS go FROM nation""")
def runtime_versions(spark, sf):
    """The build image decides, then the runtime where the parser is part of it, then its own image."""
    k = F.col("n_nationkey")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    own = B.table(spark, sf, "nation")
    build = F.when(k % 3 == 0, text("golang:1.", k, "-alpine")).otherwise("")
    v = M.runtime_versions(build, F.when(k % 3 == 1, "p").otherwise(""), text("openjdk:", k, "-slim"), text("1.", k + 1, "-x"))
    return own.select(k.alias("k"), v["native"].alias("native"), v["go"].alias("go"))


@query("SELECT n_nationkey AS k, '* fix ' || n_name || chr(10) || '* more' AS note FROM nation")
def release_notes(spark, sf):
    message = F.concat(F.lit("fix "), F.col("n_name"), F.lit("\n\nSigned-off-by: A <a@b.c>\n  more\n"))
    return B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), M.release_note(message).alias("note"))


@query("SELECT s_suppkey AS k, s_nationkey || '.' || s_suppkey || '.0' AS version FROM supplier")
def sdk_versions(spark, sf):
    """The version of a module that a dependency file names."""
    v = F.concat(F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string"), F.lit(".0"))
    text = F.concat(F.lit("require (\n\tx.org/other v9.0.0\n\tx.org/kit/v3 v"), v, F.lit("\n)\n"))
    return B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), M.sdk_version(text, "x.org/kit").alias("version"))


# ---- the parse service ---------------------------------------------------


@query("SELECT event_id AS doc_id, CASE user_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE event_type || chr(10) || event_type || chr(10) END AS text FROM events")
def joined_errors(spark, sf):
    """No error, one, and two as one text."""
    errors = F.transform(F.sequence(F.lit(1), F.col("user_id") % 3), lambda _: F.col("event_type"))
    own = F.when(F.col("user_id") % 3 == 0, F.array().cast("array<string>")).otherwise(errors)
    return B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), D.joined_errors(own).alias("text"))


def _lines_driver() -> D.Driver:
    def parser(code: str) -> dict:
        return {"status": "ok", "errors": [], "ast": {"@type": "File", "lines": [{"@type": "Line", "@token": s} for s in code.split("\n")]}}

    return D.Driver(parser, {"language": "lines", "aliases": ["text"]}, D.Transforms(namespace="ln", annotate=[W.Mappings(W.AnnotateType("Line", None, "Statement"))]))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'fatal' ELSE 'ok' END AS status, CASE WHEN doc_id % 3 > 0 THEN CASE doc_id % 3 WHEN 1 THEN 'lines' ELSE 'text' END END AS language,
CASE WHEN doc_id % 3 > 0 THEN len(string_split(coalesce(text, ''), chr(10)))::INT END AS n, doc_id % 3 > 0 AS timed FROM documents""")
def parse_v1(spark, sf):
    """Answers of the first protocol version, for a language by name, by alias, and an unknown one."""
    language = F.element_at(F.array(F.lit("go"), F.lit("lines"), F.lit("text")), (F.col("doc_id") % 3 + 1).cast("int"))
    own = B.source_documents(spark, sf).select(F.to_json(F.struct(F.col("code").alias("content"), language.alias("language"), F.col("doc_id").cast("string").alias("filename"))).alias("value"))
    out = Q.parse_v1(own, _lines_driver)
    kids = F.from_json(json_field("$.Children", "uast"), "array<struct<Roles:array<int>>>")
    marked = F.filter(kids, lambda x: F.array_contains(x["Roles"], R.number("Statement")))
    return out.select(json_field("$.filename", "request").cast(_LONG).alias("doc_id"), "status", "language", F.when(F.col("uast").isNotNull(), F.size(marked)).alias("n"), ((F.col("elapsed") > 0) & (F.size("errors") == 0)).alias("timed"))


@query("SELECT r_regionkey::BIGINT AS doc_id, 'ok' AS status, length(r_name) AS n FROM region")
def native_process(spark, sf):
    """A parser in a process of its own that answers a line for a line."""
    program = "import json,sys\nfor s in sys.stdin:\n print(json.dumps({'status': 'ok', 'ast': {'@type': 'T', 'n': len(json.loads(s)['content'])}}), flush=True)"
    make = lambda: D.Driver(Q.NativeProcess([sys.executable, "-c", program]), {"language": "x"}, D.Transforms())
    own = B.table(spark, sf, "region").select(F.to_json(F.struct(F.col("r_name").alias("content"), F.col("r_regionkey").alias("id"))).alias("value"))
    out = Q.parse(own, make)
    return out.select(json_field("$.id", "request").cast(_LONG).alias("doc_id"), "status", json_field("$.n").cast(_LONG).alias("n"))


@query("""SELECT * FROM (VALUES ('BadEncoding', 'InvalidArgument', 'encoding', 'BadEncoding', false), ('BadMode', 'InvalidArgument', 'mode', 'BadMode', false), ('DriverFailure', 'Internal', 'driver', 'DriverFailure', false),
('LanguageNotDetected', 'NotFound', 'language', 'LanguageNotDetected', false), ('MissingDriver', 'InvalidArgument', 'language driver', 'MissingDriver', false), ('SyntaxErrors', 'OK', 'syntax', 'SyntaxErrors', true),
('TransformFailure', 'FailedPrecondition', 'transform', 'TransformFailure', false)) AS v(error, code, reason, back, has_tree)""")
def protocol_status(spark, sf):
    """Errors as status records and back; the limit of messages is part of the options."""
    rows = []
    for kind in (O.BadEncoding, O.BadMode, O.DriverFailure, O.LanguageNotDetected, O.MissingDriver, O.SyntaxErrors, O.TransformFailure):
        status = O.to_status({"@type": "X"}, kind("why"))
        tree, error = O.from_status(status)
        rows.append((kind.__name__, status.code, status.reason, type(error).__name__, tree is not None))
    assert O.message_limit() == O.MESSAGE_LIMIT_MB << 20
    return spark.createDataFrame(rows, "error string, code string, reason string, back string, has_tree boolean")


@query("SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1")
def rows_of_documents(spark, sf):
    """The same trees from tables as documents, as structs, and as node rows, by their turns."""
    level = B.conversation_level(spark, sf)
    a = N.shred(documents(level)).where("type = 'Turn'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    b = Trees(level).objects("Turn").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    c = structs(level).select("doc_id", F.size("doc.turns").alias("k"))
    return a.join(b, "doc_id").join(c, "doc_id").where("n = m AND m = k").select("doc_id", "n")
