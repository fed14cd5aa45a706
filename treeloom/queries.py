"""Queries over the driver's tables, one or more per operator, with DuckDB SQL that gives the same rows.

Each is a function of (spark, sf_dir) over whole tables.  Results hold plain
columns only: lists come joined, numbers as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .functions import tree as T
from .operators import nodes as N
from .operators import positions as P
from .operators import rewrite as W
from .plans import builders as B
from .plans import columns as K
from .plans import pipeline as D
from .plans import select as C
from .plans import xpath
from .registry import oracle_sql, queries, query
from .sources import codecs as S
from .sources import graph as G
from .sources import manifest as M
from .sources.relational import Trees, documents, structs
from .streaming import parse as Q

__all__ = ["oracle_sql", "queries"]


def customers(spark, sf):
    return Trees(B.customer_level(spark, sf))


def regions(spark, sf):
    return Trees(B.region_level(spark, sf))


def conversations(spark, sf):
    return Trees(B.conversation_level(spark, sf))


def events(spark, sf):
    return N.shred(B.event_documents(spark, sf))


def path(make, q: str, value: Column | None = None, name: str = "value"):
    """Rows (doc_id, value) of a path query."""
    return lambda spark, sf: xpath.values(make(spark, sf), q).select("doc_id", (F.col("value") if value is None else value).alias(name))


def as_double() -> Column:
    return F.col("value").try_cast("double")


def json_field(p: str) -> Column:
    return F.get_json_object("doc", p)


_LONG = "bigint"

# ---- flagship and paths --------------------------------------------------


@query("SELECT o_custkey AS doc_id, l_extendedprice AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def xpath_flagship(spark, sf):
    """Prices of the lines of finished orders."""
    return path(customers, "//Order[@o_orderstatus='F']/lineitems/Lineitem/@l_extendedprice", as_double(), "price")(spark, sf)


@query("SELECT c_custkey AS doc_id, c_name AS value FROM customer")
def xpath_root_child(spark, sf):
    return path(customers, "/Customer/c_name/text()")(spark, sf)


@query("SELECT o_custkey AS doc_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def xpath_descendant(spark, sf):
    return xpath.values(customers(spark, sf), "//Order[@o_orderstatus='F']//Lineitem").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS doc_id, o_totalprice AS price FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def xpath_attr_eq(spark, sf):
    return path(customers, "//Order[@o_orderpriority='1-URGENT']/@o_totalprice", as_double(), "price")(spark, sf)


@query("SELECT o_custkey AS doc_id, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 45")
def xpath_attr_num_cmp(spark, sf):
    return path(customers, "//Lineitem[@l_quantity > 45]/@l_partkey", F.col("value").cast(_LONG), "l_partkey")(spark, sf)


@query("SELECT o_custkey AS doc_id, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R' OR l_quantity < 3")
def xpath_attr_or(spark, sf):
    return path(customers, "//Lineitem[@l_returnflag='R' or @l_quantity < 3]/@l_partkey", F.col("value").cast(_LONG), "l_partkey")(spark, sf)


@query("SELECT conv_id AS doc_id, turn FROM conversations WHERE role = 'user'")
def xpath_text_eq(spark, sf):
    return path(conversations, "//Turn/role[text()='user']/../@turn", F.col("value").cast(_LONG), "turn")(spark, sf)


@query("SELECT DISTINCT o_custkey AS doc_id, o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag = 'R'")
def xpath_parent(spark, sf):
    return path(customers, "//Lineitem[@l_returnflag='R']/../../@o_orderkey", F.col("value").cast(_LONG), "o_orderkey")(spark, sf)


@query("SELECT DISTINCT r_regionkey::BIGINT AS doc_id, r_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def xpath_ancestor(spark, sf):
    return path(regions, "//Supplier/ancestor::Region/@r_name")(spark, sf)


@query("SELECT DISTINCT b.conv_id AS doc_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn WHERE a.role = 'user'")
def xpath_following_sibling(spark, sf):
    return path(conversations, "//Turn[@role='user']/following-sibling::Turn/@turn", F.col("value").cast(_LONG), "turn")(spark, sf)


@query("SELECT DISTINCT b.conv_id AS doc_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn WHERE a.role = 'assistant'")
def xpath_preceding_sibling(spark, sf):
    return path(conversations, "//Turn[@role='assistant']/preceding-sibling::Turn/@turn", F.col("value").cast(_LONG), "turn")(spark, sf)


@query("SELECT conv_id AS doc_id, arg_min(role, turn) AS value FROM conversations GROUP BY 1")
def xpath_position_first(spark, sf):
    return path(conversations, "//turns/Turn[1]/@role")(spark, sf)


@query("SELECT conv_id AS doc_id, arg_max(role, turn) AS value FROM conversations GROUP BY 1")
def xpath_position_last(spark, sf):
    return path(conversations, "//turns/Turn[last()]/@role")(spark, sf)


@query("SELECT c_custkey AS doc_id, c_name AS value FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R')")
def xpath_exists_child(spark, sf):
    return path(customers, "/Customer[orders/Order/lineitems/Lineitem[@l_returnflag='R']]/@c_name")(spark, sf)


@query("SELECT c_custkey AS doc_id, c_name AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def xpath_not_child(spark, sf):
    return path(customers, "/Customer[not(orders/Order[@o_orderpriority='1-URGENT'])]/@c_name")(spark, sf)


@query("SELECT b.conv_id AS doc_id, b.role AS value FROM conversations b WHERE b.turn > 1")
def xpath_following(spark, sf):
    """Everything after the second turn, by document order."""
    return path(conversations, "//Turn[@turn='1']/following::Turn/@role")(spark, sf)


@query("SELECT b.conv_id AS doc_id, b.role AS value FROM conversations b WHERE b.turn < 1")
def xpath_preceding(spark, sf):
    return path(conversations, "//Turn[@turn='1']/preceding::Turn/@role")(spark, sf)


@query("SELECT c_custkey AS doc_id, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def xpath_whole_numbers(spark, sf):
    """Numbers that are integers come as such, too."""
    return xpath.execute(customers(spark, sf), "count(//Order[@o_orderstatus='F'])").select("doc_id", F.col("whole").alias("n"))


@query("SELECT conv_id AS doc_id, '' AS value, count(*) AS n FROM conversations GROUP BY 1")
def xpath_element_value(spark, sf):
    """Elements have an empty string-value."""
    return xpath.execute(conversations(spark, sf), "//Turn").groupBy("doc_id", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS doc_id, count(l_orderkey)::DOUBLE AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def xpath_count(spark, sf):
    return path(customers, "count(//Lineitem)")(spark, sf)


@query("SELECT c_custkey AS doc_id, coalesce(sum(l_quantity), 0)::DOUBLE AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def xpath_sum(spark, sf):
    return path(customers, "sum(//Lineitem/@l_quantity)")(spark, sf)


@query("SELECT c_custkey AS doc_id, coalesce(bool_or(o_orderstatus = 'P'), false) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def xpath_boolean(spark, sf):
    return path(customers, "boolean(//Order[@o_orderstatus='P'])")(spark, sf)


@query("SELECT r_regionkey::BIGINT AS doc_id, 'Region' AS value FROM region")
def xpath_name(spark, sf):
    return path(regions, "name(/*)")(spark, sf)


@query("""SELECT r_regionkey::BIGINT AS doc_id, c_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT r_regionkey::BIGINT, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def xpath_union(spark, sf):
    return path(regions, "//Customer/@c_name | //Supplier/@s_name")(spark, sf)


@query("SELECT event_id AS doc_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def xpath_json_field(spark, sf):
    return path(events, "//props//k/text()", F.col("value").cast(_LONG), "k")(spark, sf)


@query("""SELECT conv_id AS doc_id, turn FROM conversations c WHERE contains(text, 'the') AND starts_with(role, 'u') AND length(text) > 20""")
def xpath_string_functions(spark, sf):
    return path(conversations, "//Turn[contains(@text, 'the') and starts-with(@role, 'u') and string-length(@text) > 20]/@turn", F.col("value").cast(_LONG), "turn")(spark, sf)


@query("""SELECT o_custkey AS doc_id, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE n > 5""")
def xpath_count_predicate(spark, sf):
    return path(customers, "//Order[count(lineitems/Lineitem) > 5]/@o_orderkey", F.col("value").cast(_LONG), "o_orderkey")(spark, sf)


@query(r"""SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS value FROM pages""")
def xpath_html_links(spark, sf):
    nodes = N.shred(S.from_html(B.table(spark, sf, "pages")))
    return xpath.execute(nodes, "//html:a/@href").select("doc_id", "value")


# ---- traversal -----------------------------------------------------------

_REGION_PATHS = """
WITH n AS (SELECT *, '/nations/' || lpad((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::VARCHAR, 8, '0') AS np FROM nation),
c AS (SELECT n_regionkey, np || '/customers/' || lpad((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::VARCHAR, 8, '0') AS cp FROM customer JOIN n ON c_nationkey = n_nationkey),
s AS (SELECT n_regionkey, np || '/suppliers/' || lpad((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::VARCHAR, 8, '0') AS sp FROM supplier JOIN n ON s_nationkey = n_nationkey),
paths AS (
  SELECT r_regionkey AS doc, x AS p FROM region, (VALUES (''), ('/@type'), ('/nations'), ('/r_name'), ('/r_regionkey')) AS v(x)
  UNION ALL SELECT n_regionkey, np || x FROM n, (VALUES (''), ('/@type'), ('/customers'), ('/n_name'), ('/n_nationkey'), ('/suppliers')) AS v(x)
  UNION ALL SELECT n_regionkey, cp || x FROM c, (VALUES (''), ('/@type'), ('/c_custkey'), ('/c_name')) AS v(x)
  UNION ALL SELECT n_regionkey, sp || x FROM s, (VALUES (''), ('/@type'), ('/s_name'), ('/s_suppkey')) AS v(x))
"""
_STEP = "CASE WHEN regexp_matches(split_part(p, '/', -1), '^[0-9]+$') THEN split_part(p, '/', -1)::INT::VARCHAR ELSE split_part(p, '/', -1) END AS step"


def _stepped(nodes: DataFrame, order: str) -> DataFrame:
    return N.ranked(nodes, order).select("doc_id", F.col("rank").cast(_LONG).alias("rank"), F.coalesce("field", F.col("ord").cast("string"), F.lit("")).alias("step"))


@query(_REGION_PATHS + f"SELECT doc::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY p) - 1 AS rank, {_STEP} FROM paths")
def preorder_nodes(spark, sf):
    return _stepped(regions(spark, sf).table(), T.PRE)


@query(_REGION_PATHS + f"SELECT doc::BIGINT AS doc_id, row_number() OVER (PARTITION BY doc ORDER BY p || chr(127)) - 1 AS rank, {_STEP} FROM paths")
def postorder_rank(spark, sf):
    return _stepped(regions(spark, sf).table(), T.POST)


@query(_REGION_PATHS + "SELECT doc::BIGINT AS doc_id, (length(p) - length(replace(p, '/', '')))::INT AS level, count(*) AS n FROM paths GROUP BY 1, 2")
def levelorder_counts(spark, sf):
    return regions(spark, sf).table().groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, n * (SELECT count(*) FROM events) AS n FROM (VALUES ('Object', 2), ('String', 1), ('Int', 3)) AS v(kind, n)")
def count_by_kind(spark, sf):
    return events(spark, sf).groupBy(N.kind_names().alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS doc_id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def children_count(spark, sf):
    own = customers(spark, sf).composites()
    return N.children_counts(own).where("pre = 0").select("doc_id", "n")


@query("SELECT r_regionkey::BIGINT AS doc_id, count(*) * 5 AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def pruned_walk(spark, sf):
    """Nodes of the nations that are seen by a walk which skips lists of customers and suppliers."""
    own = N.pruned(regions(spark, sf).table(), F.col("field").isin("customers", "suppliers"))
    below = own.where(F.col("level") == 3)
    return below.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey AS doc_id, 1 + count(*) * 12 AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'P' GROUP BY 1, o_orderkey""")
def subtree_sizes(spark, sf):
    """Nodes of the line lists of pending orders, the list included."""
    own = customers(spark, sf)
    tops = xpath.execute(own, "//Order[@o_orderstatus='P']/lineitems").select("doc_id", "pre")
    return own.composites().where("field = 'lineitems'").join(tops, ["doc_id", "pre"], "left_semi").where("size > 0").select("doc_id", (F.col("size") + 1).alias("n"))


@query("SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1")
def object_parents(spark, sf):
    """Objects whose nearest object above is the root."""
    return N.object_parents(conversations(spark, sf).composites()).where("obj = 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


# ---- hashes, tokens, positions in trees ----------------------------------


@query("SELECT event_type, count(DISTINCT props) AS n FROM events GROUP BY 1")
def hash_dedup_subtrees(spark, sf):
    e = B.table(spark, sf, "events")
    hashes = N.hashes(N.shred(e.select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc"))))
    return hashes.join(e.select(F.col("event_id").alias("doc_id"), "event_type"), "doc_id").groupBy("event_type").agg(F.countDistinct("hash").alias("n"))


@query("SELECT count(DISTINCT coalesce(text, '')) AS n FROM documents")
def hash_no_pos(spark, sf):
    """Texts told apart by hashes that leave out positions, which all differ."""
    at = F.struct(F.lit("uast:Position").alias("@type"), F.col("doc_id").alias("offset"), F.lit(0).alias("line"), F.lit(0).alias("col"))
    doc = F.to_json(F.struct(F.lit("Document").alias("@type"), F.struct(F.lit("uast:Positions").alias("@type"), at.alias("start")).alias("@pos"), F.col("code").alias("text")))
    own = N.hashes(N.shred(B.source_documents(spark, sf).select("doc_id", doc.alias("doc"))), drop_positions=True)
    return own.agg(F.countDistinct("hash").alias("n"))


@query("SELECT conv_id AS doc_id, string_agg(role, ',' ORDER BY turn) AS tokens FROM conversations GROUP BY 1")
def tokens_list(spark, sf):
    level = B.conversation_level(spark, sf)
    turn = level.children["turns"]
    turn.rows, turn.scalars = turn.rows.withColumn("@token", F.col("role")), ["@token", "turn"]
    return N.tokens(N.shred(documents(level))).select("doc_id", F.array_join("tokens", ",").alias("tokens"))


@query("SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) ORDER BY turn)) AS content FROM conversations GROUP BY 1")
def content_of(spark, sf):
    level = B.conversation_level(spark, sf)
    turn = level.children["turns"]
    turn.type, turn.rows, turn.scalars = "uast:String", turn.rows.withColumn("Value", F.col("text")), ["Value", "turn"]
    own = N.contents(Trees(level).objects()).where("type = 'uast:String'")
    texts = own.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pre", "content"))).alias("c"))
    return texts.select("doc_id", F.md5(F.array_join(F.transform("c", lambda x: x["content"]), "\n")).alias("content"))


@query(r"""SELECT page_id AS doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: x <> ''))), ' ') AS paths FROM pages""")
def import_paths(spark, sf):
    """Linked addresses of a page as imports of a module."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    one = lambda h: F.struct(F.lit("uast:Import").alias("@type"), F.struct(F.lit("uast:String").alias("@type"), h.alias("Value")).alias("Path"))
    doc = F.to_json(F.struct(F.lit("Module").alias("@type"), F.transform(hrefs, one).alias("imports")))
    own = B.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), doc.alias("doc"))
    return N.import_paths(own).select("doc_id", F.array_join("paths", " ").alias("paths"))


#: also used by ``value_queries``
_LINES = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i AS line, ls[i] AS text, (list_sum([0] || [strlen(x) + 1 FOR x IN ls[1:i-1]]))::BIGINT AS byte_start FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l))
"""


def _line_nodes(spark, sf) -> DataFrame:
    own = P.lines(B.source_documents(spark, sf))
    at = F.struct(F.col("byte_start").alias("offset"), F.col("line").alias("line"), F.lit(1).cast(_LONG).alias("col"))
    empty = {c: F.lit(None).cast(k) for c, k in N.COLUMNS.items()}
    have = {"doc_id": F.col("doc_id"), "pre": -F.col("line"), "kind": F.lit(T.OBJECT), "type": F.lit("Line"), "pos": F.create_map(F.lit("start"), at)}
    return own.select(*((have.get(c, e)).cast(N.COLUMNS[c]).alias(c) for c, e in empty.items()))


@query(_LINES + "SELECT doc_id, -line AS pre, line - 1 AS rank FROM lines")
def positional_order(spark, sf):
    """Lines, numbered backwards, in the order of their positions."""
    return N.positional(_line_nodes(spark, sf)).select("doc_id", "pre", F.col("rank").cast(_LONG).alias("rank"))


# ---- positions in source text --------------------------------------------


@query(_LINES + "SELECT doc_id, line, byte_start FROM lines")
def line_index(spark, sf):
    return P.lines(B.source_documents(spark, sf)).select("doc_id", "line", "byte_start")


@query(r"SELECT doc_id, length(coalesce(text, '')) + len(regexp_extract_all(coalesce(text, ''), '[\x{10000}-\x{10FFFF}]')) AS units, strlen(coalesce(text, '')) AS bytes FROM documents")
def utf16_offset(spark, sf):
    size = F.octet_length("code")
    own = B.source_documents(spark, sf).select("doc_id", "code", P.byte_to_utf16(F.col("code"), size).alias("units"))
    return own.select("doc_id", "units", P.utf16_to_byte(F.col("code"), F.col("units")).alias("bytes"))


@query(_LINES + "SELECT doc_id, max(byte_start + strlen(text)) AS \"offset\", max(line) AS line, arg_max(strlen(text), line) + 1 AS col FROM lines GROUP BY 1")
def complete_positions(spark, sf):
    """The end of every text from its offset alone."""
    trees = B.source_documents(spark, sf)
    zero = F.lit(0).cast(_LONG)
    end = F.struct(F.octet_length("code").cast(_LONG).alias("offset"), zero.alias("line"), zero.alias("col"))
    have = {"doc_id": F.col("doc_id"), "pre": zero, "kind": F.lit(T.OBJECT), "pos": F.create_map(F.lit("end"), end)}
    own = trees.select(*((have.get(c, F.lit(None))).cast(k).alias(c) for c, k in N.COLUMNS.items()))
    p = P.complete(own, trees).select("doc_id", F.try_element_at("pos", F.lit("end")).alias("p"))
    return p.select("doc_id", "p.offset", "p.line", "p.col")


def talks(spark, sf):
    return documents(B.conversation_level(spark, sf))


V = W.Var
_ORDERS_OF = "FROM orders JOIN customer ON c_custkey = o_custkey"


def _listed(p: str) -> Column:
    return F.from_json(json_field(p), "array<string>")


# ---- roles, namespaces, pipelines ----------------------------------------


@query("SELECT 'ev:' || event_type AS type, count(*) AS n FROM events GROUP BY 1")
def default_namespace(spark, sf):
    own = N.default_namespace(events(spark, sf), "ev")
    return own.where("kind = 2 AND type <> ''").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query(_LINES + "SELECT doc_id, 'Document' AS type, max(byte_start + strlen(text)) AS end_offset, max(line) AS end_line, arg_max(strlen(text), line) + 1 AS end_col FROM lines GROUP BY 1")
def object_to_node_positions(spark, sf):
    """Native offsets become positions, completed from the source, in one pipeline."""
    pipeline = D.Transforms(preprocess=[W.Mappings(W.ObjectToNode(type_key="kind", offset_key="from", end_offset_key="to"))], code=[P.FromOffset()])
    docs = B.source_documents(spark, sf)
    docs = docs.withColumn("doc", F.to_json(F.struct(F.lit("Document").alias("kind"), F.lit(0).alias("from"), F.octet_length("code").alias("to"))))
    out = D.transform(docs, pipeline, D.PREPROCESSED, code="code")
    end = lambda k: json_field(f"$.@pos.end.{k}").cast(_LONG).alias(f"end_{k}")
    return out.select("doc_id", json_field("$.@type").alias("type"), end("offset"), end("line"), end("col"))


def _talk_pipeline() -> D.Transforms:
    turn = W.Map(W.Part("_", W.Obj({"@type": "Turn", "role": V("r")})), W.Part("_", W.Obj({"@type": "uast:Identifier", "Name": V("r")})))
    return D.Transforms(namespace="talk", normalize=[W.Mappings(turn)], annotate=[W.Mappings(W.AnnotateType("Conversation", None, "Module"), W.AnnotateType("Turn", None, "Statement"))])


_SHOWN = "string_agg({turn} || ' ' || role || ' Statement', ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1"


def _shown(spark, sf, mode: str, name: str) -> DataFrame:
    """A pipeline over conversations, compiled: the types and roles that a mode leaves."""
    level = B.conversation_level(spark, sf)
    out = K.transform(structs(level), _talk_pipeline(), D.parse_mode(mode), shape=level)
    roles = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "+")
    own = (lambda t: roles(t["@role"])) if name == "role" else (lambda t: F.lit(""))  # identifiers have none
    turn = F.transform("doc.turns", lambda t: F.concat(t["@type"], F.lit(" "), t[name], F.lit(" "), own(t)))
    return out.select("doc_id", F.col("doc.`@type`").alias("type"), roles(F.col("doc.`@role`")).alias("roles"), F.array_join(turn, ",").alias("turns"))


@query("SELECT conv_id AS doc_id, 'Conversation' AS type, 'Module' AS roles, " + _SHOWN.format(turn="'Turn'"))
def mode_annotated(spark, sf):
    return _shown(spark, sf, "annotated", "role")


@query("SELECT conv_id AS doc_id, 'talk:Conversation' AS type, 'Module' AS roles, string_agg('uast:Identifier ' || role || ' ', ',' ORDER BY turn) AS turns FROM conversations GROUP BY 1")
def mode_semantic(spark, sf):
    """Turns are identifiers by the time roles are given to turns."""
    return _shown(spark, sf, "semantic", "Name")


@query("SELECT 'Customer' AS local, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Supplier', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def forbidden_types(spark, sf):
    return N.forbidden_types(regions(spark, sf).objects(), ["Customer", "Supplier", "Planet"])


# ---- text functions ------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract(t, '^([\s*/]*)', 1) AS prefix FROM w),
s AS (SELECT doc_id, prefix, regexp_extract(substr(t, length(prefix) + 1), '([\s*/]*)$', 1) AS suffix, substr(t, length(prefix) + 1) AS r FROM p)
SELECT doc_id, prefix, suffix, length(r) - length(suffix) AS n FROM s""")
def comment_parts(spark, sf):
    """Texts as block comments: what surrounds the text proper."""
    c = X.comment_columns(F.concat(F.lit("/*"), F.col("code"), F.lit("*/")), "/*", "*/")
    own = B.source_documents(spark, sf).select("doc_id", F.length("code").cast(_LONG).alias("all"), c["prefix"].alias("prefix"), c["suffix"].alias("suffix"))
    return own.select("doc_id", "prefix", "suffix", (F.col("all") - F.length("prefix") - F.length("suffix")).alias("n"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def uncomment(spark, sf):
    return B.source_documents(spark, sf).select("doc_id", F.md5(X.uncomment_c_col(F.concat(F.lit("/*"), F.col("code"), F.lit("*/")))).alias("text"))


# ---- codecs --------------------------------------------------------------


@query("SELECT kind, n * (SELECT count(*) FROM events) AS n FROM (VALUES (2, 1), (8, 1), (16, 1)) AS v(kind, n)")
def raw_graph_nodes(spark, sf):
    """Stored nodes of the graph files of event properties, by kind."""
    docs = B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc"))
    return G.raw_nodes(G.encode(docs)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS doc_id, lower(event_type) AS status, CASE WHEN event_type = 'error' THEN 'syntax' ELSE 'unknown' END AS outcome FROM events")
def parse_responses(spark, sf):
    """Events as answers of a parser, whose status is their type in capitals."""
    line = F.to_json(F.struct(F.upper("event_type").alias("status"), F.array(F.lit("e")).alias("errors"), F.col("props").alias("ast")))
    own = B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), S.response(line).alias("r"))
    return own.select("doc_id", "r.status", S.outcome(F.col("r"))["status"].alias("outcome"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents")
def content_encoding(spark, sf):
    own = B.source_documents(spark, sf)
    return own.select("doc_id", F.md5(S.decode_content(S.encode_content(F.col("code"), "base64"), "base64")).alias("text"))


def _line_driver() -> D.Driver:
    def parser(code: str) -> dict:
        return {"status": "ok", "errors": [], "ast": {"@type": "File", "lines": [{"@type": "Line", "@token": s} for s in code.split("\n")]}}

    return D.Driver(parser, {"language": "lines", "aliases": ["text"]}, D.Transforms(namespace="ln", annotate=[W.Mappings(W.AnnotateType("Line", None, "Statement"))]))


@query("SELECT doc_id, 'ok' AS status, len(string_split(coalesce(text, ''), chr(10)))::INT AS n FROM documents")
def parse_requests(spark, sf):
    """Request lines through a driver to semantic trees."""
    own = B.source_documents(spark, sf).select(F.to_json(F.struct(F.col("code").alias("content"), F.col("doc_id").cast("string").alias("id"))).alias("value"))
    out = Q.parse(own, _line_driver)
    lines = F.from_json(F.get_json_object("doc", "$.lines"), "array<struct<`@type`:string>>")
    return out.select(F.get_json_object("request", "$.id").cast(_LONG).alias("doc_id"), "status", F.size(F.filter(lines, lambda x: x["@type"] == "ln:Line")).alias("n"))


from . import rule_queries, value_queries  # noqa: E402, F401 - they register their queries
