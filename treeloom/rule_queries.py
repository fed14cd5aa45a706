"""Queries of the rewrite algebra, with DuckDB SQL that gives the same rows.

Rules run compiled, as column expressions over structs (``plans.columns``); a few
that a compiler can't take, functions and reversed conversions, run document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import roles as R
from .functions import tree as T
from .functions import uast as U
from .operators import nodes as N
from .operators import rewrite as W
from .plans import builders as B
from .plans import columns as K
from .plans import pipeline as D
from .plans import select as C
from .registry import query
from .sources.relational import Level, Trees, documents, structs

V, Field = W.Var, W.Field
_LONG = "bigint"


def json_field(p: str) -> Column:
    return F.get_json_object("doc", p)


def order_level(spark, sf) -> Level:
    level = B.order_level(spark, sf)
    level.parent = ""
    return level


def plain_orders(spark, sf) -> Level:
    """Orders without their lines."""
    level = order_level(spark, sf)
    level.children = {}
    return level


def ruled(level: Level, rule, **columns: Column | str) -> DataFrame:
    """Columns of the objects of a level after a rule; strings are paths in the new tree."""
    out = K.rewrite(structs(level), rule, shape=level)
    return out.select("doc_id", *((F.col(f"doc.{c}") if isinstance(c, str) else c).alias(name) for name, c in columns.items()))


def part(src: dict, dst: dict) -> W.Rule:
    return W.MapPart("_", W.MapObj(W.Obj(src), W.Obj(dst)))


def talks(spark, sf) -> Level:
    return B.conversation_level(spark, sf)


_ORDERS_OF = "FROM orders JOIN customer ON c_custkey = o_custkey"

# ---- objects and fields --------------------------------------------------


def _rename() -> W.Rule:
    return W.Map(
        W.Obj({"@type": V("t"), "event_id": V("e"), "user_id": V("u"), "props": W.Obj({"k": V("k")})}),
        W.Obj({"@type": V("t"), "id": V("e"), "user": V("u"), "k": V("k")}),
    )


@query("SELECT event_id AS doc_id, event_type AS type, user_id AS \"user\", json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def rule_rename_field(spark, sf):
    return K.rewrite(B.event_structs(spark, sf), _rename()).select("doc_id", F.col("doc.`@type`").alias("type"), "doc.user", "doc.k")


@query("SELECT event_id AS doc_id, event_id AS id, event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def rule_reverse_roundtrip(spark, sf):
    """A rule and its reverse: the renamed key in between, all values after it."""
    there = K.rewrite(B.event_structs(spark, sf), _rename())
    back = K.rewrite(there.select("doc_id", "doc"), W.Reverse(_rename()), absent=True).withColumnRenamed("doc", "back")
    return there.join(back, "doc_id").select("doc_id", "doc.id", "back.event_id", "back.user_id", "back.props.k")


@query("SELECT event_id AS doc_id, user_id AS uid, event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def rule_partial(spark, sf):
    out = K.rewrite(B.event_structs(spark, sf), part({"user_id": V("u")}, {"uid": V("u")}))
    return out.select("doc_id", "doc.uid", "doc.event_id", "doc.props.k")


@query("SELECT event_id AS doc_id, user_id, event_id AS \"same\" FROM events")
def rule_identity(spark, sf):
    """The same operation on both sides leaves a tree as it is."""
    out = K.rewrite(B.event_structs(spark, sf), W.Identity(W.Part("_", W.Obj({"event_id": V("e"), "user_id": V("u")}))))
    return out.select("doc_id", "doc.user_id", F.col("doc.event_id").alias("same"))


def _values(spark, sf) -> DataFrame:
    value = F.when(F.col("value") >= 10, F.col("value")).alias("value")
    return B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.struct(F.lit("Event").alias("@type"), value).alias("doc"))


@query("SELECT event_id AS doc_id, CASE WHEN value >= 10 THEN value END AS amount FROM events")
def rule_optional_field(spark, sf):
    """A field that may be absent."""
    rule = W.Map(
        W.Fields(Field("@type", W.Is("Event")), Field("value", V("v"), optional="v_exists")),
        W.Fields(Field("@type", W.Is("Amount")), Field("amount", V("v"), optional="v_exists")),
    )
    return K.rewrite(_values(spark, sf), rule, absent=True).select("doc_id", "doc.amount")


@query("SELECT event_id AS doc_id, CASE WHEN value >= 10 THEN value END AS amount FROM events")
def rule_opt(spark, sf):
    """A field that may be nil."""
    rule = W.Map(W.Obj({"@type": "Event", "value": W.Opt("has", V("v"))}), W.Obj({"@type": "Amount", "amount": W.Opt("has", V("v"))}))
    return K.rewrite(_values(spark, sf), rule).select("doc_id", "doc.amount")


@query("SELECT event_id AS doc_id, event_id, '{\"@type\":\"' || event_type || '\",\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}' AS doc FROM events")
def rule_drop_field(spark, sf):
    src = W.Part("_", W.Fields(Field("props", W.AnyNode(), drop=True), Field("user_id", V("u"))))
    out = K.as_json(B.event_structs(spark, sf), W.Map(src, W.Part("_", W.Obj({"user_id": V("u")}))))
    return out.select("doc_id", json_field("$.event_id").cast(_LONG).alias("event_id"), "doc")


@query("SELECT o_orderkey AS doc_id, o_orderstatus AS state, o_totalprice AS price FROM orders")
def rule_typed_obj(spark, sf):
    """Exact objects of a type, with a name for all fields."""
    names = {"o_orderkey": "key", "o_orderstatus": "state", "o_totalprice": "price", "o_orderdate": "date", "o_orderpriority": "priority"}
    rule = W.Map(W.TypedObj("Order", {k: V(k) for k in names}), W.TypedObj("Bill", {v: V(k) for k, v in names.items()}))
    return ruled(plain_orders(spark, sf), rule, state="state", price="price")


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS a, o_orderstatus AS b, o_totalprice AS price FROM orders")
def rule_join(spark, sf):
    """Disjoint operations joined, of which one is partial: two fields swap names."""
    src = W.JoinObj(W.Obj({"o_orderstatus": V("s")}), W.Part("_", W.Obj({"o_orderpriority": V("p")})))
    dst = W.JoinObj(W.Obj({"o_orderstatus": V("p")}), W.Part("_", W.Obj({"o_orderpriority": V("s")})))
    return ruled(plain_orders(spark, sf), W.Map(src, dst), a="o_orderstatus", b="o_orderpriority", price="o_totalprice")


_STATES = {"F": "finished", "O": "open", "P": "pending"}


@query("SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS state, o_orderpriority AS priority FROM orders")
def rule_obj_map(spark, sf):
    """Field by field, each a pair of operations."""
    fields = W.ObjMap({"o_orderstatus": W.Map(W.LookupVar("s", _STATES), V("s")), "o_orderpriority": W.Identity(V("p"))})
    return ruled(plain_orders(spark, sf), W.MapPart("_", fields), state="o_orderstatus", priority="o_orderpriority")


@query("SELECT event_id AS doc_id, json_extract_string(props, '$.k')::BIGINT AS \"key\", user_id AS k FROM events")
def rule_scopes(spark, sf):
    """The same variable in two scopes."""
    inner = W.Scope("inside", W.Map(W.Obj({"k": V("v")}), W.Obj({"key": V("v")})))
    rule = W.MapPart("_", W.ObjMap({"props": inner, "user_id": W.Identity(V("v"))}))
    return K.rewrite(B.event_structs(spark, sf), rule).select("doc_id", "doc.props.key", F.col("doc.user_id").alias("k"))


@query("SELECT o_orderkey AS doc_id, o_orderstatus AS state, o_orderpriority = '1-URGENT' AS urgent FROM orders")
def rule_cases_obj(spark, sf):
    """Objects with a common field, told apart by another one; other priorities stay as they are."""
    left = W.CasesObj("c", W.Obj({"o_orderstatus": V("s")}), W.Objs({"o_orderpriority": "1-URGENT"}, {"o_orderpriority": "2-HIGH"}))
    right = W.CasesObj("c", W.Obj({"state": V("s")}), W.Objects(W.Obj({"rank": "A"}), W.Obj({"rank": "B"})))
    out = K.rewrite(structs(lv := plain_orders(spark, sf)), W.MapPart("_", W.Rule(left, right)), shape=lv)
    state = F.coalesce("doc.state", "doc.o_orderstatus")
    return out.select("doc_id", state.alias("state"), F.coalesce(F.col("doc.rank") == "A", F.lit(False)).alias("urgent"))


# ---- lookups and choices -------------------------------------------------

_PRIORITIES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4, "5-LOW": 5}


@query("SELECT o_orderkey AS doc_id, left(o_orderpriority, 1)::BIGINT AS priority FROM orders")
def rule_lookup(spark, sf):
    return ruled(plain_orders(spark, sf), part({"o_orderpriority": W.LookupVar("p", _PRIORITIES)}, {"priority": V("p")}), priority=F.col("doc.priority").cast(_LONG))


@query("SELECT o_orderkey AS doc_id, o_orderpriority AS left_as_it_was, 'unhandled value' AS error FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')")
def rule_errors(spark, sf):
    """Values a lookup doesn't know: the node stays, the error is reported."""
    few = {k: v for k, v in _PRIORITIES.items() if v < 4}
    out = K.rewrite(structs(lv := plain_orders(spark, sf)), part({"o_orderpriority": W.LookupVar("p", few)}, {"priority": V("p")}), shape=lv)
    return out.where(F.size("errors") > 0).select("doc_id", F.col("doc.o_orderpriority").alias("left_as_it_was"), F.array_join("errors", ",").alias("error"))


@query("SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def rule_lookup_op(spark, sf):
    state = W.LookupOpVar("s", {"F": W.String("finished"), "O": W.String("open"), None: W.String("other")})
    return ruled(plain_orders(spark, sf), part({"o_orderstatus": V("s")}, {"o_orderstatus": V("s"), "state": state}), state="state")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE o_orderpriority END AS \"when\" FROM orders")
def rule_if(spark, sf):
    rule = part({"o_orderpriority": W.If("urgent", W.Is("1-URGENT"), V("p"))}, {"when": W.If("urgent", W.String("now"), V("p"))})
    return ruled(plain_orders(spark, sf), rule, when="when")


@query("SELECT o_orderkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'B' ELSE 'Z' END AS grade FROM orders")
def rule_cases(spark, sf):
    left = W.Cases("c", W.Is("1-URGENT"), W.Is("2-HIGH"), W.AnyNode())
    right = W.Cases("c", W.String("A"), W.String("B"), W.String("Z"))
    return ruled(plain_orders(spark, sf), part({"o_orderpriority": left}, {"grade": right}), grade="grade")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_totalprice <> floor(o_totalprice) THEN o_totalprice END AS price FROM orders")
def rule_var_kind(spark, sf):
    """Only prices that are no whole numbers are floats."""
    out = K.rewrite(structs(lv := plain_orders(spark, sf)), part({"o_totalprice": W.VarKind("p", T.FLOAT)}, {"price": V("p")}), shape=lv)
    return out.select("doc_id", "doc.price")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS unfinished FROM orders")
def rule_check(spark, sf):
    """A guard before a variable."""
    return ruled(plain_orders(spark, sf), part({"o_orderstatus": W.Check(W.Not(W.Is("F")), V("s"))}, {"unfinished": V("s")}), unfinished="unfinished")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS state FROM orders")
def rule_check_obj(spark, sf):
    """A guard on the whole object."""
    src = W.CheckObj(W.Has({"o_orderpriority": W.In("1-URGENT")}), W.Part("_", W.Obj({"o_orderstatus": V("s")})))
    return ruled(plain_orders(spark, sf), W.Map(src, W.Part("_", W.Obj({"state": V("s")}))), state="state")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS finished FROM orders")
def rule_seq(spark, sf):
    """Two operations on one node."""
    return ruled(plain_orders(spark, sf), part({"o_orderstatus": W.Seq(W.Is("F"), V("s"))}, {"finished": V("s")}), finished="finished")


@query("SELECT o_orderkey AS doc_id, nullif(count(l_orderkey), 0)::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rule_not_empty(spark, sf):
    """Lists that hold something get another name."""
    return ruled(order_level(spark, sf), part({"lineitems": W.NotEmpty(V("l"))}, {"lines": W.NotEmpty(V("l"))}), n=F.when(F.col("doc.lines").isNotNull(), F.size("doc.lines")).cast(_LONG))


@query("SELECT event_type AS type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def rule_pushdown(spark, sf):
    """What a pattern needs of a node, as a selector on the node table."""
    src = W.CasesObj("c", W.Obj({"event_id": V("e")}), W.Objs({"@type": "click"}, {"@type": "view"}))
    nodes = N.shred(B.event_documents(spark, sf))
    own = [C.select(nodes, W.needed(W.Part("_", W.JoinObj(W.Obj({"event_id": V("e")}), W.TypedObj(t))))) for t in ("click", "view")]
    assert set(src.needs()) == {"event_id", "@type"}
    return own[0].unionByName(own[1]).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS doc_id, CASE event_type WHEN 'click' THEN 'Call' WHEN 'view' THEN 'Literal' ELSE '' END AS roles FROM events")
def rule_index(spark, sf):
    """Rules by type: of other types nothing changes."""
    rules = W.Mappings(W.AnnotateType("click", None, "Call"), W.AnnotateType("view", None, "Literal"))
    out = K.rewrite(B.event_structs(spark, sf), rules)
    return out.select("doc_id", F.array_join(F.coalesce("doc.`@role`", F.array().cast("array<string>")), ",").alias("roles"))


@query("SELECT event_id AS doc_id, event_id % 2 = 0 AS even FROM events")
def rule_transform_func(spark, sf):
    """A function of objects, bottom-up, document by document."""
    out = D.rewrite(B.event_documents(spark, sf), W.TransformObjFunc(lambda n: (n | {"even": n["event_id"] % 2 == 0}, True) if "event_id" in n else (n, False)))
    return out.select("doc_id", json_field("$.even").cast("boolean").alias("even"))


# ---- selectors -----------------------------------------------------------


@query("SELECT o_orderkey AS doc_id, coalesce(bool_or(l_returnflag = 'R'), false) AS matched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rule_any_elem(spark, sf):
    return K.matching_level(order_level(spark, sf), W.Has({"lineitems": W.AnyElem(W.Has({"l_returnflag": "R"}))}))


@query("SELECT o_orderkey AS doc_id, coalesce(bool_and(l_linestatus = 'F'), true) AS matched FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def rule_all(spark, sf):
    return K.matching_level(order_level(spark, sf), W.Has({"lineitems": W.All(W.Has({"l_linestatus": "F"}))}))


@query("SELECT o_orderkey AS doc_id, o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS matched FROM orders")
def rule_selectors(spark, sf):
    """And, Not, Has, In together."""
    return K.matching_level(plain_orders(spark, sf), W.And(W.HasType("Order"), W.Not(W.Has({"o_orderstatus": "F"})), W.Has({"o_orderpriority": W.In("1-URGENT", "2-HIGH")})))


@query("SELECT event_id AS doc_id, coalesce(json_extract_string(props, '$.k')::BIGINT < 50, true) AS matched FROM events")
def rule_empty_obj(spark, sf):
    k = F.when(F.col("doc.props.k") >= 50, F.col("doc.props.k"))
    own = B.event_structs(spark, sf).select("doc_id", F.struct(F.col("doc.`@type`"), F.struct(k.alias("k")).alias("props")).alias("doc"))
    return K.matching(own, W.Has({"props": W.EmptyObj()}), shape=lambda c: K.of_type(c, own.schema["doc"].dataType, absent=True))


@query("SELECT event_id AS doc_id, value = floor(value) AS matched FROM events")
def rule_of_kind(spark, sf):
    """Whole numbers are integers."""
    own = B.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.struct("value").alias("doc"))
    return K.matching(own, W.Has({"value": W.OfKind(T.INT)}))


@query("SELECT o_orderkey AS doc_id, o_orderstatus <> 'F' AS matched FROM orders")
def rule_obj_not(spark, sf):
    return K.matching_level(plain_orders(spark, sf), W.ObjNot(W.Has({"o_orderstatus": "F"})))


@query("SELECT event_id AS doc_id, value >= 10 AS matched FROM events")
def rule_not_nil(spark, sf):
    return K.matching(_values(spark, sf), W.Has({"value": W.NotNil()}))


@query("SELECT DISTINCT conv_id AS doc_id FROM conversations WHERE role = 'system'")
def select_any_elem(spark, sf):
    """A selector over fields and items as semi-joins on the node table."""
    own = N.shred(documents(talks(spark, sf)))
    return C.select(own, W.Has({"turns": W.AnyElem(W.Has({"role": "system"}))})).select("doc_id")


@query("SELECT conv_id AS doc_id FROM conversations GROUP BY 1 HAVING NOT bool_or(role = 'system') AND count(*) > 0")
def select_all(spark, sf):
    """The same for all items, by anti-joins."""
    own = N.shred(documents(talks(spark, sf)))
    return C.select(own, W.And(W.HasType("Conversation"), W.Has({"turns": W.All(W.Not(W.Has({"role": W.In("system")})))}))).select("doc_id")


@query(f"SELECT o_custkey AS doc_id, count(*) AS n {_ORDERS_OF} GROUP BY 1")
def rule_has_type(spark, sf):
    own = Trees(B.customer_level(spark, sf)).objects()
    return own.where(N.has_type("Order")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1")
def rule_has_fields(spark, sf):
    """Objects that have a role and no list of turns."""
    own = C.select(N.shred(documents(talks(spark, sf))), W.HasFields({"role": True, "turns": False}))
    return own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT o_custkey AS doc_id, o_orderkey {_ORDERS_OF} WHERE o_orderstatus IN ('F', 'P')")
def rule_in(spark, sf):
    own = Trees(B.customer_level(spark, sf)).objects().where(N.has_type("Order") & N.field_text("o_orderstatus").isin("F", "P"))
    return own.select("doc_id", N.field_text("o_orderkey").cast(_LONG).alias("o_orderkey"))


@query(f"SELECT o_custkey AS doc_id, o_orderkey {_ORDERS_OF} WHERE NOT o_orderstatus = 'F' AND o_orderpriority = '5-LOW'")
def rule_not_and(spark, sf):
    own = Trees(B.customer_level(spark, sf)).objects().where(N.has_type("Order") & ~(N.field_text("o_orderstatus") == "F") & (N.field_text("o_orderpriority") == "5-LOW"))
    return own.select("doc_id", N.field_text("o_orderkey").cast(_LONG).alias("o_orderkey"))


# ---- arrays --------------------------------------------------------------


def _speakers(spark, sf, rule) -> DataFrame:
    out = K.rewrite(structs(lv := talks(spark, sf)), rule, shape=lv)
    return out.select("doc_id", F.array_join(F.transform("doc.turns", lambda t: t["speaker"]), ",").alias("speakers"))


@query("SELECT conv_id AS doc_id, string_agg(role, ',' ORDER BY turn) AS speakers FROM conversations GROUP BY 1")
def rule_each(spark, sf):
    side = lambda name: W.Obj({"turns": W.Each("t", W.Part("_", W.Obj({name: V("r")})))})
    return _speakers(spark, sf, W.MapPart("_", W.MapObj(side("role"), side("speaker"))))


@query("SELECT conv_id AS doc_id, string_agg(role, ',' ORDER BY turn) AS speakers FROM conversations GROUP BY 1")
def rule_map_each(spark, sf):
    """A rule for the items of a field."""
    return _speakers(spark, sf, W.MapPart("_", W.ObjMap({"turns": W.MapEach("t", part({"role": V("r")}, {"speaker": V("r")}))})))


@query("SELECT conv_id AS doc_id, arg_max(role, turn) AS last, (count(*) - 1)::INT AS n FROM conversations GROUP BY 1")
def rule_append(spark, sf):
    rule = part({"turns": W.Append(V("head"), W.Arr(V("last")))}, {"head": V("head"), "last": V("last")})
    return ruled(talks(spark, sf), rule, last="last.role", n=F.size("doc.head"))


@query("SELECT conv_id AS doc_id, arg_min(role, turn) AS first, (count(*) - 1)::INT AS n FROM conversations GROUP BY 1")
def rule_prepend(spark, sf):
    rule = part({"turns": W.PrependOne(V("first"), V("rest"))}, {"first": V("first"), "rest": V("rest")})
    return ruled(talks(spark, sf), rule, first="first.role", n=F.size("doc.rest"))


@query("SELECT conv_id AS doc_id, bool_or(role = 'system') AS has_system, (count(*) - bool_or(role = 'system')::INT)::INT AS n FROM conversations GROUP BY 1")
def rule_arr_with(spark, sf):
    system = W.Opt("has", W.Part("sys", W.Obj({"role": "system"})))
    rule = part({"turns": W.ArrWith(V("rest"), system)}, {"system": system, "turns": V("rest")})
    return ruled(talks(spark, sf), rule, has_system=F.col("doc.system").isNotNull(), n=F.size("doc.turns"))


@query("SELECT conv_id AS doc_id, count(*) = 1 AS only FROM conversations GROUP BY 1")
def rule_one(spark, sf):
    return ruled(talks(spark, sf), part({"turns": W.One(V("t"))}, {"turn": V("t")}), only=F.col("doc.turn").isNotNull())


@query("SELECT o_orderkey AS doc_id, o_orderstatus || ',' || o_orderpriority || ',end' AS listed FROM orders")
def rule_append_arr(spark, sf):
    """Arrays of fixed length one after another."""
    rule = part({"o_orderstatus": V("a"), "o_orderpriority": V("b")}, {"listed": W.AppendArr(W.Arr(V("a")), W.Arr(V("b"), W.Is("end")))})
    return ruled(plain_orders(spark, sf), rule, listed=F.array_join("doc.listed", ","))


@query("SELECT o_orderkey AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'Statement' ELSE 'Expression,Identifier' END AS roles FROM orders")
def rule_lookup_arr(spark, sf):
    """An array chosen by a variable."""
    chosen = W.LookupArrOpVar("s", {"F": W.Roles("Statement"), None: W.Roles("Expression", "Identifier")})
    return ruled(plain_orders(spark, sf), part({"o_orderstatus": V("s")}, {"o_orderstatus": V("s"), "@role": chosen}), roles=F.array_join("doc.`@role`", ","))


# ---- roles ---------------------------------------------------------------

_KNOWN = "CASE WHEN l_returnflag = 'R' THEN 'Return' ELSE 'Body' END"


@query("SELECT event_id AS doc_id, CASE WHEN event_type = 'click' THEN 'Body' END AS roles FROM events")
def object_roles(spark, sf):
    """Roles for the object in a field of one type."""
    side = lambda *names: W.Part("_", W.Obj({"@type": "click", "props": W.ObjectRoles("p", *names)}))
    out = K.rewrite(B.event_structs(spark, sf), W.Map(side(), side("Body")))
    return out.select("doc_id", F.array_join("doc.props.`@role`", ",").alias("roles"))


@query("SELECT o_orderkey AS doc_id, count(l_orderkey)::INT AS n, coalesce(max(CASE WHEN l_orderkey IS NOT NULL THEN 'Argument,Expression' END), '') AS roles FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def each_object_roles_by_type(spark, sf):
    """Roles for all items of a list: some by their type, some always."""
    side = lambda types, *names: W.Part("_", W.Obj({"lineitems": W.EachObjectRolesByType("l", types, *names)}))
    rule = W.Map(side({}), side({"Lineitem": ["Argument"], "": []}, "Expression"))
    found = F.array_distinct(F.flatten(F.transform("doc.lineitems", lambda x: x["@role"])))
    return ruled(order_level(spark, sf), rule, n=F.size("doc.lineitems"), roles=F.array_join(found, ","))


@query("""SELECT o_orderkey AS doc_id, 'uast:Operator' AS type, o_orderstatus AS token,
CASE o_orderstatus WHEN 'F' THEN 'Add' WHEN 'O' THEN 'Substract' ELSE 'Multiply' END || ',Expression,Operator,Binary' AS roles FROM orders""")
def operator_roles(spark, sf):
    """An operator node with roles by its token."""
    table = W.StringToRolesMap({"F": ["Add"], "O": ["Substract"], "P": ["Multiply"]})
    out = ruled(plain_orders(spark, sf), part({"o_orderstatus": V("op")}, {"operator": W.Operator("op", table, "Binary")}), o="operator")
    return out.select("doc_id", F.col("o.`@type`").alias("type"), F.col("o.`@token`").alias("token"), F.array_join("o.`@role`", ",").alias("roles"))


@query("SELECT conv_id AS doc_id, 'Module' AS roles, count(*)::INT AS n FROM conversations GROUP BY 1")
def field_roles(spark, sf):
    """A type and the items of a field annotated in one rule of any depth."""
    rule = W.AnnotateType("Conversation", W.FieldRoles({"turns": W.FieldRole(arr=True, roles=["Body"])}), "Module")
    body = F.filter("doc.turns", lambda t: F.array_contains(t["@role"], "Body"))
    return ruled(talks(spark, sf), rule, roles=F.array_join("doc.`@role`", ","), n=F.size(body))


def _marked(spark, sf, when: Column, *names: str) -> DataFrame:
    """Orders of customers as node rows; those where a condition holds have roles."""
    return N.annotate_type(Trees(B.customer_level(spark, sf)).objects(), "Order", *names, where=when)


def _with_roles(nodes: DataFrame) -> DataFrame:
    return nodes.where(N.has_type("Order")).select("doc_id", N.field_text("o_orderkey").cast(_LONG).alias("o_orderkey"), F.array_join(N.roles(), ",").alias("roles"))


def _status(s: str) -> Column:
    return N.field_text("o_orderstatus") == s


@query(f"SELECT o_custkey AS doc_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Statement,Declaration' ELSE 'Unannotated' END AS roles {_ORDERS_OF}")
def annotate_type(spark, sf):
    return _with_roles(_marked(spark, sf, _status("F"), "Statement", "Declaration"))


@query(f"SELECT o_custkey AS doc_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Statement' ELSE 'Expression' END AS roles {_ORDERS_OF}")
def annotate_if_no_roles(spark, sf):
    return _with_roles(N.annotate_if_no_roles(_marked(spark, sf, _status("F"), "Statement"), "Order", "Expression"))


@query(f"SELECT o_custkey AS doc_id, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Statement,Expression' ELSE 'Expression,Statement' END AS roles {_ORDERS_OF}")
def roles_dedup(spark, sf):
    twice = N.annotate_type(_marked(spark, sf, _status("F"), "Statement", "Expression"), "Order", "Expression", "Statement", "Expression")
    return _with_roles(N.roles_dedup(twice))


@query(f"SELECT o_custkey AS doc_id, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Unannotated' WHEN 'O' THEN 'Invalid,Name' ELSE '' END AS roles {_ORDERS_OF}")
def roles_default(spark, sf):
    """Objects without roles, with an unknown one, and of the universal namespace."""
    own = _marked(spark, sf, _status("O"), "Nonsense", "Name")
    return _with_roles(own.withColumn("ns", F.when(N.has_type("Order") & _status("P"), U.NAMESPACE).otherwise(F.col("ns"))))


@query("SELECT event_id AS doc_id, CASE WHEN event_type = 'click' THEN 'Call' ELSE 'Literal' END AS roles FROM events")
def annotate_if_no_roles_rule(spark, sf):
    """The rule itself, for one type after another one has roles."""
    typ = F.when(F.col("doc.`@type`") == "click", "a").otherwise("b").alias("@type")
    own = B.event_structs(spark, sf).select("doc_id", F.struct(typ, F.col("doc.event_id")).alias("doc"))
    first = W.AnnotateType("a", None, "Call")
    both = W.Mappings(W.AnnotateIfNoRoles("a", "Name"), W.AnnotateIfNoRoles("b", "Literal"))
    out = K.rewrite(own, first, both)
    return out.select("doc_id", F.array_join("doc.`@role`", ",").alias("roles"))


@query("SELECT count(*) AS n, 118 AS roles, 'Invalid' AS first, 'Variable' AS last FROM range(118)")
def role_dimension(spark, sf):
    own = R.dimension(spark)
    return own.agg(F.count(F.lit(1)).alias("n"), F.lit(len(R.ROLES)).alias("roles"), F.min_by("name", "id").alias("first"), F.max_by("name", "id").alias("last"))


# ---- semantic nodes ------------------------------------------------------


@query("SELECT event_id AS doc_id, event_id AS \"offset\", user_id + 1 AS line, event_id + 1 AS col FROM events")
def save_positions(spark, sf):
    """Numbers of the native tree as positions."""
    own = B.event_structs(spark, sf).select("doc_id", F.struct(F.col("doc.event_id").alias("at"), (F.col("doc.user_id") + 1).alias("line"), (F.col("doc.event_id") + 1).alias("col")).alias("doc"))
    made = {"start": W.SavePosOffset("a"), "end": W.SavePosLineCol("l", "c")}
    out = K.rewrite(own, W.Map(W.Obj({"at": V("a"), "line": V("l"), "col": V("c")}), W.Obj({"@pos": W.UASTType("uast:Positions", W.Obj(made))})))
    return out.select("doc_id", F.col("doc.`@pos`.start.offset"), F.col("doc.`@pos`.end.line"), F.col("doc.`@pos`.end.col"))


@query("SELECT conv_id AS doc_id, string_agg('uast:String ' || text || ' ' || length(text), chr(10) ORDER BY turn) AS strings FROM conversations GROUP BY 1")
def uast_type(spark, sf):
    """Turns as registered nodes; fields that are not given have their zero values."""
    string = W.UASTType("uast:String", {"Value": V("t")})
    rule = W.Map(W.Part("_", W.Obj({"@type": "Turn", "text": V("t")})), W.Part("_", W.Obj({"said": string})))
    shown = lambda s: F.concat(s["@type"], F.lit(" "), s["Value"], s["Format"], F.lit(" "), F.length(s["Value"]).cast("string"))
    return ruled(talks(spark, sf), rule, strings=F.array_join(F.transform("doc.turns", lambda t: shown(t["said"])), "\n"))


@query("SELECT event_id AS doc_id, CASE WHEN event_type = 'click' THEN 'uast:Identifier' ELSE event_type END AS type, CASE WHEN event_type = 'click' THEN event_id END AS \"offset\", CASE WHEN event_type = 'click' THEN 'u' || user_id END AS name FROM events")
def map_semantic(spark, sf):
    """A native type to a registered one; its positions are carried over."""
    at = lambda c: F.struct(F.lit("uast:Position").alias("@type"), c.alias("offset"), F.lit(1).cast(_LONG).alias("line"), F.lit(1).cast(_LONG).alias("col"))
    pos = F.struct(F.lit("uast:Positions").alias("@type"), at(F.col("doc.event_id")).alias("start"), at(F.col("doc.event_id") + 1).alias("end"))
    own = B.event_structs(spark, sf).select("doc_id", F.struct(F.col("doc.`@type`"), F.concat(F.lit("u"), F.col("doc.user_id").cast("string")).alias("user"), pos.alias("@pos")).alias("doc"))
    out = K.rewrite(own, W.MapSemantic("click", "uast:Identifier", W.MapObj(W.Obj({"user": V("n")}), W.Obj({"Name": V("n")}))))
    start = F.when(F.col("doc.Name").isNotNull(), F.col("doc.`@pos`.start.offset"))
    return out.select("doc_id", F.col("doc.`@type`").alias("type"), start.alias("offset"), F.col("doc.Name").alias("name"))


@query("SELECT event_id AS doc_id, user_id, event_type AS type FROM events")
def response_metadata(spark, sf):
    """Answers that wrap the root in a single field."""
    wrapped = B.event_documents(spark, sf).select("doc_id", F.concat(F.lit('{"module":'), "doc", F.lit("}")).alias("doc"))
    out = D.rewrite(wrapped, W.ResponseMetadata())
    return out.select("doc_id", json_field("$.user_id").cast(_LONG).alias("user_id"), json_field("$.@type").alias("type"))


_COMMENT = r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract(t, '^([\s*/]*)', 1) AS prefix FROM w)
SELECT doc_id, prefix, md5('/*' || t || '*/') AS joined FROM p"""


@query(_COMMENT)
def comment_text(spark, sf):
    """Comments taken apart into variables, and put together again by the reversed rule."""
    rule = W.Map(W.Obj({"@type": "Comment", "src": W.CommentText("/*", "*/", "c")}), W.CommentNode(True, "c"))
    doc = F.struct(F.lit("Comment").alias("@type"), F.concat(F.lit("/*"), F.col("code"), F.lit("*/")).alias("src"))
    out = K.rewrite(B.source_documents(spark, sf).select("doc_id", doc.alias("doc")), rule)
    # no other shape than that of the node is left: every text is enclosed by the markers
    node = F.struct(F.lit("uast:Comment").alias("@type"), F.lit(True).alias("Block"), *(F.col(f"doc.{c}").alias(c) for c in ("Text", "Prefix", "Suffix", "Tab")))
    shape = lambda c: K.Obj({"@type": (K.Const("uast:Comment"), True), "Block": (K.Const(True), True), **{k: (K.Scalar(c[k], T.STRING), True) for k in ("Text", "Prefix", "Suffix", "Tab")}})
    back = K.rewrite(out.select("doc_id", node.alias("doc")), W.Reverse(rule), shape=shape).select("doc_id", F.md5("doc.src").alias("joined"))
    return out.select("doc_id", F.col("doc.Prefix").alias("prefix")).join(back, "doc_id")
