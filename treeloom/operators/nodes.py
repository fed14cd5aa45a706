"""The node table: one row per tree node, numbered in pre-order with subtree sizes.

``[pre, pre + size]`` is the interval of a node's subtree, so axes become
interval and equality conditions.  ``shred`` makes the table from JSON documents
in Arrow batches, without a shuffle; ``sources.relational`` makes it from flat
tables with joins and windows only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import roles as R
from ..functions import tree as T
from ..functions import uast as U

COLUMNS = {
    "doc_id": "bigint", "pre": "bigint", "size": "bigint", "level": "int", "parent": "bigint", "field": "string", "ord": "int", "kind": "int",
    "type": "string", "ns": "string", "local": "string", "token": "string", "roles": "array<string>",
    "s": "string", "i": "bigint", "u": "decimal(20,0)", "f": "double", "b": "boolean",
    "attrs": "map<string,array<string>>", "pos": "map<string,struct<offset:bigint,line:bigint,col:bigint>>",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("pre", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), ("field", pa.string()), ("ord", pa.int32()), ("kind", pa.int32()),
        ("type", pa.string()), ("ns", pa.string()), ("local", pa.string()), ("token", pa.string()), ("roles", pa.list_(pa.string())),
        ("s", pa.string()), ("i", pa.int64()), ("u", pa.decimal128(20, 0)), ("f", pa.float64()), ("b", pa.bool_()),
        ("attrs", pa.map_(pa.string(), pa.list_(pa.string()))), ("pos", pa.map_(pa.string(), pa.struct([("offset", pa.int64()), ("line", pa.int64()), ("col", pa.int64())]))),
    ]
)
NUMBERING = ("doc_id", "pre", "size", "level", "parent", "field", "ord", "kind")


def attributes(obj: dict) -> list[tuple[str, list[str]]]:
    """The attribute view of an object: scalars by key, scalar items repeated, positions spread out."""
    out: dict[str, list[str]] = {}
    for k in sorted(obj):
        v = obj[k]
        if isinstance(v, dict):
            if k == U.POS:
                for name, p in U.positions_of(obj).items():
                    out |= {f"{name}-{part}": [str(int(p[part]))] for part in (U.OFFSET, U.LINE, U.COL)}
        elif isinstance(v, list):
            name = "role" if k == U.ROLE else k
            items = [R.from_number(x) if k == U.ROLE and T.kind_of(x) == T.INT else T.to_string(x) for x in v if not isinstance(x, (dict, list))]
            if items:
                out.setdefault(name, []).extend(items)
        else:
            out.setdefault("token" if k == U.TOKEN and v is not None else k, []).append(T.to_string(v))
    return list(out.items())


_LONE = re.compile("[\ud800-\udfff]")
_DEEP = re.compile(r'[\s,:]*(?:([{}\[\]])|(")|([^\s,:{}\[\]"]+))')


def _number(s: str) -> int | float:
    """Integers above the signed range are unsigned, those beyond 64 bits floats."""
    if len(s) > 20 or not -(1 << 63) <= (i := int(s)) < 1 << 64:
        return float(s)
    return T.Uint(i) if i >= 1 << 63 else i


def _no_constant(s: str):
    raise ValueError(f"not JSON: {s}")


def _pairs(items: list) -> dict:
    out = dict(items)
    if len(out) < len(items):
        raise ValueError("repeated key")
    return out


def _deep_json(text: str) -> Any:
    """The value of valid JSON text that is nested too deep for the library's recursive reader."""
    value: Any = None
    opened: list[list] = []  # [the container, the key that waits for its value]
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _DEEP.match(text, at)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        bracket, quote, word = m.groups()
        if bracket in ("}", "]"):
            if not opened or isinstance(opened[-1][0], dict) != (bracket == "}"):
                raise ValueError(f"unexpected {bracket}")
            value = opened.pop()[0]
        elif bracket:
            opened.append([{} if bracket == "{" else [], None])
            continue
        elif quote:
            value, at = json.decoder.scanstring(text, at)
            if opened and isinstance(opened[-1][0], dict) and opened[-1][1] is None:
                if value in opened[-1][0]:
                    raise ValueError("repeated key")
                opened[-1][1] = value
                continue
        else:
            value = json.loads(word, parse_int=_number, parse_constant=_no_constant)
        if not opened:
            break
        into, key = opened[-1]
        if isinstance(into, list):
            into.append(value)
        elif key is None:
            raise ValueError("a value without a key")
        else:
            into[key], opened[-1][1] = value, None
    if opened or text[at:].strip():
        raise ValueError("not JSON")
    return value


def parse_json(text: str) -> Any:
    """A node from JSON text of any depth.  ValueError for bad text or repeated keys.

    Numbers beyond 64 bits are floats; halves of surrogate pairs become U+FFFD.
    """
    try:
        out = json.loads(text, parse_int=_number, parse_constant=_no_constant, object_pairs_hook=_pairs)
    except RecursionError:
        out = _deep_json(text)
    out = T.to_node(out)
    return _whole(out) if "\\u" in text else out


def _whole(root: Any) -> Any:
    """``root`` with lone surrogates, which have no bytes, replaced in strings and keys."""
    clean = lambda s: _LONE.sub("\ufffd", s) if isinstance(s, str) else s

    def fix(n: Any) -> tuple[Any, bool]:
        if isinstance(n, str):
            return clean(n), True
        return ({clean(k): v for k, v in n.items()}, True) if isinstance(n, dict) else (n, False)

    return T.apply(root, fix)[0]


def _long(i: Any) -> int | None:
    """An integer of a bigint column; null beyond."""
    return int(i) if -(1 << 63) <= i < 1 << 63 else None


def node_rows(doc_id: Any, root: Any) -> list[dict]:
    """All rows of one tree, in pre-order."""
    rows: list[dict] = []
    todo: list[tuple] = [(root, 0, None, None, None)]
    while todo:
        n, level, parent, field, ord_ = todo.pop()
        kind, at = T.kind_of(n), len(rows)
        row: dict = {"doc_id": doc_id, "pre": at, "size": 0, "level": level, "parent": parent, "field": field, "ord": ord_, "kind": kind}
        rows.append(row)
        if kind == T.OBJECT:
            t = U.type_of(n)
            row["type"], (row["ns"], row["local"]) = t, U.split_type(t)
            row["token"] = U.token_of(n) or None
            row["roles"] = U.roles_of(n) if n.get(U.ROLE) else None
            row["attrs"] = attributes(n)
            row["pos"] = [(k, {x: _long(p[x]) for x in (U.OFFSET, U.LINE, U.COL)}) for k, p in U.positions_of(n).items()]
            todo += [(n[k], level + 1, at, k, None) for k in sorted(n, reverse=True)]
        elif kind == T.ARRAY:
            todo += [(n[i], level + 1, at, None, i) for i in range(len(n) - 1, -1, -1)]
        elif kind != T.NIL:
            row[{T.STRING: "s", T.INT: "i", T.UINT: "u", T.FLOAT: "f", T.BOOL: "b"}[kind]] = Decimal(int(n)) if kind == T.UINT else n
    for row in reversed(rows):  # children come after their parents
        if row["parent"] is not None:
            rows[row["parent"]]["size"] += row["size"] + 1
    return rows


def _shredded(doc_id: Any, text: str) -> tuple[list[dict], str | None]:
    """(rows, error): whatever is wrong with one document is its own error."""
    try:
        return node_rows(doc_id, parse_json(text)), None
    except Exception as e:  # noqa: BLE001 - no document may end the job of all others
        return [], f"{type(e).__name__}: {e}"


def shred(trees: DataFrame, doc: str = "doc", chunk: int = 50_000) -> DataFrame:
    """The node table of (doc_id, doc): JSON documents of any depth.  Documents that can't be read
    have no rows; ``rejects`` has exactly those, with the reason.

    Joins of it are sort-merge joins, unless the other side is broadcast on purpose: Catalyst takes
    columns of a node table for as small a part of the compressed files as their width is of a row's,
    so that it would send tables of any number of documents through the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += _shredded(doc_id, text)[0] if text is not None else []
                if len(rows) >= chunk:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return trees.select(F.col("doc_id").cast("bigint"), F.col(doc).cast("string")).mapInArrow(run, SCHEMA).hint("shuffle_merge")


def rejects(trees: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc_id, doc, error): the documents that ``shred`` has no rows of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why = ["no document" if t is None else _shredded(None, t)[1] for t in b.column(1).to_pylist()]
            out = pa.RecordBatch.from_arrays([*b.columns, pa.array(why, pa.string())], ["doc_id", "doc", "error"])
            yield out.filter(out.column(2).is_valid())

    return trees.select(F.col("doc_id").cast("bigint"), F.col(doc).cast("string")).mapInArrow(run, "doc_id bigint, doc string, error string")


def fixed_list(spark: SparkSession, items: list) -> DataFrame:
    """(rank, doc): nodes that are given, in their order, as JSON documents."""
    rows = [(i, json.dumps(T.native(T.to_node(n)), ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for i, n in enumerate(items)]
    return spark.createDataFrame(rows, "rank bigint, doc string")


# ---- traversal -----------------------------------------------------------


def unique_key() -> Column:
    """A key for grouping, equal exactly for the same scalars; composites are told apart by their place."""
    composite = F.col("kind").isin(T.OBJECT, T.ARRAY)
    place = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pre").cast("string"))
    return F.struct(F.col("kind").alias("kind"), F.when(composite, place).otherwise(scalar_text()).alias("key"))


def scalar_text(prefix: str = "") -> Column:
    """Text of a scalar row; nil is empty; null for composites."""
    c = lambda n: F.col(prefix + n)
    return (
        F.when(c("kind") == T.NIL, "").when(c("kind") == T.STRING, c("s")).when(c("kind") == T.INT, c("i").cast("string"))
        .when(c("kind") == T.UINT, c("u").cast("string")).when(c("kind") == T.FLOAT, float_text(c("f"))).when(c("kind") == T.BOOL, c("b").cast("string"))
    )


def float_text(c: Column) -> Column:
    """Shortest digits of a double; integral ones without a point; an exponent below 1e-4 and, unless integral, from 1e6 on."""
    s = c.cast("string")
    digits = F.regexp_replace(F.abs(c).cast("string"), r"\.", "")
    sign = F.when(c < 0, "-").otherwise("")
    whole = (c == F.floor(c)) & (F.abs(c) < 9e18)
    million = F.concat(sign, F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 30), F.lit("e+06"))
    large = F.regexp_replace(F.regexp_replace(s, r"E(\d)$", "e+0$1"), r"E(\d+)$", "e+$1")
    tenth = F.regexp_replace(F.regexp_replace(s, r"E-(\d)$", "e-0$1"), r"E-(\d+)$", "e-$1")
    small = F.when(F.abs(c) >= 1e-4, F.concat(sign, F.lit("0.000"), F.regexp_replace(F.regexp_replace(F.abs(c).cast("string"), r"E.*$", ""), r"\.0$|\.", ""))).otherwise(F.regexp_replace(tenth, r"\.0e", "e"))
    return F.when(whole, c.cast("bigint").cast("string")).when(F.abs(c) >= 1e7, large).when(F.abs(c) >= 1e6, million).when(F.abs(c) < 1e-3, small).otherwise(s)


def order_columns(order: str = T.PRE) -> list[Column]:
    """Sort columns after doc_id.  In post-order a node's rank is pre + size - level."""
    return {T.PRE: [F.col("pre")], T.POST: [F.col("pre") + F.col("size") - F.col("level")], T.LEVEL: [F.col("level"), F.col("pre")]}[order]


def ranked(nodes: DataFrame, order: str = T.PRE) -> DataFrame:
    """Not-nil nodes with ``rank``, their place in an order.

    In documents without nils pre- and post-order ranks are arithmetic on the row
    itself, so such a document is spread over any number of tasks; where nils are
    left out, and by level, a window per document counts.
    """
    own = nodes.where(F.col("kind") != T.NIL)
    counted = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order_columns(order))) - 1)
    if order == T.LEVEL:
        return counted(own)
    place = F.col("pre") if order == T.PRE else F.col("pre") + F.col("size") - F.col("level")
    holes = nodes.where(F.col("kind") == T.NIL).select("doc_id").distinct()
    whole = own.join(holes, "doc_id", "left_anti").withColumn("rank", place.cast("int"))
    return whole.unionByName(counted(own.join(holes, "doc_id", "left_semi")))


def object_parents(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, obj): for each object the nearest object above it (null if there is none).

    Chains of arrays in arrays are halved by pointer jumping, in as many joins as the
    logarithm of the deepest one's level; plain trees need one join.
    """
    arrays = nodes.where(F.col("kind") == T.ARRAY)
    deepest = arrays.where(F.col("ord").isNotNull()).agg(F.max("level")).first()[0]
    kinds = nodes.where(F.col("kind").isin(T.OBJECT, T.ARRAY)).select("doc_id", F.col("pre").alias("up"), F.col("kind").alias("above"))
    if deepest is None:  # arrays stand in objects or at the root
        lists = arrays.select("doc_id", F.col("pre").alias("up"), F.col("parent").alias("obj"))
    else:
        # (up, obj, open): an array, what it leads to, and whether that is an array again
        lists = arrays.select("doc_id", F.col("pre").alias("list"), F.col("parent").alias("up")).join(kinds, ["doc_id", "up"], "left")
        lists = lists.select("doc_id", F.col("list").alias("up"), F.col("up").alias("obj"), (F.coalesce(F.col("above"), F.lit(0)) == T.ARRAY).alias("open"))
        for _ in range(int(deepest).bit_length()):
            onward = lists.select("doc_id", F.col("up").alias("obj"), F.col("obj").alias("next"), F.col("open").alias("more"))
            met = lists.join(onward, ["doc_id", "obj"], "left")
            goes = F.col("open") & F.col("more").isNotNull()
            lists = met.select("doc_id", "up", F.when(goes, F.col("next")).otherwise(F.col("obj")).alias("obj"), F.when(goes, F.col("more")).otherwise(F.lit(False)).alias("open"))
        lists = lists.select("doc_id", "up", "obj")
    objects = nodes.where(F.col("kind") == T.OBJECT).select("doc_id", "pre", F.col("parent").alias("up"))
    lists = lists.withColumnRenamed("obj", "through").withColumn("listed", F.lit(True))
    return objects.join(lists, ["doc_id", "up"], "left").select("doc_id", "pre", F.when(F.col("listed"), F.col("through")).otherwise(F.col("up")).alias("obj"))


def children_counts(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, n) of composites: items of an array; an object's object fields and items of its array fields."""
    kids = nodes.select("doc_id", F.col("parent").alias("pre"), "kind", F.col("pre").alias("kid")).where("pre is not null")
    items = kids.groupBy("doc_id", F.col("pre").alias("arr")).agg(F.count(F.lit(1)).alias("items"))
    arrays = kids.where(F.col("kind") == T.ARRAY).join(items.withColumnRenamed("arr", "kid"), ["doc_id", "kid"], "left").groupBy("doc_id", "pre").agg(F.sum(F.coalesce("items", F.lit(0))).alias("listed"))
    direct = kids.where(F.col("kind") == T.OBJECT).groupBy("doc_id", "pre").agg(F.count(F.lit(1)).alias("direct"))
    own = nodes.where(F.col("kind").isin(T.OBJECT, T.ARRAY)).select("doc_id", "pre", "kind")
    out = own.join(items.withColumnRenamed("arr", "pre"), ["doc_id", "pre"], "left").join(arrays, ["doc_id", "pre"], "left").join(direct, ["doc_id", "pre"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("doc_id", "pre", F.when(F.col("kind") == T.ARRAY, zero("items")).otherwise(zero("direct") + zero("listed")).cast("bigint").alias("n"))


def counts(nodes: DataFrame, mask: int = T.ANY) -> DataFrame:
    """(doc_id, n): nodes whose kind is in ``mask``."""
    return nodes.groupBy("doc_id").agg(F.count_if(F.col("kind").bitwiseAND(F.lit(mask)) != 0).alias("n"))


def kind_names() -> Column:
    return reduce(lambda c, k: c.when(F.col("kind") == k, T.KIND_NAMES[k]), list(T.KIND_NAMES)[1:], F.when(F.col("kind") == T.NIL, "Nil"))


def pruned(nodes: DataFrame, stop: Column) -> DataFrame:
    """Nodes that are not strictly below a node where ``stop`` holds: in pre-order, those beyond the
    last node of every stopped subtree that began before them.  One sort per document, no join."""
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max(F.when(stop, F.col("pre") + F.col("size"))).over(before)
    return nodes.withColumn("_covered", covered).where(F.coalesce(F.col("pre") > F.col("_covered"), F.lit(True))).drop("_covered")


def subtrees(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, top, ...): all nodes of the subtrees whose tops are (doc_id, pre, size)."""
    own = tops.select("doc_id", F.col("pre").alias("top"), (F.col("pre") + F.col("size")).alias("last"))
    return nodes.join(own, "doc_id").where((F.col("pre") >= F.col("top")) & (F.col("pre") <= F.col("last"))).drop("last")


def canonical(fields: bool = True) -> Column:
    """A node row as text that is equal exactly for equal nodes apart from what is below them.
    Signed and unsigned integers differ, as they do in content hashes."""
    value = F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("u").cast("string"), F.hex(F.col("f").cast("string")), F.col("b").cast("string"), F.lit(""))
    return F.concat_ws("\x1f", F.col("level").cast("string"), F.coalesce("field", F.lit("\x1d")), F.coalesce(F.col("ord").cast("string"), F.lit("\x1d")), F.col("kind").cast("string"), value)


def _lanes(text: Column) -> list[Column]:
    """A text as four 64-bit hashes with unlike beginnings: 256 bits that xor like one number."""
    return [F.xxhash64(F.lit(i), text) for i in range(4)]


def _mixed(lanes: list[str]) -> Column:
    return F.concat(*(F.lpad(F.hex(F.coalesce(F.col(c), F.lit(0).cast("bigint"))), 16, "0") for c in lanes))


_LANES = ["_l0", "_l1", "_l2", "_l3"]


def hashes(nodes: DataFrame, drop_positions: bool = False) -> DataFrame:
    """(doc_id, hash) of whole documents: the 256-bit hashes of all rows with their place, xored.

    Equal exactly for equal trees.  With ``drop_positions`` what is below a position
    field does not count, though the field itself does.  No document is gathered in
    one row: the aggregate is partial on the map side.
    """
    rows, own, place = nodes, canonical(), F.col("pre")
    if drop_positions:
        own = F.when(F.col("field") == U.POS, F.lit("\x1c")).otherwise(canonical())
        rows = pruned(nodes, F.col("field") == U.POS)
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")))
        place = F.col("_place")
    lanes = _lanes(F.concat_ws("\x1e", place.cast("string"), own))
    return rows.groupBy("doc_id").agg(*(F.bit_xor(x).alias(n) for x, n in zip(lanes, _LANES, strict=True))).select("doc_id", F.sha2(_mixed(_LANES), 256).alias("hash"))


#: Nodes of a document that are folded in one go.
_PART = 1 << 16
_FOLDED = "doc_id bigint, part bigint, pre bigint, last bigint, parent bigint, step string, own string, below binary, hash string"


def _fold(rows: DataFrame) -> DataFrame:
    """(doc_id, part, pre, last, parent, step, own, below) with ``hash``: digests of the nodes whose subtrees
    end within their part, null for what is left to a larger part: nodes that go on beyond it, with what
    ``below`` them is known, and, with a null ``own``, what nodes before the part get from it.

    A part is read backwards, so that all nodes below a node come before it; at any time there is
    one number for each node that is waited for, which are as many as the part is deep.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int64()), ("pre", pa.int64()), ("last", pa.int64()), ("parent", pa.int64()), ("step", pa.string()), ("own", pa.string()), ("below", pa.binary()), ("hash", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, number = hashlib.sha256, int.from_bytes
        at, waited = None, {}
        out: list[tuple] = []
        to_parents = lambda: [(*at, k, None, None, None, None, v.to_bytes(32), None) for k, v in waited.items()] if at else []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for doc_id, part, pre, last, parent, step, own, below in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (doc_id, part):
                    out += to_parents()
                    at, waited = (doc_id, part), {}
                known = waited.pop(pre, 0) ^ number(below) if below else waited.pop(pre, 0)
                if own is None:
                    waited[pre] = known
                elif part is not None and last // _PART > part:
                    out.append((doc_id, part, pre, last, parent, step, own, known.to_bytes(32), None))
                else:
                    digest = sha(own.encode() + known.to_bytes(32))
                    out.append((doc_id, part, pre, None, None, None, None, None, digest.hexdigest()))
                    if parent is not None:
                        waited[parent] = waited.get(parent, 0) ^ number(sha(step.encode() + digest.digest()).digest())
            if out:
                yield batch()
                out = []
        if out := to_parents():
            yield batch()

    dealt = rows.select("doc_id", "part", "pre", "last", "parent", "step", "own", "below").repartition("doc_id", "part")
    return dealt.sortWithinPartitions("doc_id", "part", F.desc("pre"), F.col("own").isNotNull()).mapInArrow(run, _FOLDED)


def subtree_hashes(nodes: DataFrame, drop_positions: bool = False) -> DataFrame:
    """(doc_id, pre, hash) of every node: its own kind and value with the hashes of its children.

    Documents are folded from their ends in parts of ``_PART`` nodes, and then what is open at the
    bounds of parts, a path from the root each, by document.  The node table is read once and the plan
    has the same size for trees of any depth.  A parent's digest has those of its children, tagged with
    their field or place and xored.  Equal exactly for equal subtrees, wherever they stand.
    """
    value = F.coalesce(F.col("s"), F.col("i").cast("string"), F.col("u").cast("string"), F.hex(F.col("f").cast("string")), F.col("b").cast("string"), F.lit(""))
    rows = nodes
    if drop_positions:
        rows = pruned(nodes, F.col("field") == U.POS)
        value = F.when(F.col("field") == U.POS, F.lit("")).otherwise(value)
    kind = F.when(F.col("field") == U.POS, F.lit(0)).otherwise(F.col("kind")) if drop_positions else F.col("kind")
    own = F.concat_ws("\x1f", kind.cast("string"), value)
    own = F.when(F.length(own) > 64, F.concat(F.lit("#"), F.sha2(own, 256))).otherwise(own)  # long values don't travel; others begin with a kind
    step = F.coalesce("field", F.col("ord").cast("string"), F.lit(""))
    part, last = F.floor(F.col("pre") / F.lit(_PART)).alias("part"), (F.col("pre") + F.col("size")).alias("last")
    folded = _fold(rows.select("doc_id", part, "pre", last, "parent", step.alias("step"), own.alias("own"), F.lit(None).cast("binary").alias("below")))
    rest = _fold(folded.where(F.col("hash").isNull()).withColumn("part", F.lit(None).cast("bigint")))
    return folded.where(F.col("hash").isNotNull()).select("doc_id", "pre", "hash").unionByName(rest.where(F.col("hash").isNotNull()).select("doc_id", "pre", "hash"))


# ---- tokens, roles, positions --------------------------------------------


def tokens(nodes: DataFrame) -> DataFrame:
    """(doc_id, tokens): non-empty object tokens in pre-order."""
    own = nodes.where((F.col("kind") == T.OBJECT) & (F.col("token") != ""))
    return own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "token"))), lambda x: x["token"]).alias("tokens"))


def contents(nodes: DataFrame) -> DataFrame:
    """Object rows with ``content``: the content field of their type, however deep that leads - empty
    if it is absent - and of types without one the token."""
    name = reduce(lambda c, kv: c.when(F.col("type") == kv[0], kv[1]), U.CONTENT.items(), F.when(F.lit(False), ""))
    own = nodes.where(F.col("kind") == T.OBJECT).withColumn("_field", name)
    scalar = F.try_element_at(F.try_element_at("attrs", F.coalesce("_field", F.lit(""))), F.lit(1))
    plain = own.withColumn("content", F.when(F.col("_field").isNull(), F.coalesce("token", F.lit(""))).otherwise(F.coalesce(scalar, F.lit(""))))
    # objects in a content field: (doc_id, pre, to), which further links shorten by pointer jumping;
    # as many as there may be documents, so never broadcast by an estimate (a join forgets the hint of ``shred``)
    inner = nodes.where(F.col("kind") == T.OBJECT).select("doc_id", F.col("parent").alias("pre"), "field", F.col("pre").alias("to"))
    links = inner.join(own.select("doc_id", "pre", F.col("_field").alias("field")), ["doc_id", "pre", "field"]).select("doc_id", "pre", "to").hint("shuffle_merge")
    deepest = links.join(own.select("doc_id", "pre", "level"), ["doc_id", "pre"]).agg(F.max("level")).first()[0]
    if deepest is None:
        return plain.drop("_field")
    for _ in range(int(deepest + 1).bit_length()):
        onward = links.select("doc_id", F.col("pre").alias("to"), F.col("to").alias("next"))
        links = links.join(onward, ["doc_id", "to"], "left").select("doc_id", "pre", F.coalesce("next", "to").alias("to")).hint("shuffle_merge")
    led = links.join(plain.select("doc_id", F.col("pre").alias("to"), F.col("content").alias("_led")), ["doc_id", "to"]).select("doc_id", "pre", "_led")
    return plain.join(led, ["doc_id", "pre"], "left").withColumn("content", F.coalesce("_led", "content")).drop("_field", "_led")


# ---- fields --------------------------------------------------------------


def keys(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, keys): the field names of each object, sorted.  Objects without fields have no row."""
    own = nodes.where(F.col("field").isNotNull())
    return own.groupBy("doc_id", F.col("parent").alias("pre")).agg(F.array_sort(F.collect_list("field")).alias("keys"))


def value_at(nodes: DataFrame, among: DataFrame, step: str | int) -> DataFrame:
    """Rows of the children of ``among`` (doc_id, pre) in a field or at a place."""
    own = nodes.where((F.col("field") == step) if isinstance(step, str) else (F.col("ord") == step))
    return own.join(among.select("doc_id", F.col("pre").alias("parent")), ["doc_id", "parent"], "left_semi").select(*nodes.columns)


def field_of(nodes: DataFrame, name: str, kinds: int) -> DataFrame:
    """(doc_id, pre, child, text, wrong): of every object the node in a field, its text if it is a scalar,
    and whether it is of another kind than asked for.  Objects without the field have no row."""
    own = nodes.where(F.col("field") == name)
    good = F.col("kind").bitwiseAND(F.lit(kinds)) != 0
    return own.select("doc_id", F.col("parent").alias("pre"), F.col("pre").alias("child"), F.when(good, scalar_text()).alias("text"), (~good).alias("wrong"))


def roles() -> Column:
    """Roles of an object row: unknown names are Invalid; objects of other namespaces without roles are Unannotated."""
    known = F.transform("roles", lambda r: F.when(r.isin(R.ROLES), r).otherwise(R.INVALID))
    bare = F.coalesce(F.size("roles"), F.lit(0)) == 0
    free = (F.col("type") != "") & (F.col("ns") != U.NAMESPACE)
    return F.when(~bare, known).when(free, F.array(F.lit(R.UNANNOTATED))).otherwise(F.array().cast("array<string>"))


def position_valid(p: Column) -> Column:
    return p.isNotNull() & ((p["offset"] != 0) | (p["line"] != 0) | (p["col"] != 0))


def position_order(p: Column) -> Column:
    """Sort key of positions: valid ones first, by offset (0 counts at line 1, column 1), else by line and column."""
    has = (p["offset"] != 0) | ((p["line"] == 1) & (p["col"] == 1))
    zero = F.lit(0).cast("bigint")
    late = lambda c: F.when(c == 0, F.lit(1 << 32)).otherwise(c)
    key = lambda last, offset, line, col: F.struct(F.lit(last).alias("last"), offset.alias("offset"), line.alias("line"), col.alias("col"))
    placed = F.when(has, key(0, p["offset"], zero, zero)).otherwise(key(0, zero, late(p["line"]), late(p["col"])))
    return F.when(position_valid(p), placed).otherwise(key(1, zero, zero, zero))


def positional(nodes: DataFrame) -> DataFrame:
    """Objects that are not positions, with ``rank`` by start position (unpositioned last, ties by pre)."""
    own = nodes.where((F.col("kind") == T.OBJECT) & ~F.col("type").isin(f"{U.NAMESPACE}:Position", f"{U.NAMESPACE}:Positions"))
    start = F.try_element_at("pos", F.lit(U.START))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(position_order(start), "pre")) - 1)


def import_paths(trees: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc_id, paths, error): distinct sorted paths of import nodes, aliases followed, names joined
    with "/"; null with the reason where a document can't be read."""

    def paths(text: str) -> tuple[list[str] | None, str | None]:
        try:
            return U.import_paths(parse_json(text)), None
        except Exception as e:  # noqa: BLE001 - no document may end the job of all others
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [paths(t) if t else ([], None) for t in b.column(1).to_pylist()]
            columns = [pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "paths", "error"])

    return trees.select(F.col("doc_id").cast("bigint"), F.col(doc)).mapInArrow(run, "doc_id bigint, paths array<string>, error string")


# ---- rules on rows (no rebuild of the tree) ------------------------------


def annotate_type(nodes: DataFrame, typ: str, *names: str, where: Column | None = None) -> DataFrame:
    """Appends roles to objects of a type; codegen only."""
    hit = (F.col("kind") == T.OBJECT) & (F.col("type") == typ)
    hit = hit if where is None else hit & where
    more = F.array(*(F.lit(n) for n in names))
    return nodes.withColumn("roles", F.when(hit, F.concat(F.coalesce("roles", F.array().cast("array<string>")), more)).otherwise(F.col("roles")))


def annotate_if_no_roles(nodes: DataFrame, typ: str, *names: str) -> DataFrame:
    return annotate_type(nodes, typ, *names, where=F.col("roles").isNull())


def roles_dedup(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("roles", F.array_distinct("roles"))


def default_namespace(nodes: DataFrame, ns: str) -> DataFrame:
    bare = (F.col("kind") == T.OBJECT) & (F.col("type") != "") & ~F.col("type").contains(":")
    return nodes.withColumns({"type": F.when(bare, F.concat(F.lit(f"{ns}:"), "type")).otherwise(F.col("type")), "ns": F.when(bare, F.lit(ns)).otherwise(F.col("ns"))})


def has_type(typ: str) -> Column:
    return (F.col("kind") == T.OBJECT) & (F.col("type") == typ)


def has_field(name: str) -> Column:
    """An object with a scalar field of that name (or scalar items in it)."""
    return F.col("attrs")[name].isNotNull()


def field_text(name: str) -> Column:
    return F.get(F.col("attrs")[name], F.lit(0))


def forbidden_types(nodes: DataFrame, types: list[str]) -> DataFrame:
    """(local, n): how often each type of the list occurs, namespaces aside."""
    return nodes.where((F.col("kind") == T.OBJECT) & F.col("local").isin(types)).groupBy("local").agg(F.count(F.lit(1)).alias("n"))
