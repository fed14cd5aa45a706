"""Node tables of trees that are spread over flat tables, with joins and windows only.

Sizes are added up from the leaves, numbers handed down from the roots; every
join is an equi-join on the parent's key.  Rows come from one branch per type and
field, whose names are literals: a query that asks for one name leaves the other
branches out of the plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tree as T
from ..functions import uast as U
from ..operators.nodes import COLUMNS, float_text

_KINDS = {"string": (T.STRING, "s"), "bigint": (T.INT, "i"), "int": (T.INT, "i"), "double": (T.FLOAT, "f"), "boolean": (T.BOOL, "b")}


@dataclass
class Level:
    """Objects of one type: a table, its key, the scalars to keep, and child levels by field name."""

    type: str
    rows: DataFrame
    key: str
    scalars: list[str]
    parent: str = ""
    order: list[str] = field(default_factory=list)
    children: dict[str, Level] = field(default_factory=dict)

    def fields(self) -> list[str]:
        return sorted([U.TYPE, *self.scalars, *self.children])


def timestamp_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def _text(name: str, kind: str) -> Column:
    text = float_text(F.col(name)) if kind == "double" else F.col(name).cast("string")
    return F.coalesce(text, F.lit(""))


def _sized(level: Level) -> DataFrame:
    df = level.rows
    for name, kid in level.children.items():
        below = _sized(kid).groupBy(F.col(kid.parent).alias(level.key)).agg(F.sum(F.col("_size") + 1).alias(f"_sum_{name}"))
        df = df.join(below, level.key, "left").withColumn(f"_sum_{name}", F.coalesce(f"_sum_{name}", F.lit(0)))
    size = reduce(lambda a, b: a + b, [F.col(f"_sum_{n}") + 1 for n in level.children], F.lit(1 + len(level.scalars)))
    return df.withColumn("_size", size.cast("bigint"))


def _offset(level: Level, name: str) -> Column:
    out = F.lit(1)
    for f in level.fields():
        if f == name:
            return out.cast("bigint")
        out = out + 1 + (F.col(f"_sum_{f}") if f in level.children else F.lit(0))
    raise KeyError(name)


@dataclass(frozen=True)
class Branch:
    """Rows of one place in the trees: the objects of a level, a list of children, or a scalar field."""

    path: tuple[str, ...]  # field names of the lists that lead to the level
    kind: str  # object, array, scalar
    field: str = ""  # of arrays and scalars
    type: str = ""  # of objects


class Trees:
    """The trees below a root level, as branches that are planned only when they are asked for.

    The branches with their parents are a structural summary of all trees, from
    which a path query knows beforehand where its steps can lead.
    """

    def __init__(self, root: Level):
        self.root = root
        self._frames: dict[tuple[str, ...], DataFrame] = {}
        self._rows: dict[Branch, DataFrame] = {}
        self.branches: list[Branch] = []
        self.parent: dict[Branch, Branch | None] = {}
        self._summarise(root, (), None)

    def _summarise(self, level: Level, path: tuple[str, ...], above: Branch | None) -> None:
        own = Branch(path, "object", type=level.type)
        self._add(own, above)
        for f in [U.TYPE, *level.scalars]:
            self._add(Branch(path, "scalar", f), own)
        for name, kid in level.children.items():
            items = Branch(path, "array", name)
            self._add(items, own)
            self._summarise(kid, (*path, name), items)

    def _add(self, b: Branch, above: Branch | None) -> None:
        self.branches.append(b)
        self.parent[b] = above

    def level(self, path: tuple[str, ...]) -> Level:
        out = self.root
        for name in path:
            out = out.children[name]
        return out

    def frame(self, path: tuple[str, ...]) -> DataFrame:
        """Sized rows of a level with _doc, _pre, _level, _parent, _ord."""
        if path in self._frames:
            return self._frames[path]
        if not path:
            null = F.lit(None)
            own = _sized(self.root).withColumns({"_doc": F.col(self.root.key).cast("bigint"), "_pre": F.lit(0).cast("bigint"), "_level": F.lit(0), "_parent": null.cast("bigint"), "_ord": null.cast("int")})
        else:
            above, name = self.level(path[:-1]), path[-1]
            kid = above.children[name]
            up = self.frame(path[:-1]).select(F.col(above.key).alias("_up"), "_doc", (F.col("_pre") + _offset(above, name)).alias("_parent"), (F.col("_level") + 2).alias("_level"))
            own = _sized(kid)
            among = Window.partitionBy(kid.parent).orderBy(*(kid.order or [kid.key]))
            own = own.withColumn("_ord", F.row_number().over(among) - 1)
            before = F.coalesce(F.sum(F.col("_size") + 1).over(among.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if kid.children else F.col("_ord") * (F.col("_size") + 1)
            own = own.withColumn("_before", before)
            own = own.join(up, own[kid.parent] == up["_up"]).drop("_up").withColumn("_pre", F.col("_parent") + 1 + F.col("_before"))
        self._frames[path] = own
        return own

    def rows(self, b: Branch) -> DataFrame:
        """The node table of one branch; names and types are literals."""
        if b not in self._rows:
            own = self._columns(b)
            self._rows[b] = self.frame(b.path).select(
                # a cast around the map would hide its entries from the optimizer
                *((own[name] if name == "attrs" and name in own else (own[name] if name in own else F.lit(None)).cast(kind)).alias(name) for name, kind in COLUMNS.items())
            )
        return self._rows[b]

    def _columns(self, b: Branch) -> dict[str, Column]:
        level = self.level(b.path)
        kinds = {f.name: f.dataType.simpleString() for f in level.rows.schema.fields}
        if b.kind == "object":
            ns, local = U.split_type(level.type)
            attrs = [x for k in sorted([U.TYPE, *level.scalars]) for x in (F.lit(k), F.array(F.lit(level.type) if k == U.TYPE else _text(k, kinds[k])))]
            return {
                "doc_id": F.col("_doc"), "pre": F.col("_pre"), "size": F.col("_size"), "level": F.col("_level"), "parent": F.col("_parent"), "ord": F.col("_ord"),
                "kind": F.lit(T.OBJECT), "type": F.lit(level.type), "ns": F.lit(ns), "local": F.lit(local), "attrs": F.create_map(*attrs),
            }
        own = {"doc_id": F.col("_doc"), "pre": F.col("_pre") + _offset(level, b.field), "level": F.col("_level") + 1, "parent": F.col("_pre"), "field": F.lit(b.field)}
        if b.kind == "array":
            return own | {"size": F.col(f"_sum_{b.field}"), "kind": F.lit(T.ARRAY)}
        if b.field == U.TYPE:
            return own | {"size": F.lit(0), "kind": F.lit(T.STRING), "s": F.lit(level.type)}
        c = b.field
        kind, col = _KINDS[kinds[c]]
        value: dict[str, Column] = {col: F.col(c)}
        is_kind = F.lit(kind)
        if kind == T.FLOAT:  # integral numbers are integers
            whole = (F.col(c) == F.floor(c)) & (F.abs(c) < 9e18)
            value = {"i": F.when(whole, F.col(c).cast("bigint")), "f": F.when(~whole, F.col(c))}
            is_kind = F.when(whole, F.lit(T.INT)).otherwise(F.lit(T.FLOAT))
        return own | {"size": F.lit(0), "kind": F.when(F.col(c).isNull(), F.lit(T.NIL)).otherwise(is_kind)} | value

    def values(self, b: Branch) -> dict[str, Column]:
        """Columns of a branch's nodes that need no numbers, over the rows of its level."""
        return {k: v for k, v in self._columns(b).items() if k not in ("doc_id", "pre", "size", "level", "parent", "ord")}

    def table(self) -> DataFrame:
        """All nodes, one branch after another."""
        return reduce(DataFrame.unionByName, map(self.rows, self.branches))

    def composites(self) -> DataFrame:
        """Objects and arrays only."""
        return reduce(DataFrame.unionByName, [self.rows(b) for b in self.branches if b.kind != "scalar"])

    def objects(self, *types: str) -> DataFrame:
        """Objects of some types, or of all."""
        return reduce(DataFrame.unionByName, [self.rows(b) for b in self.branches if b.kind == "object" and (not types or b.type in types)])


def node_table(root: Level) -> DataFrame:
    """All nodes of the trees below ``root``; its key is the document id."""
    return Trees(root).table()


def structs(root: Level) -> DataFrame:
    """(doc_id, doc): the same trees as nested structs; types are constants and left out."""

    def nested(level: Level) -> DataFrame:
        df = level.rows
        for name, kid in level.children.items():
            sub = nested(kid).groupBy(F.col(kid.parent).alias(level.key)).agg(F.transform(F.array_sort(F.collect_list(F.struct(*(kid.order or [kid.key]), "_doc"))), lambda x: x["_doc"]).alias(f"_kids_{name}"))
            df = df.join(sub, level.key, "left")
        cols = [*(F.col(c) for c in level.scalars), *(F.coalesce(f"_kids_{n}", F.array()).alias(n) for n in level.children)]
        return df.withColumn("_doc", F.struct(*cols))

    return nested(root).select(F.col(root.key).cast("bigint").alias("doc_id"), F.col("_doc").alias("doc"))


def documents(root: Level) -> DataFrame:
    """(doc_id, doc): the same trees as JSON documents."""

    def nested(level: Level) -> DataFrame:
        df = level.rows
        for name, kid in level.children.items():
            sub = nested(kid).groupBy(F.col(kid.parent).alias(level.key)).agg(F.transform(F.array_sort(F.collect_list(F.struct(*(kid.order or [kid.key]), "_doc"))), lambda x: x["_doc"]).alias(f"_kids_{name}"))
            df = df.join(sub, level.key, "left")
        cols = [F.lit(level.type).alias(U.TYPE), *(F.col(c) for c in level.scalars), *(F.coalesce(f"_kids_{n}", F.array()).alias(n) for n in level.children)]
        return df.withColumn("_doc", F.struct(*cols))

    return nested(root).select(F.col(root.key).cast("bigint").alias("doc_id"), F.to_json("_doc", {"ignoreNullFields": "false"}).alias("doc"))
