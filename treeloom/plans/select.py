"""Selectors of the rewrite algebra as plans over node tables.

A selector that looks at a node becomes a filter; one that looks at its fields or
items becomes a semi- or anti-join with the child rows on ``(doc_id, parent)``, so
rows are never multiplied and no tree is rebuilt.  The result is the same as the
interpreter's on every node.

Every level of a selector reads the node table once more, so it should be one that
is written (or at least cheap to make), as for path queries of many steps.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tree as T
from ..operators import rewrite as W


class NotColumnar(TypeError):
    """The selector binds variables or compares with a composite constant; use ``pipeline.matching``."""


def scalar_is(value: Any) -> Column:
    """A row that equals a constant: a scalar, nil, or an empty object or array."""
    kind = T.kind_of(value)
    own = F.col("kind") == kind
    if kind == T.NIL:
        return own
    if kind in (T.OBJECT, T.ARRAY):
        if value:
            raise NotColumnar("composite constants")
        return own & (F.col("size") == 0)
    if kind in (T.INT, T.UINT):
        number = F.lit(int(value)).cast("decimal(20,0)")
        return F.col("kind").isin(T.INT, T.UINT) & F.coalesce(F.coalesce(F.col("i").cast("decimal(20,0)"), F.col("u")) == number, F.lit(False))
    column = {T.STRING: "s", T.FLOAT: "f", T.BOOL: "b"}[kind]
    return own & F.coalesce(F.col(column) == F.lit(value), F.lit(False))


def _same_kind(value: Any) -> Column:
    return (F.col("kind") == T.kind_of(value)) & scalar_is(value)


def condition(sel: W.Sel) -> Column | None:
    """The selector as a condition on the row alone; None if it looks below."""
    if type(sel) is W.Is:
        return scalar_is(sel.value)
    if isinstance(sel, W.OfKind):
        return F.col("kind").bitwiseAND(F.lit(sel.kinds)) != 0
    if isinstance(sel, W.In):
        parts = [_same_kind(T.Uint(v) if kind == T.UINT else v) for kind, v in sel.values]
        return reduce(lambda a, b: a | b, parts, F.lit(False))
    if isinstance(sel, W.Not):
        inner = condition(sel.sel)
        if inner is None:
            return None
        return ~inner if not isinstance(sel, W.ObjNot) else (F.col("kind") == T.OBJECT) & ~inner
    if isinstance(sel, W.And):
        parts = [condition(s) for s in sel.sels]
        return None if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts, F.lit(True))
    if isinstance(sel, W.AnyNode):
        return F.lit(True)
    return None


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col("doc_id").alias("_d"), F.col(key).alias("_p"))


def _join(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    return rows.join(keys, (rows["doc_id"] == keys["_d"]) & (rows["pre"] == keys["_p"]), how)


def select(nodes: DataFrame, sel: W.Sel, among: DataFrame | None = None) -> DataFrame:
    """The rows of ``among`` (all of ``nodes`` unless given) for which a selector holds."""
    rows = nodes if among is None else among
    own = condition(sel)
    if own is not None:
        return rows.where(own)
    if isinstance(sel, W.And):
        return reduce(lambda r, s: select(nodes, s, r), sel.sels, rows)
    if isinstance(sel, W.Not):
        base = rows.where(F.col("kind") == T.OBJECT) if isinstance(sel, W.ObjNot) else rows
        return _join(base, _keys(select(nodes, sel.sel, rows), "pre"), "left_anti")
    if isinstance(sel, W.Has):
        rows = rows.where(F.col("kind") == T.OBJECT)
        for name, inner in sel.fields.items():
            rows = _join(rows, _keys(select(nodes, inner, nodes.where(F.col("field") == name)), "parent"), "left_semi")
        return rows
    if isinstance(sel, W.HasFields):
        rows = rows.where(F.col("kind") == T.OBJECT)
        for name, there in sel.fields.items():
            rows = _join(rows, _keys(nodes.where(F.col("field") == name), "parent"), "left_semi" if there else "left_anti")
        return rows
    if isinstance(sel, W.AnyElem):
        rows, items = rows.where(F.col("kind") == T.ARRAY), nodes.where(F.col("ord").isNotNull())
        if isinstance(sel, W.All):  # no item that does not match
            return _join(rows, _keys(select(nodes, W.Not(sel.sel), items), "parent"), "left_anti")
        return _join(rows, _keys(select(nodes, sel.sel, items), "parent"), "left_semi")
    raise NotColumnar(type(sel).__name__)
