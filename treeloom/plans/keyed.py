"""Path queries over relational trees by their keys, without numbering any node.

Where a query asks for values and goes up and down only, the structural summary says
which levels a step connects, and a step between levels is a join of a child table's
foreign key with its parent's key; steps within a level are projections.  Filters,
semi- and anti-joins and counts are on keys, too, so the plan holds the tables a path
touches and nothing else: no sizes, windows or places.  What needs document order,
positions or siblings is refused with ``NotKeyed`` and planned with numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.nodes import scalar_text
from ..sources.relational import Branch, Trees

#: (branch or None for the root, class); what ``xpath`` calls a place
Place = tuple[Branch | None, str]


class NotKeyed(Exception):
    """The query needs numbered nodes."""


class Keyed:
    """Sets of nodes by place: rows of the place's level with ``_doc``, ``_key`` and what is carried along."""

    def __init__(self, trees: Trees, guide):
        self.trees, self.guide = trees, guide

    def top(self) -> DataFrame:
        root = self.trees.root
        key = F.col(root.key)
        return root.rows.withColumns({"_doc": key.cast("bigint"), "_key": key})

    def path(self, place: Place) -> tuple[str, ...]:
        return () if place[0] is None else place[0].path

    def down(self, df: DataFrame, above: tuple[str, ...], below: tuple[str, ...], carry: list[str]) -> DataFrame:
        """From rows of one level to those of a level below, by foreign keys."""
        if below[: len(above)] != above:
            raise NotKeyed("not below")
        for i in range(len(above), len(below)):
            kid = self.trees.level(below[: i + 1])
            up = df.select(F.col("_key").alias("_up"), "_doc", *carry)
            own = kid.rows.withColumn("_key", F.col(kid.key))
            df = own.join(up, own[kid.parent] == up["_up"]).drop("_up")
        return df

    def up(self, parts: list[tuple[tuple[str, ...], DataFrame]], above: tuple[str, ...]) -> DataFrame:
        """Rows of a level that rows of levels just below belong to, or the same rows."""
        if len(parts) == 1 and parts[0][0] == above:
            return parts[0][1]
        keys = []
        for path, df in parts:
            if path[:-1] == above:
                keys.append(df.select(F.col(self.trees.level(path).parent).alias("_k")))
            else:
                raise NotKeyed("not just above")
        level = self.all(above)
        found = reduce(DataFrame.unionByName, keys)
        return level.join(found, level["_key"] == found["_k"], "left_semi")

    def climb(self, df: DataFrame, path: tuple[str, ...], above: tuple[str, ...]) -> DataFrame:
        """Rows of a level further up that rows of a level belong to."""
        while path != above:
            key, path = self.trees.level(path).parent, path[:-1]
            level = self.trees.level(path)
            rows = self.all(path) if path == above else level.rows.withColumn("_key", F.col(level.key))
            found = df.select(F.col(key).alias("_k"))
            df = rows.join(found, rows["_key"] == found["_k"], "left_semi")
        return df

    def all(self, path: tuple[str, ...]) -> DataFrame:
        return self.down(self.top(), (), path, [])

    def shown(self, df: DataFrame, place: Place) -> DataFrame:
        """With the columns by which a node of the place is judged: cls, name, ns, value, attrs; the
        table's own columns have a prefix, until ``plain`` takes it away."""
        b, cls = place
        none = F.lit(None).cast("map<string,array<string>>")
        if b is None:
            view = {"cls": F.lit("root"), "name": F.lit(""), "ns": F.lit(""), "value": F.lit(""), "attrs": none}
        else:
            own = self.trees.values(b)
            if cls == "object":
                view = {"cls": F.lit(cls), "name": own["local"], "ns": own["ns"], "value": F.lit(""), "attrs": own["attrs"]}
            elif cls == "field":
                view = {"cls": F.lit(cls), "name": F.lit(b.field), "ns": F.lit(""), "value": F.lit(""), "attrs": none}
            else:
                columns = {c: own[c] if c in own else F.lit(None).cast(k) for c, k in (("kind", "int"), ("s", "string"), ("i", "bigint"), ("u", "decimal(20,0)"), ("f", "double"), ("b", "boolean"))}
                df = df.withColumns({f"_v_{c}": v for c, v in columns.items()})
                view = {"cls": F.lit(cls), "name": F.lit(None).cast("string"), "ns": F.lit(""), "value": scalar_text("_v_"), "attrs": none}
        own = [F.col(f"`{c}`").alias(c if c.startswith("_") else f"_o_{c}") for c in df.columns]
        return df.select(*own, *(v.alias(c) for c, v in view.items()))


def plain(df: DataFrame) -> DataFrame:
    """Rows without what ``Keyed.shown`` added."""
    return df.select(*(F.col(f"`{c}`").alias(c.removeprefix("_o_")) for c in df.columns if c.startswith("_") and not c.startswith("_v_")))


def nodes(trees: Trees, guide, path, x) -> DataFrame:
    """(doc_id, cls, name, ns, value) of an absolute path, one row a node in no order.  ``x`` is the path module."""
    k = Keyed(trees, guide)
    found = _walk(k, x, {(None, "root"): k.top()}, path.steps, [])
    return reduce(DataFrame.unionByName, [df.select(F.col("_doc").alias("doc_id"), "cls", "name", "ns", "value") for df in found])


def number(trees: Trees, guide, call, x) -> DataFrame:
    """(doc_id, value) of count(), sum() or boolean() of an absolute path, one row a document."""
    k = Keyed(trees, guide)
    found = _walk(k, x, {(None, "root"): k.top()}, call.args[0].steps, [])
    every = reduce(DataFrame.unionByName, [df.select("_doc", "value") for df in found])
    what = {"count": F.count(F.lit(1)).cast("double"), "sum": F.sum(F.coalesce(F.col("value").try_cast("double"), F.lit(float("nan")))), "boolean": F.count(F.lit(1)) > 0}[call.name]
    got = every.groupBy("_doc").agg(what.alias("_value"))
    none = F.lit(False) if call.name == "boolean" else F.lit(0.0)
    return k.top().select("_doc").join(got, "_doc", "left").select(F.col("_doc").alias("doc_id"), F.coalesce("_value", none).alias("value"))


def _walk(k: Keyed, x, sets: dict[Place, DataFrame], steps, carry: list[str]) -> list[DataFrame]:
    """The nodes that steps lead to: rows with what ``shown`` adds, by place."""
    steps = list(steps)
    while steps:
        step = steps.pop(0)
        if step.axis == "descendant-or-self" and step.test == "node()" and not step.predicates and steps:
            nxt = steps.pop(0)
            if nxt.axis != "child":
                raise NotKeyed(nxt.axis)
            step = x.Step("descendant", nxt.test, nxt.predicates)
        if any(x._needs_position(e) for e in step.predicates):
            raise NotKeyed("positions")
        if step.axis == "attribute":
            if steps or step.predicates or step.test in ("*", "node()") or step.test.endswith("()"):
                raise NotKeyed("attributes")
            return [_attribute(k, p, df, step.test) for p, df in sets.items() if p[1] == "object"] or _nothing()
        fresh: dict[Place, DataFrame] = {}
        if step.axis == "self":
            fresh = {p: df for p, df in sets.items() if k.guide.passes(p, step.test)}
        elif step.axis in ("child", "descendant"):
            for p, df in sets.items():
                for q in k.guide.step(frozenset([p]), step.axis, step.test):
                    if q in fresh or q[0] is None:
                        raise NotKeyed("several ways to one place")
                    fresh[q] = k.down(df, k.path(p), k.path(q), carry)
        elif step.axis in ("ancestor", "ancestor-or-self") and not carry and len(sets) == 1:
            (p, df), = sets.items()
            for q in k.guide.step(frozenset([p]), step.axis, step.test):
                if q[0] is None:
                    raise NotKeyed("the root")
                fresh[q] = k.climb(df, k.path(p), k.path(q))
        elif step.axis == "parent" and not carry:
            above: dict[Place, list] = {}
            for p, df in sets.items():
                for q in k.guide.step(frozenset([p]), "parent", step.test):
                    above.setdefault(q, []).append((k.path(p), df))
            fresh = {q: k.up(parts, k.path(q)) for q, parts in above.items()}
        else:
            raise NotKeyed(step.axis)
        sets = {p: reduce(lambda d, e, p=p: _kept(k, x, p, d, e, carry), step.predicates, df) for p, df in fresh.items()}
    return [k.shown(df, p) for p, df in sets.items()] or _nothing()


def _nothing():
    raise NotKeyed("nothing is there")


def _attribute(k: Keyed, p: Place, df: DataFrame, name: str) -> DataFrame:
    own = k.shown(df, p)
    value = F.get(F.col("attrs")[name], F.lit(0))
    return own.where(value.isNotNull()).withColumns({"cls": F.lit("attribute"), "name": F.lit(name), "ns": F.lit(""), "value": value})


def _kept(k: Keyed, x, p: Place, df: DataFrame, e, carry: list[str]) -> DataFrame:
    """Rows of one place for which a predicate holds."""
    for part in x._conjuncts(e):
        anti = isinstance(part, x.Call) and part.name == "not"
        inner = part.args[0] if anti else part
        if isinstance(inner, x.Call) and inner.name == "boolean":
            inner = inner.args[0]
        own = _own(x, inner)
        if own is not None:
            df = plain(k.shown(df, p).where(~own if anti else own))
            continue
        counted = _counted(x, inner)
        if counted:
            path, op, limit = counted
            df = _by_count(k, x, p, df, path, lambda n, op=op, limit=limit: x._compared(op, n, F.lit(limit)), anti, carry)
            continue
        side = x._Compiler._existence(None, inner)
        if side is None or side[0].absolute:
            raise NotKeyed("predicate")
        path, test = side
        if (same := _same_row(k, p, path)) is not None:
            good = F.lit(True) if test is None else test(F.col("value"))
            df = plain(k.shown(df, same).where(~good if anti else good))
            continue
        _unique(k, p)
        mark = f"_c{len(carry)}"
        found = _walk(k, x, {p: df.withColumn(mark, F.col("_key"))}, path.steps, [*carry, mark])
        hits = [(f.where(test(F.col("value"))) if test is not None else f).select(F.col(mark).alias("_hit")) for f in found]
        keys = reduce(DataFrame.unionByName, hits)
        df = df.join(keys, df["_key"] == keys["_hit"], "left_anti" if anti else "left_semi")
    return df


def _same_row(k: Keyed, p: Place, path) -> Place | None:
    """The one place that a path without predicates leads to, if it stays within the row."""
    now = frozenset([p])
    for step in path.steps:
        if step.predicates or step.axis not in ("child", "self", "parent"):
            return None
        now = k.guide.step(now, step.axis, step.test)
        if len(now) != 1 or k.path(next(iter(now))) != k.path(p) or next(iter(now))[0] is None:
            return None
    return next(iter(now))


def _unique(k: Keyed, p: Place) -> None:
    """Keys tell rows apart only where children refer to them."""
    if not k.trees.level(k.path(p)).children:
        raise NotKeyed("rows without a key of their own")


def _own(x, e) -> Column | None:
    return x._Compiler._own(_Bare(x), e)


class _Bare:
    """What the row conditions of the path compiler need of it."""

    def __init__(self, x):
        self.x = x

    def _own(self, e) -> Column | None:
        return self.x._Compiler._own(self, e)


def _counted(x, e):
    """(path, comparison, number) of a predicate like count(path) > 5."""
    if isinstance(e, x.Binary) and e.op in x._COMPARE:
        for left, right, flip in ((e.left, e.right, False), (e.right, e.left, True)):
            if isinstance(left, x.Call) and left.name == "count" and isinstance(right, x.Literal) and isinstance(left.args[0], x.Path) and not left.args[0].absolute:
                return left.args[0], x._FLIP.get(e.op, e.op) if flip else e.op, float(right.value)
    return None


def _by_count(k: Keyed, x, p: Place, df: DataFrame, path, holds, anti: bool, carry: list[str]) -> DataFrame:
    _unique(k, p)
    mark = f"_c{len(carry)}"
    found = _walk(k, x, {p: df.withColumn(mark, F.col("_key"))}, path.steps, [*carry, mark])
    counts = reduce(DataFrame.unionByName, [f.select(F.col(mark).alias("_hit")) for f in found]).groupBy("_hit").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    good = holds(F.coalesce("_n", F.lit(0.0)))
    return df.join(counts, df["_key"] == counts["_hit"], "left").where(~good if anti else good).drop("_hit", "_n")

