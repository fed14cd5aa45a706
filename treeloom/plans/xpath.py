"""XPath 1.0 over node tables: text -> syntax tree -> DataFrame plan.

The document view of a tree: an object is an element named by its type; each of
its fields is an element named by the key around the value, except the token,
which stands alone; an array is itself the element of its field and its items are
the children; a scalar is a text node.  Scalars and scalar items are attributes
too.  Elements have an empty string-value.

Each view node has a number ``x`` = 3 * pre + (0 field, 1 object, 2 text) and an
end ``xe``, so that axes are conditions on ``doc_id`` plus intervals; steps
become filters, equi-joins or interval joins, predicates become filters, semi- or
anti-joins, and only then windows or aggregates.  A prepared query is the syntax
tree; running it on another node table binds it anew.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tree as T
from ..functions import uast as U
from ..operators.nodes import scalar_text
from ..sources.relational import Branch, Trees
from . import keyed


class XPathError(ValueError):
    """The query is not well formed, or uses something that does not exist."""


# ---- syntax --------------------------------------------------------------

_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>::|//|\.\.|!=|<=|>=|[()\[\].@,/|+\-=<>*$])"
    r"|(?P<name>[A-Za-z_\u0080-￿@][\w\u0080-￿.\-]*(?::(?!:)(?:\*|[A-Za-z_\u0080-￿][\w\u0080-￿.\-]*))?))"
)
AXES = ("ancestor", "ancestor-or-self", "attribute", "child", "descendant", "descendant-or-self", "following", "following-sibling", "parent", "preceding", "preceding-sibling", "self")
_REVERSE = {"ancestor", "ancestor-or-self", "preceding", "preceding-sibling"}


@dataclass(frozen=True)
class Literal:
    value: str | float


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Negate:
    arg: object


@dataclass(frozen=True)
class Step:
    axis: str
    test: str  # a name, prefix:name, prefix:*, *, node(), text(), comment()
    predicates: tuple = ()


@dataclass(frozen=True)
class Path:
    steps: tuple
    absolute: bool = False
    start: object = None  # a node-set expression the path goes on from
    filters: tuple = ()  # predicates on that


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise XPathError(f"unexpected {text[at:]!r}")
            kind = m.lastgroup
            value = m[kind]
            if kind == "name" and value.startswith("@"):  # an attribute, unless the key itself begins with @
                self.tokens.append(("op", "@"))
                at = m.end() - len(value) + 1
                continue
            before = self.tokens[-1] if self.tokens else None
            operand = before and (before[0] in ("num", "str", "name", "star") or before[1] in (")", "]", ".", ".."))
            if kind == "op" and value == "*":
                kind = "op" if operand else "star"
            elif kind == "name" and operand and value in ("and", "or", "div", "mod"):
                kind = "op"
            self.tokens.append((kind, value))
            at = m.end()
        self.at = 0

    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "")

    def take(self, op: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if op is not None and t != ("op", op):
            raise XPathError(f"expected {op!r}, got {t[1]!r}")
        self.at += 1
        return t

    def is_op(self, *ops: str) -> bool:
        return self.peek()[0] == "op" and self.peek()[1] in ops

    _LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))

    def expr(self, level: int = 0):
        if level == len(self._LEVELS):
            if self.is_op("-"):
                self.take()
                return Negate(self.expr(level))
            return self.union()
        left = self.expr(level + 1)
        while self.is_op(*self._LEVELS[level]):
            op = self.take()[1]
            left = Binary(op, left, self.expr(level + 1))
        return left

    def union(self):
        left = self.path()
        while self.is_op("|"):
            self.take()
            left = Binary("|", left, self.path())
        return left

    def path(self):
        kind, value = self.peek()
        call = kind == "name" and self.peek(1) == ("op", "(") and value not in ("node", "text", "comment", "processing-instruction")
        if kind in ("num", "str") or call or self.is_op("("):
            start = self.primary()
            filters = self.predicates()
            if self.is_op("/", "//"):
                return Path(self.relative(self.take()[1] == "//"), start=start, filters=filters)
            return Path((), start=start, filters=filters) if filters else start
        if self.is_op("/", "//"):
            deep = self.take()[1] == "//"
            if not deep and not self.begins_step():
                return Path((), absolute=True)
            return Path(self.relative(deep), absolute=True)
        return Path(self.relative(False))

    def begins_step(self) -> bool:
        return self.peek()[0] in ("name", "star") or self.is_op("@", ".", "..")

    def relative(self, deep: bool) -> tuple:
        steps: list[Step] = []
        while True:
            if deep:
                steps.append(Step("descendant-or-self", "node()"))
            steps.append(self.step())
            if not self.is_op("/", "//"):
                return tuple(steps)
            deep = self.take()[1] == "//"

    def step(self) -> Step:
        if self.is_op(".", ".."):
            return Step("self" if self.take()[1] == "." else "parent", "node()", self.predicates())
        axis = "child"
        if self.is_op("@"):
            self.take()
            axis = "attribute"
        elif self.peek()[0] == "name" and self.peek(1) == ("op", "::"):
            axis = self.take()[1]
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis}")
            self.take()
        kind, value = self.take()
        if kind == "op" and value == "@" and axis == "child":
            raise XPathError("unexpected '@'")
        if kind == "op" and value == "@":  # a key that begins with @
            kind, value = self.take()
            value = "@" + value
        if kind not in ("name", "star"):
            raise XPathError(f"expected a step, got {value!r}")
        if self.is_op("(") and value in ("node", "text", "comment", "processing-instruction"):
            self.take()
            self.take(")")
            value += "()"
        return Step(axis, value, self.predicates())

    def predicates(self) -> tuple:
        out = []
        while self.is_op("["):
            self.take()
            out.append(self.expr())
            self.take("]")
        return tuple(out)

    def primary(self):
        kind, value = self.take()
        if kind == "num":
            return Literal(float(value))
        if kind == "str":
            return Literal(value[1:-1])
        if kind == "name":
            self.take("(")
            args = []
            while not self.is_op(")"):
                args.append(self.expr())
                if not self.is_op(")"):
                    self.take(",")
            self.take(")")
            if value not in _TYPES:
                raise XPathError(f"unknown function {value}()")
            few, many = _ARGUMENTS[value]
            if not few <= len(args) <= many:
                raise XPathError(f"{value}() takes {few} to {many} arguments, not {len(args)}")
            if value in ("count", "sum") and kind_of(args[0]) != "nodes":
                raise XPathError(f"{value}() takes a node-set")
            return Call(value, tuple(args))
        inner = self.expr()
        self.take(")")
        return inner


# result types of functions
_TYPES = dict.fromkeys(("last", "position", "count", "sum", "number", "floor", "ceiling", "round", "string-length"), "number")
_TYPES |= dict.fromkeys(("boolean", "not", "true", "false", "starts-with", "ends-with", "contains", "matches"), "boolean")
_TYPES |= dict.fromkeys(("name", "local-name", "namespace-uri", "string", "concat", "substring-before", "substring-after", "substring", "normalize-space", "translate", "lower-case"), "string")
# how many arguments functions take
_ARGUMENTS = dict.fromkeys(("last", "position", "true", "false"), (0, 0)) | dict.fromkeys(("count", "sum", "floor", "ceiling", "round", "boolean", "not", "lower-case"), (1, 1))
_ARGUMENTS |= dict.fromkeys(("number", "string-length", "name", "local-name", "namespace-uri", "string", "normalize-space"), (0, 1))
_ARGUMENTS |= dict.fromkeys(("starts-with", "ends-with", "contains", "matches", "substring-before", "substring-after"), (2, 2))
_ARGUMENTS |= {"concat": (2, 1 << 30), "substring": (2, 3), "translate": (3, 3)}


def parse(query: str):
    """The syntax tree of a query; XPathError if there is none."""
    p = _Parser(query)
    out = p.expr()
    if p.peek()[0] != "end":
        raise XPathError(f"unexpected {p.peek()[1]!r}")
    _arithmetic(out)
    return out


def _arithmetic(e) -> None:
    """Refuses arithmetic between two node-sets: it is a misplaced ``*`` rather than a product."""
    if isinstance(e, Binary):
        if e.op in ("+", "-", "*", "div", "mod") and kind_of(e.left) == kind_of(e.right) == "nodes":
            raise XPathError(f"operands of {e.op!r} must be numbers")
        parts = [e.left, e.right]
    elif isinstance(e, Call):
        parts = list(e.args)
    elif isinstance(e, Path):
        parts = [e.start, *e.filters, *(q for s in e.steps for q in s.predicates)]
    else:
        parts = [e.arg] if isinstance(e, Negate) else []
    for x in parts:
        _arithmetic(x)


def kind_of(e) -> str:
    """number, string, boolean or nodes."""
    if isinstance(e, Literal):
        return "string" if isinstance(e.value, str) else "number"
    if isinstance(e, Call):
        return _TYPES[e.name]
    if isinstance(e, Negate):
        return "number"
    if isinstance(e, Binary):
        return "nodes" if e.op == "|" else "boolean" if e.op in ("or", "and", "=", "!=", "<", "<=", ">", ">=") else "number"
    return "nodes"


def _positional(e) -> bool:
    if isinstance(e, Call):
        return e.name in ("position", "last") or any(map(_positional, e.args))
    if isinstance(e, Binary):
        return _positional(e.left) or _positional(e.right)
    return isinstance(e, Negate) and _positional(e.arg)


def _needs_position(e) -> bool:
    return kind_of(e) == "number" or _positional(e)


# ---- the view ------------------------------------------------------------

_VIEW = ("doc_id", "x", "xe", "xp", "cls", "name", "ns", "value", "attrs", "pre")


def view(nodes: DataFrame, which: tuple[str, ...] = ("object", "field", "text")) -> DataFrame:
    """View nodes of a node table: a union of up to three projections of it."""
    n = nodes
    wrapped = F.col("field").isNotNull() & (F.col("field") != U.TOKEN)
    composite = F.col("kind").isin(T.OBJECT, T.ARRAY)
    # the element above: the object of a field, the array of an item, the root
    above = F.when(F.col("parent").isNull(), F.lit(-1)).when(F.col("field").isNotNull(), 3 * F.col("parent") + 1).otherwise(3 * F.col("parent"))
    end = 3 * (F.col("pre") + F.col("size")) + 2
    empty = F.lit(None).cast("map<string,array<string>>")
    parts = []
    for cls in which:
        if cls == "object":
            cols = (F.lit(1), F.when(wrapped, 3 * F.col("pre")).otherwise(above), F.coalesce("local", F.lit("")), F.coalesce("ns", F.lit("")), F.lit(""), F.col("attrs"))
            own = n.where(F.col("kind") == T.OBJECT)
        elif cls == "field":
            cols = (F.lit(0), above, F.when(wrapped, F.col("field")).otherwise(""), F.lit(""), F.lit(""), empty)
            own = n.where(wrapped | (F.col("kind") == T.ARRAY))
        else:
            cols = (F.lit(2), F.when(wrapped, 3 * F.col("pre")).otherwise(above), F.lit(None).cast("string"), F.lit(""), scalar_text(), empty)
            own = n.where(~composite)
        slot, xp, name, ns, value, attrs = cols
        parts.append(own.select("doc_id", (3 * F.col("pre") + slot).alias("x"), end.alias("xe"), xp.cast("bigint").alias("xp"), F.lit(cls).alias("cls"), name.alias("name"), ns.alias("ns"), value.alias("value"), attrs.alias("attrs"), "pre"))
    return reduce(DataFrame.unionByName, parts)


def _roots(nodes: DataFrame) -> DataFrame:
    top = nodes.where("parent is null")
    return top.select(
        "doc_id", F.lit(-1).cast("bigint").alias("x"), (3 * (F.col("pre") + F.col("size")) + 2).alias("xe"), F.lit(None).cast("bigint").alias("xp"), F.lit("root").alias("cls"), F.lit("").alias("name"),
        F.lit("").alias("ns"), F.lit("").alias("value"), F.lit(None).cast("map<string,array<string>>").alias("attrs"), "pre",
    )


def _classes(test: str) -> tuple[str, ...]:
    return ("text",) if test == "text()" else ("object", "field", "text") if test == "node()" else ("object", "field")


def _tested(nodes: DataFrame, test: str) -> DataFrame:
    if test in ("comment()", "processing-instruction()"):
        return view(nodes, ("text",)).where(F.lit(False))
    own = view(nodes, _classes(test))
    return own if test.endswith("()") or test == "*" else own.where(_name_is(test))


# ---- the structural summary of relational trees --------------------------

Place = tuple  # (branch or None for the root, class)
_ROOT: Place = (None, "root")


class _Guide:
    """Where steps can lead in trees whose branches are known; nothing else is planned."""

    def __init__(self, trees: Trees):
        self.trees = trees
        self.up: dict[Place, Place] = {}
        for b in trees.branches:
            above = trees.parent[b]
            if b.kind == "object":
                self.up[(b, "object")] = (above, "field") if above else _ROOT
            else:
                alone = b.kind == "scalar" and b.field == U.TOKEN
                if not alone:
                    self.up[(b, "field")] = (above, "object")
                if b.kind == "scalar":
                    self.up[(b, "text")] = (above, "object") if alone else (b, "field")

    def above(self, p: Place) -> list[Place]:
        out = []
        while p in self.up:
            p = self.up[p]
            out.append(p)
        return out

    def step(self, places: frozenset, axis: str, test: str) -> frozenset:
        every = [*self.up, _ROOT]
        if axis == "child":
            out = {p for p in self.up if self.up[p] in places}
        elif axis == "parent":
            out = {self.up[p] for p in places if p in self.up}
        elif axis in ("descendant", "descendant-or-self"):
            out = {p for p in self.up if places & set(self.above(p))}
        elif axis in ("ancestor", "ancestor-or-self"):
            out = {q for p in places for q in self.above(p)}
        elif axis in ("following-sibling", "preceding-sibling"):
            above = {self.up[p] for p in places if p in self.up}
            out = {p for p in self.up if self.up[p] in above}
        else:
            out = set(every)
        if axis in ("descendant-or-self", "ancestor-or-self", "self"):
            out |= places
        return frozenset(p for p in out if self.passes(p, test))

    def passes(self, p: Place, test: str) -> bool:
        b, cls = p
        if test == "node()":
            return True
        if b is None or test.endswith("()") or cls == "text":
            return cls == "text" and test == "text()"
        if test == "*":
            return True
        ns, local = U.split_type(test)
        own_ns, own = U.split_type(b.type) if cls == "object" else ("", b.field)
        return ns == own_ns and local in ("*", own)

    def rows(self, places: frozenset) -> DataFrame:
        """View nodes of some places."""
        by: dict[Branch, list[str]] = {}
        for b, cls in places:
            if b is not None:
                by.setdefault(b, []).append(cls)
        parts = [view(self.trees.rows(b), tuple(by[b])) for b in self.trees.branches if b in by]
        return reduce(DataFrame.unionByName, parts) if parts else view(self.trees.rows(self.trees.branches[0]), ("text",)).where(F.lit(False))


def _name_is(test: str) -> Column:
    ns, local = U.split_type(test)
    own = F.col("ns") == ns
    return own if local == "*" else own & (F.col("name") == local)


def _test_column(test: str) -> Column:
    element = F.col("cls").isin("object", "field")
    if test == "node()":
        return F.lit(True)
    if test == "text()":
        return F.col("cls") == "text"
    if test.endswith("()"):
        return F.lit(False)
    return element if test == "*" else element & _name_is(test)


# ---- compilation ---------------------------------------------------------


@dataclass
class _Set:
    """A node-set: view columns, plus ``keys``, columns of the context each node was reached from."""

    df: DataFrame
    keys: list[str] = field(default_factory=list)
    distinct: bool = True  # no node twice for one context
    places: frozenset | None = None  # where its nodes can be, if that is known


class _Compiler:
    def __init__(self, nodes: DataFrame | Trees):
        self.guide = _Guide(nodes) if isinstance(nodes, Trees) else None
        self.nodes = nodes.rows(nodes.branches[0]) if isinstance(nodes, Trees) else nodes
        self.fresh = count()

    def root(self) -> _Set:
        return _Set(_roots(self.nodes), places=frozenset([_ROOT]) if self.guide else None)

    def targets(self, ctx: _Set, axis: str, test: str) -> tuple[DataFrame, frozenset | None]:
        """View nodes a step can reach, and where they are."""
        if not self.guide:
            own = _tested(self.nodes, test)
            own = own.unionByName(_roots(self.nodes)) if axis in ("parent", "ancestor", "ancestor-or-self") and test == "node()" else own
            return own.hint("shuffle_merge"), None  # a union forgets the one of the node table (see ``nodes.shred``)
        places = self.guide.step(ctx.places if ctx.places is not None else frozenset([*self.guide.up, _ROOT]), axis, test)
        own = self.guide.rows(places)
        return (own.unionByName(_roots(self.nodes)) if _ROOT in places else own), places

    # -- paths

    def path(self, p: Path, context: _Set | None) -> _Set:
        if p.start is not None:
            own = self.nodeset(p.start, context)
            for e in p.filters:
                own = self.filtered(own, e, own.keys, [])
        elif p.absolute or context is None:
            own = self.root()
            if context is not None and context.keys:  # an absolute path in a predicate: for every context of the document
                ctx = context.df.select(F.col("doc_id").alias("_d"), *context.keys)
                own = _Set(own.df.join(ctx, F.col("doc_id") == F.col("_d")).drop("_d"), context.keys, places=own.places)
        else:
            own = context
        steps = list(p.steps)
        at_root = (p.absolute or (context is None and p.start is None)) and not own.keys
        while steps:
            step = steps.pop(0)
            if step == Step("descendant-or-self", "node()") and steps:
                nxt = steps[0]
                if nxt.axis == "child" and not any(_needs_position(e) for e in nxt.predicates):
                    steps[0] = Step("descendant", nxt.test, nxt.predicates)
                    continue
                if nxt.axis == "child" and at_root:  # positions count among the children of a parent
                    own = self.step(own, Step("descendant", nxt.test, nxt.predicates), at_root, among_siblings=True)
                    steps.pop(0)
                    at_root = False
                    continue
            own = self.step(own, step, at_root)
            at_root = False
        return own

    def step(self, ctx: _Set, step: Step, at_root: bool, among_siblings: bool = False) -> _Set:
        if step.axis == "attribute":
            return self.attributes(ctx, step)
        positional = any(_needs_position(e) for e in step.predicates)
        group: list[str] = []
        if at_root and step.axis in ("descendant", "child"):
            df, places = self.targets(ctx, step.axis, step.test)
            if step.axis == "child":
                df = df.where(F.col("xp") == -1)
            out = _Set(df, [], True, places)
            group = ["doc_id", "xp"] if among_siblings else ["doc_id"]
        elif step.axis == "self":
            places = self.guide.step(ctx.places, "self", step.test) if self.guide and ctx.places is not None else None
            out = _Set(ctx.df.where(_test_column(step.test)), ctx.keys, ctx.distinct, places)
            group = ["doc_id", *ctx.keys, "x"]
        else:
            i = next(self.fresh)
            c = {n: f"_c{i}_{n}" for n in ("doc_id", "x", "xe", "xp")}
            left = ctx.df.select(*(F.col(k).alias(v) for k, v in c.items()), *ctx.keys)
            right, places = self.targets(ctx, step.axis, step.test)
            d, x, xe, xp = (F.col(c[n]) for n in ("doc_id", "x", "xe", "xp"))
            on = {
                "child": F.col("xp") == x,
                "parent": F.col("x") == xp,
                "descendant": (F.col("x") > x) & (F.col("x") <= xe),
                "descendant-or-self": (F.col("x") >= x) & (F.col("x") <= xe),
                "ancestor": (F.col("x") < x) & (F.col("xe") >= xe) & ~((F.col("xe") == xe) & (F.col("x") > x)),
                "ancestor-or-self": (F.col("x") <= x) & (F.col("xe") >= xe),
                "following-sibling": (F.col("xp") == xp) & (F.col("x") > x),
                "preceding-sibling": (F.col("xp") == xp) & (F.col("x") < x),
                "following": F.col("x") > xe,
                "preceding": (F.col("xe") < x),
            }[step.axis]
            joined = right.join(left, (F.col("doc_id") == d) & on)
            single = step.axis == "child"
            out = _Set(joined, ctx.keys, ctx.distinct and single, places)
            group = ["doc_id", *ctx.keys, c["x"]]
        for e in step.predicates:
            out = self.filtered(out, e, out.keys, group, reverse=step.axis in _REVERSE, positional=positional)
        df = out.df.select(*_VIEW, *out.keys)
        if not out.distinct:
            df = df.dropDuplicates(["doc_id", "x", *out.keys])
        return _Set(df, out.keys, True, out.places)

    def attributes(self, ctx: _Set, step: Step) -> _Set:
        """Attribute nodes: one row per value; their parent is the element they belong to."""
        own = ctx.df
        if step.test == "node()" or step.test == "*":
            own = own.select(*_VIEW, *ctx.keys, F.explode("attrs").alias("_k", "_vs"))
        elif step.test.endswith("()"):
            own = own.where(F.lit(False)).select(*_VIEW, *ctx.keys, F.lit("").alias("_k"), F.array(F.lit("")).alias("_vs"))
        else:
            values = F.col("attrs")[step.test]  # of a map built in the plan only this entry is computed
            own = own.where(values.isNotNull()).select("doc_id", "x", "pre", *ctx.keys, F.lit(step.test).alias("_k"), values.alias("_vs"))
        rows = own.select("*", F.explode("_vs").alias("_v"))
        none = F.lit(None).cast("map<string,array<string>>")
        df = rows.select("doc_id", "x", F.col("x").alias("xe"), F.col("x").alias("xp"), F.lit("attribute").alias("cls"), F.col("_k").alias("name"), F.lit("").alias("ns"), F.col("_v").alias("value"), none.alias("attrs"), "pre", *ctx.keys)
        out = _Set(df, ctx.keys, True)
        for e in step.predicates:
            out = self.filtered(out, e, out.keys, ["doc_id", *out.keys, "x"])
        return out

    # -- predicates

    def filtered(self, s: _Set, e, keys: list[str], group: list[str], reverse: bool = False, positional: bool = False) -> _Set:
        df = s.df
        if _needs_position(e):
            w = Window.partitionBy(*(group or ["doc_id"]))
            by = w.orderBy(F.col("x").desc() if reverse else F.col("x"))
            df = df.withColumns({"_position": F.row_number().over(by).cast("double"), "_last": F.count(F.lit(1)).over(w).cast("double")})
            e = Binary("=", Call("position", ()), e) if kind_of(e) == "number" else e
            own, cond = self.value(e, _Set(df, s.keys, s.distinct, s.places))
            return _Set(own.df.where(cond).drop("_position", "_last"), s.keys, s.distinct, s.places)
        for part in _conjuncts(e):
            df = self._keep(_Set(df, s.keys, s.distinct, s.places), part).df
        return _Set(df, s.keys, s.distinct, s.places)

    def _keep(self, s: _Set, e) -> _Set:
        """Rows for which a non-positional predicate holds; node-sets by semi- and anti-joins."""
        anti = isinstance(e, Call) and e.name == "not" and len(e.args) == 1
        inner = e.args[0] if anti else e
        if isinstance(inner, Call) and inner.name == "boolean":
            inner = inner.args[0]
        if (own := self._own(inner)) is not None:
            return _Set(s.df.where(~own if anti else own), s.keys, s.distinct)
        side = self._existence(inner)
        if side is not None:
            path, test = side
            i = next(self.fresh)
            k = [f"_k{i}_d", f"_k{i}_x"]
            ctx = s.df.select(*_VIEW, F.col("doc_id").alias(k[0]), F.col("x").alias(k[1])).distinct() if not s.distinct else s.df.select(*_VIEW, F.col("doc_id").alias(k[0]), F.col("x").alias(k[1]))
            found = self.path(path, _Set(ctx, k, places=s.places)).df
            found = found.where(test(F.col("value"))) if test is not None else found
            found = found.select(*k)
            on = (s.df["doc_id"] == found[k[0]]) & (s.df["x"] == found[k[1]])
            return _Set(s.df.join(found, on, "left_anti" if anti else "left_semi"), s.keys, s.distinct)
        own_set, cond = self.value(e, s)
        cond = cond if kind_of(e) == "boolean" else _truth(cond, kind_of(e))
        return _Set(own_set.df.where(cond), s.keys, s.distinct)

    def _own(self, e) -> Column | None:
        """A condition on the row alone, where the predicate asks for no more."""
        if isinstance(e, Path) and len(e.steps) == 1 and e.start is None and not e.absolute and not e.steps[0].predicates:
            s = e.steps[0]
            if s.axis == "attribute" and not s.test.endswith("()") and s.test != "*":
                return F.col("attrs")[s.test].isNotNull()
            if s.axis == "self":
                return _test_column(s.test)
        if isinstance(e, Binary) and e.op in _COMPARE:
            for left, right, flip in ((e.left, e.right, False), (e.right, e.left, True)):
                if left == _HERE and isinstance(right, Literal):  # of attributes several may stand at one place
                    op = _FLIP.get(e.op, e.op) if flip else e.op
                    return F.coalesce(_against(op, right.value)(F.col("value")), F.lit(False))
                is_attr = isinstance(left, Path) and self._own(left) is not None and left.steps[0].axis == "attribute"
                if is_attr and isinstance(right, (Literal, Negate)):
                    value = right.value if isinstance(right, Literal) else -right.arg.value if isinstance(right.arg, Literal) else None
                    if value is None:
                        return None
                    op = _FLIP.get(e.op, e.op) if flip else e.op
                    values = F.col("attrs")[left.steps[0].test]
                    if op == "=" and isinstance(value, str):
                        return F.coalesce(F.array_contains(values, value), F.lit(False))
                    return F.coalesce(F.exists(values, _against(op, value)), F.lit(False))
        if isinstance(e, Binary) and e.op in ("and", "or"):
            a, b = self._own(e.left), self._own(e.right)
            return None if a is None or b is None else a & b if e.op == "and" else a | b
        if isinstance(e, Call) and e.name == "not" and len(e.args) == 1:
            a = self._own(e.args[0])
            return None if a is None else ~a
        return None

    def _existence(self, e):
        """(path, test on its values or None) if the predicate asks whether some node exists."""
        if isinstance(e, Path) and e.start is None:
            return e, None
        if isinstance(e, Binary) and e.op in _COMPARE:
            for left, right, flip in ((e.left, e.right, False), (e.right, e.left, True)):
                if isinstance(left, Path) and left.start is None and isinstance(right, Literal):
                    op = _FLIP.get(e.op, e.op) if flip else e.op
                    return left, lambda c, op=op, v=right.value: F.coalesce(_against(op, v)(c), F.lit(False))
        return None

    # -- values

    def nodeset(self, e, context: _Set | None) -> _Set:
        if isinstance(e, Path):
            return self.path(e, context)
        if isinstance(e, Binary) and e.op == "|":
            a, b = self.nodeset(e.left, context), self.nodeset(e.right, context)
            cols = [*_VIEW, *a.keys]
            both = a.df.select(*cols).unionByName(b.df.select(*cols))
            return _Set(both.dropDuplicates(["doc_id", "x", "cls", "name", "value", *a.keys]), a.keys)
        raise XPathError("expected a node-set")

    def per_context(self, e, s: _Set, what: Column, name: str) -> _Set:
        """Adds an aggregate over a node-set for every row of ``s``."""
        i = next(self.fresh)
        k = [f"_k{i}_d", f"_k{i}_x"]
        ctx = s.df.select(*_VIEW, F.col("doc_id").alias(k[0]), F.col("x").alias(k[1]))
        got = self.nodeset(e, _Set(ctx, k, places=s.places)).df.groupBy(*k).agg(what.alias(name))
        on = (s.df["doc_id"] == got[k[0]]) & (s.df["x"] == got[k[1]])
        return _Set(s.df.join(got, on, "left").drop(*k), s.keys, s.distinct, s.places)

    def value(self, e, s: _Set) -> tuple[_Set, Column]:
        """(``s`` with what is needed added, the value of ``e`` for its rows)."""
        if isinstance(e, Literal):
            return s, F.lit(e.value)
        if isinstance(e, Negate):
            s, v = self.number(e.arg, s)
            return s, -v
        if isinstance(e, Binary) and e.op in ("and", "or"):
            s, a = self.boolean(e.left, s)
            s, b = self.boolean(e.right, s)
            return s, (a & b if e.op == "and" else a | b)
        if isinstance(e, Binary) and e.op in _COMPARE:
            return self.compare(e, s)
        if isinstance(e, Binary) and e.op != "|":
            s, a = self.number(e.left, s)
            s, b = self.number(e.right, s)
            nan = F.lit(float("nan"))
            return s, {"+": a + b, "-": a - b, "*": a * b, "div": F.when(b != 0, F.try_divide(a, b)).when(a == 0, nan).otherwise(F.signum(a) * F.lit(float("inf"))), "mod": F.when(b != 0, a % F.when(b != 0, b)).otherwise(nan)}[e.op]
        if isinstance(e, Call):
            return self.call(e, s)
        raise XPathError("a node-set has no value here")

    def compare(self, e: Binary, s: _Set) -> tuple[_Set, Column]:
        if (own := self._own(e)) is not None:
            return s, own
        left, right, op = e.left, e.right, e.op
        if kind_of(right) == "nodes" and kind_of(left) != "nodes":
            left, right, op = right, left, _FLIP.get(op, op)
        name = f"_v{next(self.fresh)}"
        if kind_of(left) == "nodes" and op not in ("=", "!=") and kind_of(right) != "boolean":
            # some value stands in this order exactly if the extreme one does
            number = F.col("value").try_cast("double")
            number = F.when(~F.isnan(number), number)
            s = self.per_context(left, s, F.min(number) if _least_of(op) else F.max(number), name)
            if kind_of(right) == "nodes":
                other = f"_v{next(self.fresh)}"
                s = self.per_context(right, s, F.max(number) if _least_of(op) else F.min(number), other)
                return s, F.coalesce(_compared(op, F.col(name), F.col(other)), F.lit(False))
            s, v = self.number(right, s)
            return s, F.coalesce(_compared(op, F.col(name), v) & ~F.isnan(v), F.lit(False))
        if kind_of(left) == "nodes":
            s = self.per_context(left, s, F.collect_set("value"), name)
            mine = F.coalesce(F.col(name), F.array().cast("array<string>"))
            if kind_of(right) == "nodes":
                other = f"_v{next(self.fresh)}"
                s = self.per_context(right, s, F.collect_set("value"), other)
                theirs = F.coalesce(F.col(other), F.array().cast("array<string>"))
                return s, F.exists(mine, lambda a: F.exists(theirs, lambda b: (a == b) if op == "=" else (a != b)))
            if kind_of(right) == "boolean":
                s, v = self.boolean(right, s)
                return s, _compared(op, F.size(mine) > 0, v)
            s, v = self.value(right, s)
            if kind_of(right) == "number":
                return s, F.exists(mine, lambda a: F.coalesce(_compared(op, a.try_cast("double"), v.cast("double")), F.lit(False)))
            return s, F.exists(mine, lambda a: _compared(op, a, v))
        kinds = {kind_of(left), kind_of(right)}
        as_ = self.boolean if "boolean" in kinds and op in ("=", "!=") else self.number if "number" in kinds or op not in ("=", "!=") else self.string
        s, a = as_(left, s)
        s, b = as_(right, s)
        return s, F.coalesce(_compared(op, a, b), F.lit(False))

    def boolean(self, e, s: _Set) -> tuple[_Set, Column]:
        if kind_of(e) == "nodes":
            if (own := self._own(e)) is not None:
                return s, own
            name = f"_v{next(self.fresh)}"
            s = self.per_context(e, s, F.count(F.lit(1)), name)
            return s, F.coalesce(F.col(name) > 0, F.lit(False))
        s, v = self.value(e, s)
        return s, _truth(v, kind_of(e))

    def string(self, e, s: _Set) -> tuple[_Set, Column]:
        if kind_of(e) == "nodes":
            name = f"_v{next(self.fresh)}"
            s = self.per_context(e, s, F.min_by("value", "x"), name)
            return s, F.coalesce(F.col(name), F.lit(""))
        s, v = self.value(e, s)
        return s, v if kind_of(e) == "string" else v.cast("string") if kind_of(e) == "boolean" else _number_text(v)

    def number(self, e, s: _Set) -> tuple[_Set, Column]:
        kind = kind_of(e)
        if kind == "nodes":
            s, v = self.string(e, s)
            return s, F.coalesce(v.try_cast("double"), F.lit(float("nan")))
        s, v = self.value(e, s)
        return s, v.cast("double") if kind == "number" else v.cast("int").cast("double") if kind == "boolean" else F.coalesce(v.try_cast("double"), F.lit(float("nan")))

    def call(self, e: Call, s: _Set) -> tuple[_Set, Column]:
        n, a = e.name, e.args
        here = Path((Step("self", "node()"),))
        if n == "position":
            return s, F.col("_position")
        if n == "last":
            return s, F.col("_last")
        if n in ("true", "false"):
            return s, F.lit(n == "true")
        if n == "not":
            s, v = self.boolean(a[0], s)
            return s, ~v
        if n == "boolean":
            return self.boolean(a[0], s)
        if n in ("count", "sum"):
            name = f"_v{next(self.fresh)}"
            s = self.per_context(a[0], s, F.count(F.lit(1)) if n == "count" else F.sum(F.coalesce(F.col("value").try_cast("double"), F.lit(float("nan")))), name)
            return s, F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        if n in ("name", "local-name", "namespace-uri"):
            full = F.when(F.col("ns") != "", F.concat("ns", F.lit(":"), "name")).otherwise(F.coalesce("name", F.lit("")))
            own = full if n == "name" else F.coalesce("name", F.lit("")) if n == "local-name" else F.lit("")
            if not a:
                return s, own
            name = f"_v{next(self.fresh)}"
            s = self.per_context(a[0], s, F.min_by(own, "x"), name)
            return s, F.coalesce(F.col(name), F.lit(""))
        if n in ("number", "string") and not a:
            return (self.number if n == "number" else self.string)(here, s)
        if n == "number":
            return self.number(a[0], s)
        if n == "string":
            return self.string(a[0], s)
        if n in ("floor", "ceiling", "round"):
            s, v = self.number(a[0], s)
            return s, _floor(v) if n == "floor" else -_floor(-v) if n == "ceiling" else _floor(v + 0.5)
        texts = []
        for arg in a or ((here,) if n in ("string-length", "normalize-space") else ()):
            s, v = (self.number if n == "substring" and texts else self.string)(arg, s)
            texts.append(v)
        if n == "concat":
            return s, F.concat(*texts)
        if n == "starts-with":
            return s, texts[0].startswith(texts[1])
        if n == "ends-with":
            return s, texts[0].endswith(texts[1])
        if n == "contains":
            return s, F.contains(texts[0], texts[1])
        if n == "matches":
            return s, texts[0].rlike(a[1].value) if isinstance(a[1], Literal) else F.regexp_like(texts[0], texts[1])
        if n == "substring-before":
            return s, F.when(F.contains(texts[0], texts[1]), F.split_part(texts[0], texts[1], F.lit(1))).otherwise("")
        if n == "substring-after":
            at = F.call_function("instr", texts[0], texts[1])
            return s, F.when(at > 0, F.substring(texts[0], at + F.length(texts[1]), F.length(texts[0]))).otherwise("")
        if n == "substring":
            first = _floor(texts[1] + 0.5)
            size = F.length(texts[0]).cast("double")
            last = first + _floor(texts[2] + 0.5) if len(texts) > 2 else size + 1  # the first that is left out
            within = lambda v: F.least(F.greatest(v, F.lit(1.0)), size + 1).cast("int")
            nothing = F.isnan(first) | F.isnan(last) | (last <= first)
            return s, F.when(nothing, "").otherwise(F.substring(texts[0], within(first), F.greatest(within(last) - within(first), F.lit(0))))
        if n == "string-length":
            return s, F.length(texts[0]).cast("double")
        if n == "normalize-space":
            return s, F.trim(F.regexp_replace(texts[0], r"\s+", " "))
        if n == "translate":
            return s, F.call_function("translate", *texts)
        if n == "lower-case":
            return s, F.lower(texts[0])
        raise XPathError(f"unknown function {n}()")


_HERE = Path((Step("self", "node()"),))
_COMPARE = ("=", "!=", "<", "<=", ">", ">=")
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _conjuncts(e) -> list:
    return [*_conjuncts(e.left), *_conjuncts(e.right)] if isinstance(e, Binary) and e.op == "and" else [e]


def _compared(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _against(op: str, value: str | float):
    """A test of string values against a constant: as numbers unless it is (in)equality with a string."""
    if isinstance(value, str) and op in ("=", "!="):
        return lambda c: _compared(op, c, F.lit(value))
    try:
        number = float(value)
    except ValueError:
        return lambda c: F.lit(False)
    return lambda c: F.coalesce(_compared(op, c.try_cast("double"), F.lit(number)), F.lit(False))


def _truth(v: Column, kind: str) -> Column:
    return v if kind == "boolean" else F.length(v) > 0 if kind == "string" else (v != 0) & ~F.isnan(v)


_WHOLE = float(1 << 53)  # from here on all doubles are whole numbers


def _floor(v: Column) -> Column:
    """The floor as a double; infinite and very large numbers are their own."""
    return F.when(F.abs(v) < _WHOLE, F.floor(F.when(F.abs(v) < _WHOLE, v)).cast("double")).otherwise(v)


def _number_text(v: Column) -> Column:
    small = F.when(F.abs(v) < _WHOLE, v)
    return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.when(v > 0, "Infinity").otherwise("-Infinity")).when(small == F.floor(small), small.cast("bigint").cast("string")).otherwise(v.cast("string"))


def _whole(v: Column) -> Column:
    """An integral number as one; null otherwise."""
    small = F.when(F.abs(v) < 9.2e18, v)
    return F.when(small == F.floor(small), small.cast("bigint"))


def _least_of(op: str) -> bool:
    """Whether the least value decides if any of a set stands in this order to a number."""
    return op in ("<", "<=")


@dataclass(frozen=True)
class Query:
    """A prepared query."""

    text: str
    tree: object

    @property
    def result(self) -> str:
        """nodes, number, string or boolean."""
        return kind_of(self.tree)

    def execute(self, nodes: DataFrame | Trees) -> DataFrame:
        """Node-set: (doc_id, pre, x, cls, name, ns, value), one row per view node, in no order
        (sort by doc_id, x for document order); a field's row has the ``pre`` of its value.
        Scalar: (doc_id, value), one row per document; numbers as doubles, with ``whole``,
        the same as an integer where it is one.

        ``nodes`` is a node table, or relational trees, of which only the branches are
        planned that the steps can reach."""
        c = _Compiler(nodes)
        if self.result == "nodes":
            return c.nodeset(self.tree, None).df.select("doc_id", "pre", "x", "cls", "name", "ns", "value")
        s, v = c.value(self.tree, c.root())
        if self.result == "number":
            return s.df.select("doc_id", v.alias("value"), _whole(v).alias("whole"))
        return s.df.select("doc_id", v.alias("value"))


def prepare(query: str) -> Query:
    return Query(query, parse(query))


def execute(nodes: DataFrame | Trees, query: str) -> DataFrame:
    return prepare(query).execute(nodes)


def values(nodes: DataFrame | Trees, query: str) -> DataFrame:
    """The same without ``pre`` and ``x``: for relational trees and queries that ask for no order,
    position or sibling the plan then joins the tables by their keys and numbers nothing."""
    q = prepare(query)
    if isinstance(nodes, Trees):
        try:
            return _by_keys(nodes, q.tree)
        except keyed.NotKeyed:
            pass
    out = q.execute(nodes)
    return out.drop("pre", "x", "whole")


def _by_keys(trees: Trees, e) -> DataFrame:
    module = sys.modules[__name__]
    if isinstance(e, Path) and e.absolute and e.start is None:
        return keyed.nodes(trees, _Guide(trees), e, module)
    if isinstance(e, Call) and e.name in ("count", "sum", "boolean") and isinstance(e.args[0], Path) and e.args[0].absolute and e.args[0].start is None:
        return keyed.number(trees, _Guide(trees), e, module)
    raise keyed.NotKeyed("not one path")
