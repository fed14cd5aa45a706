"""Rules of the rewrite algebra compiled to column expressions over typed trees.

A tree whose shape is known - a struct column, or the levels of relational trees -
is described by shapes: constants, scalars, objects whose fields may be absent, and
arrays with a shape for their items.  Matching a pattern gives a condition and an
error text, both columns or constants; variables are a symbol table of shapes, so
binding and building cost nothing at run time.  Rules are applied bottom-up to every
place of the shape; those whose kind or constant type can't match are dropped before
there is a plan.  What is left are ``when``, ``transform`` and ``filter`` of built-in
functions: Catalyst prunes columns and pushes filters through them as usual.

What does not fit is refused with ``NotColumnar``: shapes of several types at one
place, unknown conversions, unused or undefined variables.  ``pipeline.rewrite`` does
those document by document, with the same results.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..functions import text as X
from ..functions import tree as T
from ..functions import uast as U
from ..operators import rewrite as W
from ..sources.relational import Level
from .pipeline import Transforms
from .select import NotColumnar

Truth = Column | bool
_NUMBERS = T.INT | T.UINT | T.FLOAT


# ---- conditions that may be known beforehand ------------------------------


def both(*parts: Truth) -> Truth:
    if any(p is False for p in parts):
        return False
    return reduce(lambda a, b: b if a is True else a if b is True else a & b, parts, True)


def either(*parts: Truth) -> Truth:
    if any(p is True for p in parts):
        return True
    return reduce(lambda a, b: b if a is False else a if b is False else a | b, parts, False)


def no(p: Truth) -> Truth:
    return not p if isinstance(p, bool) else ~p


def as_column(p: Truth) -> Column:
    return F.lit(p) if isinstance(p, bool) else p


def first_error(*parts: Column | None) -> Column | None:
    own = [p for p in parts if p is not None]
    return None if not own else own[0] if len(own) == 1 else F.coalesce(*own)


def guarded(p: Truth, error: Column | None) -> Column | None:
    """The error where ``p`` holds."""
    return None if error is None or p is False else error if p is True else F.when(p, error)


@dataclass(frozen=True)
class Hit:
    """Whether a pattern matches, and the error that ends the attempt (then it does not)."""

    match: Truth
    error: Column | None = None

    @property
    def good(self) -> Truth:
        return self.match if self.error is None else both(self.match, self.error.isNull())

    def then(self, more: Callable[[], Hit]) -> Hit:
        if self.match is False:
            return self
        nxt = more()
        return Hit(both(self.match, nxt.match), first_error(self.error, guarded(self.match, nxt.error)))


def in_order(steps: Iterable[Callable[[], Hit]]) -> Hit:
    out = Hit(True)
    for s in steps:
        out = out.then(s)
    return out


# ---- shapes ----------------------------------------------------------------


class Shape:
    def column(self) -> Column:
        raise NotImplementedError

    def json(self) -> Column:
        """JSON text with sorted keys; absent fields are left out."""
        raise NotImplementedError

    def nil(self) -> Truth:
        return False

    def kind_in(self, mask: int) -> Truth:
        raise NotImplementedError


def _or_nil(nil: Truth, own: Truth, mask: int) -> Truth:
    """Whether the kind is in the mask: ``own`` for what is not nil."""
    if mask & T.NIL:
        return either(nil, own)
    return both(no(nil), own)


@dataclass(frozen=True)
class Const(Shape):
    """A scalar, nil, or an empty object or array that is the same in every row."""

    value: Any

    def column(self) -> Column:
        if isinstance(self.value, (dict, list)):
            return F.create_map() if isinstance(self.value, dict) else F.array()
        return F.lit(int(self.value) if isinstance(self.value, T.Uint) else self.value)

    def json(self) -> Column:
        return F.lit(json.dumps(T.native(self.value), ensure_ascii=False))

    def nil(self) -> Truth:
        return self.value is None

    def kind_in(self, mask: int) -> Truth:
        return bool(T.kind_of(self.value) & mask)


@dataclass(frozen=True)
class Scalar(Shape):
    """A column of strings, integers, doubles or booleans; null is nil if it ``may`` be."""

    col: Column
    kind: int
    may: bool = True

    def column(self) -> Column:
        return self.col

    def json(self) -> Column:
        if self.kind == T.STRING:
            listed = F.to_json(F.array(self.col))
            text = F.substring(listed, F.lit(2), F.length(listed) - 2)
        elif self.kind == T.FLOAT:  # integral numbers are integers
            whole = (self.col == F.floor(self.col)) & (F.abs(self.col) < 9e18)
            text = F.when(whole, self.col.cast("bigint").cast("string")).otherwise(self.col.cast("string"))
        else:
            text = self.col.cast("string")
        return F.coalesce(text, F.lit("null")) if self.may else text

    def nil(self) -> Truth:
        return self.col.isNull() if self.may else False

    def kind_in(self, mask: int) -> Truth:
        if self.kind == T.FLOAT and bool(mask & T.INT) != bool(mask & T.FLOAT):
            whole = (self.col == F.floor(self.col)) & (F.abs(self.col) < 9e18)
            own: Truth = F.coalesce(whole if mask & T.INT else ~whole, F.lit(False))
        else:
            own = bool(self.kind & mask)
        return _or_nil(self.nil(), own, mask)


@dataclass(frozen=True)
class Obj(Shape):
    """Fields with the condition that they are there; ``null``: where the object itself is nil."""

    fields: Mapping[str, tuple[Shape, Truth]]
    null: Truth = False

    def column(self) -> Column:
        made = [(s.column() if p is True else F.when(as_column(p), s.column())).alias(k) for k, (s, p) in sorted(self.fields.items())]
        out = F.struct(*made) if made else F.create_map()
        return out if self.null is False else F.when(as_column(no(self.null)), out)

    def json(self) -> Column:
        parts = []
        for k, (s, p) in sorted(self.fields.items()):
            text = F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), s.json())
            parts.append(text if p is True else F.when(as_column(p), text))
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        return out if self.null is False else F.when(as_column(self.null), "null").otherwise(out)

    def nil(self) -> Truth:
        return self.null

    def kind_in(self, mask: int) -> Truth:
        return _or_nil(self.null, bool(mask & T.OBJECT), mask)

    def has(self, name: str) -> Truth:
        return self.fields[name][1] if name in self.fields else False


@dataclass(frozen=True)
class Arr(Shape):
    """Runs of items one after another: (array column, shape of an item) or single shapes."""

    runs: tuple
    null: Truth = False

    def size(self) -> Column | int:
        fixed = sum(isinstance(r, Shape) for r in self.runs)
        cols = [F.size(r[0]) for r in self.runs if not isinstance(r, Shape)]
        return reduce(lambda a, b: a + b, cols, F.lit(fixed) if fixed else F.lit(0)) if cols else fixed

    def mapped(self, f: Callable[[Shape], Column]) -> Column:
        """An array with ``f`` of every item."""
        made = [F.array(f(r)) if isinstance(r, Shape) else _each(r, f) for r in self.runs]
        return F.array() if not made else made[0] if len(made) == 1 else F.concat(*made)

    def column(self) -> Column:
        out = self.mapped(lambda s: s.column())
        return out if self.null is False else F.when(as_column(no(self.null)), out)

    def json(self) -> Column:
        out = F.concat(F.lit("["), F.array_join(self.mapped(lambda s: s.json()), ","), F.lit("]")) if self.runs else F.lit("[]")
        return out if self.null is False else F.when(as_column(self.null), "null").otherwise(out)

    def nil(self) -> Truth:
        return self.null

    def kind_in(self, mask: int) -> Truth:
        return _or_nil(self.null, bool(mask & T.ARRAY), mask)

    def only(self) -> tuple[Column, Callable[[Column], Shape]]:
        """The array as one column and its items' shape."""
        if len(self.runs) == 1 and not isinstance(self.runs[0], Shape):
            return self.runs[0]
        if not self.runs:
            raise NotColumnar("an array without items has no shape")
        shape = reduce(_common, (r if isinstance(r, Shape) else r[1](F.lit(None)) for r in self.runs))
        return self.mapped(lambda s: s.column()), lambda x: reread(shape, x)


def _each(run: tuple, f: Callable[[Shape], Column]) -> Column:
    col, item = run
    return F.transform(col, lambda x: f(item(x)))


def reread(like: Shape, col: Column) -> Shape:
    """The shape of ``like`` over a column that holds what it was built to."""
    if isinstance(like, Const):
        return like
    if isinstance(like, Scalar):
        return Scalar(col, like.kind, like.may)
    if isinstance(like, Obj):
        if any(p is not True for _, p in like.fields.values()):
            raise NotColumnar("fields that may be absent inside a built array")
        return Obj({k: (reread(s, col[k]), True) for k, (s, _) in like.fields.items()}, False if like.null is False else col.isNull())
    item = like.only()[1](F.lit(None))
    return Arr(((col, lambda x: reread(item, x)),), False if like.null is False else col.isNull())


_KINDS = {Y.StringType: T.STRING, Y.LongType: T.INT, Y.IntegerType: T.INT, Y.ShortType: T.INT, Y.ByteType: T.INT, Y.DoubleType: T.FLOAT, Y.FloatType: T.FLOAT, Y.BooleanType: T.BOOL}


def of_type(col: Column, kind: Y.DataType, absent: bool = False) -> Shape:
    """The shape of a column; ``absent``: null fields are absent rather than nil."""
    if isinstance(kind, Y.StructType):
        own = {f.name: of_type(col[f.name], f.dataType, absent) for f in kind.fields}
        return Obj({k: (s, (no(s.nil()) if absent else True)) for k, s in own.items()}, col.isNull())
    if isinstance(kind, Y.ArrayType):
        return Arr(((col, lambda x: of_type(x, kind.elementType, absent)),), col.isNull())
    if type(kind) not in _KINDS:
        raise NotColumnar(kind.simpleString())
    return Scalar(col, _KINDS[type(kind)])


def of_level(level: Level, col: Column) -> Shape:
    """The shape of the objects of a level as ``relational.structs`` makes them: types are constants."""
    kinds = {f.name: f.dataType for f in level.rows.schema.fields}
    own: dict[str, tuple[Shape, Truth]] = {U.TYPE: (Const(level.type), True)}
    own |= {c: (of_type(col[c], kinds[c]), True) for c in level.scalars}
    own |= {n: (Arr(((col[n], lambda x, kid=kid: of_level(kid, x)),)), True) for n, kid in level.children.items()}
    return Obj(own)


def same(a: Shape, b: Shape) -> Truth:
    """Deep equality."""
    if isinstance(a, Const) and isinstance(b, Const):
        return T.equal(a.value, b.value)
    if isinstance(b, Const):
        a, b = b, a
    if isinstance(a, Const):
        v = a.value
        if v is None:
            return b.nil()
        if isinstance(v, (dict, list)):
            if v:
                raise NotColumnar("composite constants")
            if isinstance(b, Obj):
                return both(no(b.null), isinstance(v, dict), *(no(p) for _, p in b.fields.values()))
            return both(no(b.nil()), b.size() == 0) if isinstance(b, Arr) and isinstance(v, list) else False
        if not isinstance(b, Scalar) or not (b.kind == T.kind_of(v) or b.kind & _NUMBERS and T.kind_of(v) & _NUMBERS):
            return False
        return F.coalesce(b.col == F.lit(int(v) if isinstance(v, T.Uint) else v), F.lit(False))
    if isinstance(a, Scalar) and isinstance(b, Scalar):
        return a.col.eqNullSafe(b.col) if a.kind == b.kind or a.kind & b.kind & _NUMBERS else both(a.nil(), b.nil())
    return a.json() == b.json()


def merged(p: Truth, a: Shape, b: Shape) -> Shape:
    """``a`` where ``p`` holds, else ``b``."""
    if isinstance(p, bool):
        return a if p else b
    if a is b:
        return a
    if isinstance(a, Const) and isinstance(b, Const) and T.kind_of(a.value) == T.kind_of(b.value) and T.equal(a.value, b.value):
        return a
    pick = lambda x, y: F.when(p, x).otherwise(y)
    null = either(both(p, a.nil()), both(no(p), b.nil()))
    for x, y in ((a, b), (b, a)):  # nil on one side
        if isinstance(x, Const) and x.value is None:
            if isinstance(y, Obj):
                return Obj(y.fields, null)
            if isinstance(y, Arr):
                return Arr(y.runs, null)
            if isinstance(y, Scalar) or (isinstance(y, Const) and not isinstance(y.value, (dict, list))):
                return Scalar(pick(a.column(), b.column()), _scalar_kind(y))
    if isinstance(a, Obj) and isinstance(b, Obj):
        out: dict[str, tuple[Shape, Truth]] = {}
        for k in {**a.fields, **b.fields}:
            if k in a.fields and k in b.fields:
                out[k] = (merged(p, a.fields[k][0], b.fields[k][0]), either(both(p, a.has(k)), both(no(p), b.has(k))))
            else:
                s, there = (a if k in a.fields else b).fields[k]
                out[k] = (s, both(p if k in a.fields else no(p), there))
        for k, (s, there) in out.items():  # where it is there on both sides it is there
            if a.has(k) is True and b.has(k) is True:
                out[k] = (s, True)
        return Obj(out, null)
    empty = lambda s: isinstance(s, Const) and s.value == [] or isinstance(s, Arr) and not s.runs
    if isinstance(a, Arr) and empty(b) or isinstance(b, Arr) and empty(a):
        full = a if isinstance(a, Arr) and a.runs else b
        if not isinstance(full, Arr) or not full.runs:
            return Arr((), null)
        col, item = full.only()
        chosen = F.filter(col, lambda _: F.lit(False))
        return Arr(((pick(col, chosen) if full is a else pick(chosen, col), item),), null)
    if isinstance(a, Arr) and isinstance(b, Arr):
        (x, f), (y, g) = a.only(), b.only()
        if x is y:  # two readings of the same items
            return Arr(((x, lambda v: merged(p, f(v), g(v))),), null)
        shape = _common(f(F.lit(None)), g(F.lit(None)))
        return Arr(((pick(a.column(), b.column()), lambda x: reread(shape, x)),), null)
    ka, kb = _scalar_kind(a), _scalar_kind(b)
    if ka != kb:
        raise NotColumnar(f"{T.kind_name(ka)} or {T.kind_name(kb)} at one place")
    return Scalar(pick(a.column(), b.column()), ka, either(a.nil(), b.nil()) is not False)


def _common(a: Shape, b: Shape) -> Shape:
    """What can be said of columns that hold nodes of either shape."""
    if isinstance(a, Const) and isinstance(b, Const) and a.value == b.value and T.kind_of(a.value) == T.kind_of(b.value):
        return a
    if isinstance(a, Obj) and isinstance(b, Obj) and a.fields.keys() == b.fields.keys():
        if all(p is True and b.has(k) is True for k, (_, p) in a.fields.items()):
            return Obj({k: (_common(s, b.fields[k][0]), True) for k, (s, _) in a.fields.items()}, either(a.null, b.null) is not False)
    if isinstance(a, Arr) and isinstance(b, Arr) and a.runs and b.runs:
        item = _common(a.only()[1](F.lit(None)), b.only()[1](F.lit(None)))
        return Arr(((F.lit(None), lambda _: item),), either(a.null, b.null) is not False)
    if isinstance(a, (Obj, Arr)) or isinstance(b, (Obj, Arr)) or _scalar_kind(a) != _scalar_kind(b):
        raise NotColumnar("items of several types in one array")
    return Scalar(F.lit(None), _scalar_kind(a))


def _scalar_kind(s: Shape) -> int:
    if isinstance(s, Scalar):
        return s.kind
    if isinstance(s, Const) and not isinstance(s.value, (dict, list)) and s.value is not None:
        return T.INT if isinstance(s.value, T.Uint) else T.kind_of(s.value)
    raise NotColumnar(type(s).__name__)


# ---- typed values ----------------------------------------------------------


def typed(values: Shape, name: str) -> Shape:
    """Values as an object of a registered type: fields it does not declare are refused, missing ones
    have their zero values, optional ones with a zero value are left out."""
    fields = U.TYPES.lookup(name)
    if not isinstance(values, Obj):
        raise NotColumnar("fields of a typed object")
    if fields is None:
        return Obj({**values.fields, U.TYPE: (Const(name), True)})
    if unknown := set(values.fields) - set(fields):
        raise KeyError(f"undefined field {name}.{sorted(unknown)[0]}")
    required, optional = U.TYPES.zero(name)
    out: dict[str, tuple[Shape, Truth]] = {k: (Const(v), True) for k, v in required.items()}
    for k, (s, there) in values.fields.items():
        if k in optional:
            out[k] = (s, both(there, no(s.nil()), no(same(s, Const(optional[k]))) if optional[k] is not None else True))
        else:
            out[k] = (merged(there, s, Const(required[k])), True)
    return Obj(out)


def node_as(n: Shape, name: str) -> tuple[Shape, Truth]:
    """(the declared fields of an object with defaults for missing ones, whether it is of the type)."""
    fields = U.TYPES.lookup(name)
    if not isinstance(n, Obj):
        return Const(None), False
    right = both(no(n.null), either(no(n.has(U.TYPE)), same(n.fields[U.TYPE][0], Const(name))) if U.TYPE in n.fields else True)
    if fields is None:
        return Obj({k: v for k, v in n.fields.items() if k != U.TYPE}), right
    out = {}
    for k, f in fields.items():
        zero = Const(U._ZERO[f.kind])
        if k not in n.fields:
            out[k] = (zero, True)
            continue
        s, there = n.fields[k]
        out[k] = (merged(both(there, no(s.nil())), s, zero), True)
    return Obj(out), right


# ---- matching --------------------------------------------------------------


@dataclass
class Symbols:
    """Variables bound by a match; per name the array and the symbols of an item, or the symbols of a scope."""

    vars: dict[str, Shape] = field(default_factory=dict)
    states: dict[str, Any] = field(default_factory=dict)
    read: set[str] = field(default_factory=set)

    def copy(self) -> Symbols:
        return Symbols(dict(self.vars), dict(self.states), self.read)

    def set(self, name: str, value: Shape) -> Hit:
        if name in self.vars:
            equal = same(self.vars[name], value)
            return Hit(equal, None if equal is True else F.when(as_column(no(equal)), F.lit(f"variable redeclared: {name}")))
        self.vars[name] = value
        return Hit(True)

    def get(self, name: str) -> Shape:
        if name not in self.vars:
            raise NotColumnar(f"variable {name} is not defined")
        self.read.add(name)
        return self.vars[name]

    def join(self, p: Truth, a: Symbols, b: Symbols) -> None:
        """What ``a`` bound where ``p`` holds, else what ``b`` did."""
        for k in {**a.vars, **b.vars}:
            if k not in self.vars:
                self.vars[k] = merged(p, a.vars[k], b.vars[k]) if k in a.vars and k in b.vars else a.vars.get(k, b.vars.get(k))
        for k in {**a.states, **b.states}:
            if k in a.states and k in b.states and k not in self.states and p not in (True, False):
                raise NotColumnar(f"{k} is bound in two ways")
            self.states.setdefault(k, (a if k in a.states else b).states[k])


@dataclass(frozen=True)
class Listed(Shape):
    """The children of a level; questions about them become aggregates by parent."""

    level: Level
    asked: list

    def kind_in(self, mask: int) -> Truth:
        return bool(mask & T.ARRAY)

    def column(self) -> Column:
        raise NotColumnar("a list of children")

    json = column

    def any_or_all(self, o: W.AnyElem) -> Truth:
        self.asked.append((self.level, o))
        return F.col(f"_asked{len(self.asked) - 1}")


_MISMATCH = "\x00"


def check(o: W.Sel, n: Shape, st: Symbols) -> Hit:
    """The pattern ``o`` at ``n``; binds its variables in ``st``."""
    for kind, f in _CHECKS:
        if isinstance(o, kind):
            return f(o, n, st)
    raise NotColumnar(type(o).__name__)


def _check_is(o: W.Is, n: Shape, st: Symbols) -> Hit:
    return Hit(same(Const(o.value), n))


def _check_not(o: W.Not, n: Shape, st: Symbols) -> Hit:
    inner = check(o.sel, n, st.copy())
    own = n.kind_in(T.OBJECT) if isinstance(o, W.ObjNot) else True
    return Hit(both(own, no(inner.match)), guarded(own, inner.error))


def _check_and(o: W.And, n: Shape, st: Symbols) -> Hit:
    own = st.copy()
    return in_order((lambda s=s: check(s, n, own)) for s in o.sels)


def _check_has(o: W.Has, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Obj):
        return Hit(False)
    own = st.copy()
    steps: list = [lambda: Hit(no(n.null))]
    for k, s in o.fields.items():
        steps.append(lambda k=k, s=s: Hit(n.has(k)).then(lambda: check(s, n.fields[k][0], own)))
    return in_order(steps)


def _check_fields_there(o: W.HasFields, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Obj):
        return Hit(False)
    return Hit(both(no(n.null), *(n.has(k) if want else no(n.has(k)) for k, want in o.fields.items())))


def _check_in(o: W.In, n: Shape, st: Symbols) -> Hit:
    own = [both(n.kind_in(kind), same(Const(T.Uint(v) if kind == T.UINT else v), n)) for kind, v in sorted(o.values, key=repr)]
    return Hit(either(*own))


def _items(n: Arr, f: Callable[[Shape], Hit]) -> Column:
    """Per item null, the mismatch mark, or an error."""

    def outcome(s: Shape) -> Column:
        h = f(s)
        missed = F.when(as_column(no(h.match)), F.lit(_MISMATCH))
        return missed if h.error is None else F.coalesce(h.error, missed)

    return n.mapped(outcome)


def _check_elems(o: W.AnyElem, n: Shape, st: Symbols) -> Hit:
    if isinstance(n, Listed):
        return Hit(n.any_or_all(o))
    if not isinstance(n, Arr):
        return Hit(False)
    if not n.runs:
        return Hit(isinstance(o, W.All))
    test = lambda s: as_column(check(o.sel, s, st.copy()).good)
    found = F.forall(n.mapped(test), lambda x: x) if isinstance(o, W.All) else F.exists(n.mapped(test), lambda x: x)
    return Hit(both(no(n.null), F.coalesce(found, F.lit(False))))


def _check_var(o: W.Var, n: Shape, st: Symbols) -> Hit:
    own = n.kind_in(o.kinds)
    return Hit(own).then(lambda: st.set(o.name, n))


def _check_if(o: W.If, n: Shape, st: Symbols) -> Hit:
    a, b = st.copy(), st.copy()
    first, other = check(o.then, n, a), check(o.otherwise, n, b)
    hit = first.good
    st.join(hit, a, b)
    set_ = st.set(o.var, _flag(hit))
    error = guarded(both(no(hit), no(other.good)), first_error(first.error, other.error))
    return Hit(either(hit, other.good), error).then(lambda: set_)


def _flag(p: Truth) -> Shape:
    return Const(p) if isinstance(p, bool) else Scalar(p, T.BOOL, False)


def _check_opt(o: W.Opt, n: Shape, st: Symbols) -> Hit:
    nil = n.nil()
    set_ = st.set(o.exists, _flag(no(nil)))
    if nil is True:
        return set_
    inner = check(o.inner, Obj(n.fields) if isinstance(n, Obj) else Arr(n.runs) if isinstance(n, Arr) else n, st)
    return set_.then(lambda: Hit(either(nil, inner.match), guarded(no(nil), inner.error)))


def _check_cases(o: W.Cases, n: Shape, st: Symbols) -> Hit:
    open_: Truth = True  # no case before has matched or failed
    out, error = Symbols(), None
    which: Shape | None = None
    match: Truth = False
    tried: list[tuple[Truth, Symbols]] = []
    for i, c in enumerate(o.cases):
        own = st.copy()
        h = check(c, n, own)
        error = first_error(error, guarded(open_, h.error))
        here = both(open_, h.good)
        tried.append((here, own))
        which = Const(i) if which is None else merged(match, which, Const(i)) if match is not False else Const(i)
        match = either(match, here)
        open_ = both(open_, no(h.match), True if h.error is None else h.error.isNull())
    for here, own in reversed(tried):
        joined = st.copy()
        joined.join(here, own, out)
        out = joined
    st.vars, st.states = out.vars, out.states
    return Hit(match, error).then(lambda: st.set(o.var, which))


def _checked_fields(o: W.ObjectOp, n: Obj, st: Symbols) -> tuple[Hit, set[str]]:
    """The fields of an object operation: (hit, names it covers)."""
    if isinstance(o, W.Fields):
        steps = []
        for f in o.fields:

            def one(f: W.Field = f) -> Hit:
                there = n.has(f.name)
                set_ = st.set(f.optional, _flag(there)) if f.optional else Hit(True)
                if there is False:
                    return set_ if f.optional or f.drop else Hit(False)
                inner = check(f.op, n.fields[f.name][0], st)
                if f.optional or f.drop:
                    return set_.then(lambda: Hit(either(no(there), inner.match), guarded(there, inner.error)))
                return Hit(there).then(lambda: inner)

            steps.append(one)
        return in_order(steps), {f.name for f in o.fields}
    if isinstance(o, W.Part):
        known = set(o.inner.needs())
        h, _ = _checked_fields(o.inner, Obj({k: v for k, v in n.fields.items() if k in known}), st)
        rest = Obj({k: v for k, v in n.fields.items() if k not in known})
        return h.then(lambda: st.set(o.var, rest)), set(n.fields)
    if isinstance(o, W.JoinObj):
        used: set[str] = set()
        steps = []
        for p in [p for p in o.parts if p.full]:
            known = set(p.needs())
            steps.append(lambda p=p, known=known: _checked_fields(p, Obj({k: v for k, v in n.fields.items() if k in known}), st)[0])
            used |= known
        for p in o.partial:
            gone = set(used)
            steps.append(lambda p=p, gone=gone: _checked_fields(p, Obj({k: v for k, v in n.fields.items() if k not in gone}), st)[0])
            used = set(n.fields)
        return in_order(steps), used
    if isinstance(o, W.CheckObj):
        guard = check(o.sel, n, st.copy())
        h, used = _checked_fields(o.inner, n, st)
        return guard.then(lambda: h), used
    if isinstance(o, W.ObjOpScope):
        own = Symbols()
        h, used = _checked_fields(o.inner, n, own)
        st.states[o.name] = own
        return h, used
    if isinstance(o, W.CasesObj):
        known = set(o.needs())
        return check(o.inner, Obj({k: v for k, v in n.fields.items() if k in known}), st), known
    raise NotColumnar(type(o).__name__)


def _check_object(o: W.ObjectOp, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Obj):
        return Hit(False)
    if isinstance(o, W.CasesObj):
        return check(o.inner, n, st)
    wanted: list[Truth] = [no(n.null)]
    for k, f in o.needs().items():  # what must be there is looked at before any variable is bound
        there = n.has(k)
        fixed = True if f.fixed is W._MISSING or there is False else same(Const(f.fixed), n.fields[k][0])
        wanted.append(both(there, fixed) if not f.optional else either(no(there), fixed))
    if (ready := both(*wanted)) is False:
        return Hit(False)
    hit, used = _checked_fields(o, Obj(n.fields), st)
    out = Hit(ready).then(lambda: hit)
    if o.full and (rest := {k: p for k, (_, p) in n.fields.items() if k not in used}):
        extra = either(*rest.values())
        if extra is not False:
            unused = F.when(as_column(both(out.good, extra)), F.lit(f"unused field: {sorted(rest)}"))
            out = Hit(both(out.match, no(extra)), first_error(out.error, unused))
    return out


def _check_scope(o: W.OpScope, n: Shape, st: Symbols) -> Hit:
    own = Symbols()
    h = check(o.inner, n, own)
    st.states[o.name] = own
    return h


def _check_lookup(o: W.Lookup, n: Shape, st: Symbols) -> Hit:
    value, known = _looked_up(o.forth, n)
    error = None if known is True else F.when(as_column(no(known)), F.lit("unhandled value"))
    return Hit(known, error).then(lambda: check(o.inner, value, st))


def _looked_up(table: Mapping[Any, Any], n: Shape) -> tuple[Shape, Truth]:
    if isinstance(n, (Obj, Arr)):
        raise NotColumnar("a lookup of a composite")
    out, known = None, False
    for (kind, v), to in table.items():
        here = both(n.kind_in(kind), same(Const(T.Uint(v) if kind == T.UINT else v), n))
        if here is False:
            continue
        out = Const(T.to_node(to)) if out is None else merged(here, Const(T.to_node(to)), out)
        known = either(known, here)
    return out if out is not None else Const(None), known


def _chosen(o: W.LookupOpVar, st: Symbols) -> list[tuple[Truth, W.Op | None]]:
    """(condition, operation) for the cases of a variable, in order; the last holds otherwise."""
    v = st.get(o.var)
    if isinstance(v, (Obj, Arr)):
        raise NotColumnar("a choice by a composite")
    own = [(both(v.kind_in(kind), same(Const(T.Uint(x) if kind == T.UINT else x), v)), c) for (kind, x), c in o.cases.items()]
    return [*((p, c) for p, c in own if p is not False), (True, o.default)]


def _check_lookup_op(o: W.LookupOpVar, n: Shape, st: Symbols) -> Hit:
    out: Hit | None = None
    for p, c in reversed(_chosen(o, st)):
        own = st.copy()
        h = Hit(False, F.lit("unhandled value")) if c is None else check(c, n, own)
        if own.vars.keys() - st.vars.keys():
            raise NotColumnar("a choice that binds variables")
        out = h if out is None else Hit(either(both(p, h.match), both(no(p), out.match)), first_error(guarded(p, h.error), guarded(no(p), out.error)))
    return out


def _check_each(o: W.Each, n: Shape, st: Symbols) -> Hit:
    if isinstance(n, Const) and n.value is None:
        st.states[o.var] = (Arr((), True), lambda s: Symbols())
        return Hit(True)
    if isinstance(n, Const) and n.value == []:
        n = Arr(())
    if not isinstance(n, Arr):
        return Hit(n.nil()) if n.nil() is False else _refuse("a list that may be something else")
    if o.var in st.states:
        raise NotColumnar(f"{o.var} is bound twice")

    def symbols(s: Shape) -> Symbols:
        own = Symbols()
        check(o.inner, s, own)
        return own

    st.states[o.var] = (n, symbols)
    if not n.runs:
        return Hit(True)
    first = F.get(F.filter(_items(n, lambda s: check(o.inner, s, Symbols())), lambda x: x.isNotNull()), F.lit(0))
    return Hit(either(n.null, first.isNull()), F.when(first != _MISMATCH, first))


def _refuse(why: str):
    raise NotColumnar(why)


def _item(n: Arr, at: Column) -> Shape:
    col, shape = n.only()
    return shape(F.get(col, at))


def _check_array(o: W.ArrayOp, n: Shape, st: Symbols) -> Hit:
    if isinstance(o, W.LookupArrOpVar):
        return _check_lookup_op(o.chosen, n, st)
    if not isinstance(n, Arr):
        return Hit(T.equal(n.value, []) and not _ops(o)) if isinstance(n, Const) else Hit(False)
    own = _ops(o)
    if all(isinstance(r, Shape) for r in n.runs):
        return Hit(both(no(n.null), len(own) == len(n.runs))).then(lambda: in_order((lambda c=c, r=r: check(c, r, st)) for c, r in zip(own, n.runs, strict=True)))
    size = n.size()
    return Hit(both(no(n.null), size == len(own))).then(lambda: in_order((lambda i=i, c=c: check(c, _item(n, F.lit(i)), st)) for i, c in enumerate(own)))


def _ops(o: W.ArrayOp) -> list[W.Op]:
    if isinstance(o, W.Arr):
        return o._ops
    if isinstance(o, W.AppendArr):
        return [c for a in o.arrays for c in _ops(a)]
    raise NotColumnar(type(o).__name__)


def _check_append(o: W.Append, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Arr):
        return Hit(False)
    tail = _ops(o.items)
    col, shape = n.only() if n.runs else (None, None)
    if col is None:
        return Hit(not tail).then(lambda: check(o.to, n, st))
    cut = F.size(col) - len(tail)
    head = Arr(((F.slice(col, F.lit(1), F.greatest(cut, F.lit(0))), shape),))
    steps = [lambda: Hit(both(no(n.null), cut >= 0)), lambda: check(o.to, head, st)]
    steps += [(lambda i=i, c=c: check(c, shape(F.get(col, cut + i)), st)) for i, c in enumerate(tail)]
    return in_order(steps)


def _check_prepend(o: W.PrependOne, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Arr) or not n.runs:
        return Hit(False)
    col, shape = n.only()
    rest = Arr(((F.slice(col, F.lit(2), F.greatest(F.size(col) - 1, F.lit(0))), shape),))
    return in_order([lambda: Hit(both(no(n.null), F.size(col) > 0)), lambda: check(o.first, shape(F.get(col, F.lit(0))), st), lambda: check(o.rest, rest, st)])


def _matches(o: W.Op, st: Symbols) -> Callable[[Shape], Column]:
    return lambda s: as_column(check(o, s, st.copy()).match)


def _without(col: Column, place: Column) -> Column:
    return F.filter(col, lambda _, i: i != place - 1)


def _check_arr_with(o: W.ArrWith, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Arr) or not n.runs:
        return Hit(False) if not isinstance(n, Arr) else _refuse("taking out of an array without items")
    col, shape = n.only()
    out = Hit(no(n.null))
    for item in o.items:
        if check(item, shape(F.lit(None)), st.copy()).error is not None:
            raise NotColumnar("errors while items are looked for")
        place = F.array_position(_each((col, shape), _matches(item, st)), F.lit(True))
        found = place > 0
        there, absent = st.copy(), st.copy()
        check(item, shape(F.get(col, F.greatest(place - 1, F.lit(0)).cast("int"))), there)
        none = check(item, Const(None), absent)
        joined = st.copy()
        joined.join(found, there, absent)
        st.vars, st.states = joined.vars, joined.states
        out = out.then(lambda found=found, none=none: Hit(either(found, none.good)))
        col = _without(col, place)
    return out.then(lambda: check(o.rest, Arr(((col, shape),)), st))


def _check_comment(o: W.CommentText, n: Shape, st: Symbols) -> Hit:
    if not isinstance(n, Scalar) or n.kind != T.STRING:
        return Hit(False)
    parts = X.comment_columns(F.ltrim(n.col) if o.trim else n.col, o.start, o.end)
    return Hit(F.coalesce(parts["prefix"].isNotNull(), F.lit(False))).then(lambda: in_order((lambda p=p, v=v: st.set(v, Scalar(parts[p], T.STRING, False))) for p, v in o.names.items()))


def _check_not_empty(o: W.NotEmpty, n: Shape, st: Symbols) -> Hit:
    empty = either(n.nil(), *(same(Const(v), n) for v in ([], {}) if isinstance(n, (Obj, Arr))))
    return Hit(no(empty)).then(lambda: check(o.inner, n, st))


_CHECKS = [
    (W.OfKind, lambda o, n, st: Hit(n.kind_in(o.kinds))), (W.Not, _check_not), (W.And, _check_and), (W.Has, _check_has), (W.HasFields, _check_fields_there), (W.In, _check_in), (W.AnyElem, _check_elems), (W.Is, _check_is),
    (W.Var, _check_var), (W.AnyNode, lambda o, n, st: Hit(True)), (W.Seq, lambda o, n, st: in_order((lambda c=c: check(c, n, st)) for c in o.ops)), (W.If, _check_if), (W.Opt, _check_opt), (W.Cases, _check_cases),
    (W.Check, lambda o, n, st: check(o.sel, n, st.copy()).then(lambda: check(o.inner, n, st))), (W.NotEmpty, _check_not_empty), (W.Lookup, _check_lookup), (W.LookupOpVar, _check_lookup_op), (W.Each, _check_each),
    (W.Append, _check_append), (W.PrependOne, _check_prepend), (W.ArrWith, _check_arr_with), (W.CommentText, _check_comment), (W.OpScope, _check_scope), (W.ObjectOp, _check_object), (W.ArrayOp, _check_array),
]


# ---- building --------------------------------------------------------------


@dataclass
class Builder:
    """Makes nodes from symbols; ``errors`` collects what may go wrong at run time."""

    errors: list[Column] = field(default_factory=list)

    def build(self, o: W.Op, st: Symbols) -> Shape:
        if isinstance(o, W.Is):
            return Const(o.value) if not o.value or not isinstance(o.value, (dict, list)) else _constant(o.value)
        if isinstance(o, W.Var):
            return st.get(o.name)
        if isinstance(o, W.AnyNode):
            return self.build(o.create, st) if o.create else Const(None)
        if isinstance(o, (W.Check, W.NotEmpty)):
            out = self.build(o.inner, st)
            if isinstance(o, W.NotEmpty):
                empty = either(out.nil(), *(same(Const(v), out) for v in ([], {}) if isinstance(out, (Obj, Arr))))
                self.fails(empty, "unexpected value")
            return out
        if isinstance(o, (W.If, W.Opt)):
            p = st.get(o.var if isinstance(o, W.If) else o.exists)
            p = p.value if isinstance(p, Const) else p.column()
            other = (lambda: self.build(o.otherwise, st)) if isinstance(o, W.If) else (lambda: Const(None))
            then = lambda: self.build(o.then if isinstance(o, W.If) else o.inner, st)
            return self.choose([(p, then), (True, other)])
        if isinstance(o, W.Cases):
            i = st.get(o.var)
            return self.choose([*((same(Const(k), i), lambda c=c: self.build(c, st)) for k, c in enumerate(o.cases))])
        if isinstance(o, W.LookupOpVar):
            return self.choose([(p, (lambda c=c: self.build(c, st)) if c is not None else None) for p, c in _chosen(o, st)])
        if isinstance(o, W.LookupArrOpVar):
            return self.build(o.chosen, st)
        if isinstance(o, W.Lookup):
            out, known = _looked_up(o.back, self.build(o.inner, st))
            self.fails(no(known), "unhandled value")
            return out
        if isinstance(o, W.Each):
            n, symbols = st.states[o.var] if o.var in st.states else _refuse(f"variable {o.var} is not defined")
            st.read.add(o.var)
            return Arr(tuple(self.build(o.inner, symbols(r)) if isinstance(r, Shape) else self.items(o.inner, r, symbols) for r in n.runs), n.null)
        if isinstance(o, (W.Append, W.PrependOne, W.ArrWith)):
            if isinstance(o, W.Append):
                parts, items = [self.build(o.to, st)], [self.array(o.items, st)]
            elif isinstance(o, W.PrependOne):
                parts, items = [Arr((self.build(o.first, st),)), self.build(o.rest, st)], []
            else:
                parts, items = [self.build(o.rest, st)], [Arr(tuple(self.build(i, st) for i in o.items))]
            runs: list = []
            for p in (*parts, *items):
                if isinstance(p, Const) and p.value in (None, []):
                    continue
                if not isinstance(p, Arr):
                    raise NotColumnar("expected a list")
                if p.null is not False:
                    col, shape = p.only()
                    runs.append((F.coalesce(col, F.filter(col, lambda _: F.lit(False))), shape))
                else:
                    runs += p.runs
            return Arr(tuple(runs))
        if isinstance(o, W.ArrayOp):
            return self.array(o, st)
        if isinstance(o, W.OpScope):
            return self.scoped(o.name, st, lambda own: self.build(o.inner, own))
        if isinstance(o, W.CommentText):
            at = {p: st.get(v).column() for p, v in o.names.items()}
            text = F.replace(at["text"], F.lit("\n"), F.concat(F.lit("\n"), at["indent"]))
            return Scalar(F.concat(F.lit(o.start), at["prefix"], text, at["suffix"], F.lit(o.end)), T.STRING, False)
        if isinstance(o, W.CasesObj):
            return self.build(o.inner, st)
        if isinstance(o, W.ObjectOp):
            return Obj(self.fields(o, st))
        raise NotColumnar(type(o).__name__)

    def items(self, o: W.Op, run: tuple, symbols: Callable[[Shape], Symbols]) -> tuple:
        """A run with every item built anew."""
        col, item = run

        def broken(s: Shape) -> Column:
            inner, own = Builder(), symbols(s)
            inner.build(o, own)
            _all_read(own)
            return first_error(*inner.errors) if inner.errors else F.lit(None).cast("string")

        probe, own = Builder(), symbols(item(F.lit(None)))
        probe.build(o, own)
        _all_read(own)
        if probe.errors:
            self.errors.append(F.get(F.filter(_each(run, broken), lambda e: e.isNotNull()), F.lit(0)))
        return col, lambda x: Builder().build(o, symbols(item(x)))

    def array(self, o: W.ArrayOp, st: Symbols) -> Shape:
        if isinstance(o, W.AppendArr):
            parts = [self.array(a, st) for a in o.arrays]
            return Arr(tuple(r for p in parts for r in (p.runs if isinstance(p, Arr) else _refuse("expected a list"))))
        if isinstance(o, W.LookupArrOpVar):
            return self.build(o.chosen, st)
        return Arr(tuple(self.build(c, st) for c in _ops(o)))

    def scoped(self, name: str, st: Symbols, make: Callable[[Symbols], Any]) -> Any:
        own = st.states.get(name)
        if not isinstance(own, Symbols):
            raise NotColumnar(f"{name} is not one scope")
        st.read.add(name)
        out = make(own)
        _all_read(own)
        return out

    def choose(self, cases: list[tuple[Truth, Callable[[], Shape] | None]]) -> Shape:
        """The first case whose condition holds; errors of the others don't count."""
        out: Shape | None = None
        open_: Truth = True
        made: list[tuple[Truth, Shape]] = []
        for p, make in cases:
            here = both(open_, p)
            if here is False:
                continue
            if make is None:
                self.fails(here, "unhandled value")
            else:
                inner = Builder()
                made.append((p, inner.build_with(make)))
                self.errors += [g for e in inner.errors if (g := guarded(here, e)) is not None]
            open_ = both(open_, no(p))
        for p, s in reversed(made):
            out = s if out is None else merged(p, s, out)
        if out is None:
            raise NotColumnar("nothing to build")
        return out

    def build_with(self, make: Callable[[], Shape]) -> Shape:
        return make()

    def fails(self, p: Truth, why: str) -> None:
        if p is True:
            raise NotColumnar(why)
        if p is not False:
            self.errors.append(F.when(p, F.lit(why)))

    def fields(self, o: W.ObjectOp, st: Symbols) -> dict[str, tuple[Shape, Truth]]:
        out: dict[str, tuple[Shape, Truth]] = {}
        if isinstance(o, W.Fields):
            for f in o.fields:
                there: Truth = True
                if f.optional:
                    flag = st.get(f.optional)
                    there = flag.value if isinstance(flag, Const) else flag.column()
                if there is not False:
                    inner = Builder()
                    out[f.name] = (inner.build(f.op, st), there)
                    self.errors += [g for e in inner.errors if (g := guarded(there, e)) is not None]
                elif f.op is not None:
                    _touch(f.op, st)
            return out
        if isinstance(o, W.Part):
            out = self.fields(o.inner, st)
            rest = st.get(o.var)
            if not isinstance(rest, Obj):
                raise NotColumnar("expected an object")
            for k, (s, p) in rest.fields.items():
                if k in out:
                    self.fails(both(p, out[k][1]), f"duplicate field: {k}")
                    out[k] = (merged(out[k][1], out[k][0], s), either(out[k][1], p))
                else:
                    out[k] = (s, p)
            return out
        if isinstance(o, W.JoinObj):
            for p in o.parts:
                for k, (s, there) in self.fields(p, st).items():
                    if k in out:
                        self.fails(both(there, out[k][1], no(same(s, out[k][0]))), f"duplicate field: {k}")
                        there = either(there, out[k][1])
                    out[k] = (s, there)
            return out
        if isinstance(o, W.CheckObj):
            return self.fields(o.inner, st)
        if isinstance(o, W.ObjOpScope):
            return self.scoped(o.name, st, lambda own: self.fields(o.inner, own))
        if isinstance(o, W.CasesObj):
            made = self.build(o.inner, st)
            return dict(made.fields)
        raise NotColumnar(type(o).__name__)


def _touch(o: W.Op, st: Symbols) -> None:
    """Marks the variables of an operation that is never built as read."""
    if isinstance(o, W.Var) and o.name in st.vars:
        st.read.add(o.name)


def _all_read(st: Symbols) -> None:
    if unused := (st.vars.keys() | st.states.keys()) - st.read:
        raise NotColumnar(f"variables unused: {sorted(unused)}")


def _constant(v: Any) -> Shape:
    if isinstance(v, dict) and v:
        return Obj({k: (_constant(x), True) for k, x in v.items()})
    return Arr(tuple(map(_constant, v))) if isinstance(v, list) and v else Const(v)


# ---- rules -----------------------------------------------------------------


def _applied(rule: W.Rule, n: Shape, guard: Truth) -> tuple[Shape, Column | None]:
    """(the node after one rule, its error); an error leaves the node as it is."""
    st = Symbols()
    hit = check(rule.src, n, st)
    hit = Hit(guard).then(lambda: hit)
    if hit.match is False and hit.error is None:
        return n, None
    made = Builder()
    new = made.build(rule.dst, st)
    _all_read(st)
    broken = first_error(*made.errors)
    good = hit.good if broken is None else both(hit.good, broken.isNull())
    error = first_error(hit.error, guarded(hit.good, broken))
    return merged(good, new, n), error


def rewritten(n: Shape, rules: W.Mappings) -> tuple[Shape, list[Column]]:
    """(the tree after all rules, bottom-up; error texts, each an array column)."""
    errors: list[Column] = []
    if isinstance(n, Obj):
        fields = {}
        for k, (s, p) in n.fields.items():
            s, more = rewritten(s, rules)
            fields[k] = (s, p)
            errors += [e if p is True else F.when(as_column(p), e) for e in more]
        n = Obj(fields, n.null)
    elif isinstance(n, Arr):
        runs = []
        for r in n.runs:
            if isinstance(r, Shape):
                s, more = rewritten(r, rules)
                runs.append(s)
                errors += more
                continue
            runs.append(_rewritten_items(r, rules))
            if rewritten(r[1](F.lit(None)), rules)[1]:
                errors.append(F.flatten(_each(r, lambda s: _together(rewritten(s, rules)[1]))))
        n = Arr(tuple(runs), n.null)
    for rule, guard in _candidates(n, rules):
        n, error = _applied(rule, n, both(guard, no(n.nil())))
        if error is not None:
            errors.append(F.when(error.isNotNull(), F.array(error)))
    return n, errors


def _rewritten_items(run: tuple, rules: W.Mappings) -> tuple:
    col, item = run
    return col, lambda x: rewritten(item(x), rules)[0]


def _together(errors: list[Column]) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(none, *(F.coalesce(e, none) for e in errors))


def _candidates(n: Shape, rules: W.Mappings) -> list[tuple[W.Rule, Truth]]:
    """Rules whose kind fits and whose constant type, if they have one, is or may be the node's."""
    if isinstance(n, Const) and n.value is None:
        return []
    typ, there = n.fields.get(U.TYPE, (Const(None), False)) if isinstance(n, Obj) else (Const(None), False)
    out = []
    for r in rules.rules:
        t = r.src.needs().get(U.TYPE) if isinstance(r.src, W.ObjectOp) else None
        if t and isinstance(t.fixed, str):
            guard = both(there, same(Const(t.fixed), typ))
        else:
            guard = n.kind_in(r.src.kinds)
        if guard is not False:
            out.append((r, guard))
    return out


def rewrite(trees: DataFrame, *rules: Any, shape: Callable[[Column], Shape] | Level | None = None, doc: str = "doc", absent: bool = False) -> DataFrame:
    """(doc_id, doc, errors) of (doc_id, doc): trees as structs, rules compiled to columns.

    ``shape`` tells more of the trees than the column's type does (a level of relational
    trees: constant types).  In the result, fields that are absent are null; ``as_json``
    keeps them apart.  ``absent``: null fields of the input are absent, too.
    """
    n, errors = compiled(trees, *rules, shape=shape, doc=doc, absent=absent)
    return trees.select("doc_id", n.column().alias("doc"), _together(errors).alias("errors"))


def as_json(trees: DataFrame, *rules: Any, shape: Callable[[Column], Shape] | Level | None = None, doc: str = "doc", absent: bool = False) -> DataFrame:
    """The same with documents as JSON text, as ``pipeline.rewrite`` makes them."""
    n, errors = compiled(trees, *rules, shape=shape, doc=doc, absent=absent)
    return trees.select("doc_id", n.json().alias("doc"), _together(errors).alias("errors"))


def compiled(trees: DataFrame, *rules: Any, shape: Callable[[Column], Shape] | Level | None = None, doc: str = "doc", absent: bool = False) -> tuple[Shape, list[Column]]:
    col = F.col(doc)
    if isinstance(shape, Level):
        n: Shape = of_level(shape, col)
    else:
        n = shape(col) if shape else of_type(col, trees.schema[doc].dataType, absent)
    errors: list[Column] = []
    for stage in rules:
        stage = stage if isinstance(stage, W.Mappings) else W.Mappings(stage)
        n, more = rewritten(n, stage)
        errors += more
    return n, errors


def namespaced(n: Shape, ns: str) -> Shape:
    """Types without a namespace get one, everywhere in the tree."""
    if isinstance(n, Obj):
        fields = {k: (namespaced(s, ns), p) for k, (s, p) in n.fields.items()}
        typ, there = n.fields.get(U.TYPE, (None, False))
        if isinstance(typ, Const) and isinstance(typ.value, str) and ":" not in typ.value:
            fields[U.TYPE] = (Const(f"{ns}:{typ.value}"), there)
        elif isinstance(typ, Scalar) and typ.kind == T.STRING:
            fields[U.TYPE] = (Scalar(F.when(F.contains(typ.col, F.lit(":")), typ.col).otherwise(F.concat(F.lit(f"{ns}:"), typ.col)), T.STRING, typ.may), there)
        return Obj(fields, n.null)
    if isinstance(n, Arr):
        return Arr(tuple(namespaced(r, ns) if isinstance(r, Shape) else _namespaced_items(r, ns) for r in n.runs), n.null)
    return n


def _namespaced_items(run: tuple, ns: str) -> tuple:
    col, item = run
    return col, lambda x: namespaced(item(x), ns)


def transform(trees: DataFrame, pipeline: Transforms, mode: int = 0, shape: Callable[[Column], Shape] | Level | None = None, doc: str = "doc") -> DataFrame:
    """(doc_id, doc, errors) of a pipeline of rules up to a mode, compiled: what ``pipeline.transform`` does
    document by document.  Stages that see the source text, and functions, are refused."""
    if pipeline.code:
        raise NotColumnar("stages that see the source text")
    n, _ = compiled(trees, shape=shape, doc=doc)
    errors: list[Column] = []
    ended: Truth = False
    for stage in pipeline.stages(mode):
        if isinstance(stage, W.TransformFunc) and stage.namespace:
            new, more = namespaced(n, stage.namespace), []
        elif isinstance(stage, W.Mappings):
            new, more = rewritten(n, stage)
        else:
            raise NotColumnar(type(stage).__name__)
        # a stage that fails is the last one
        errors += [F.when(~as_column(ended), e) if ended is not False else e for e in more]
        n = merged(ended, n, new)
        ended = either(ended, F.size(_together(more)) > 0 if more else False)
    return trees.select("doc_id", n.column().alias("doc"), _together(errors).alias("errors"))


def matching(trees: DataFrame, selector: Any, shape: Callable[[Column], Shape] | Level | None = None, doc: str = "doc") -> DataFrame:
    """(doc_id, matched): whether a selector holds for the root of each tree; an error is no match."""
    n, _ = compiled(trees, shape=shape, doc=doc)
    return trees.select("doc_id", as_column(check(selector, n, Symbols()).good).alias("matched"))


def matching_level(level: Level, selector: Any) -> DataFrame:
    """The same for the objects of a level of relational trees: what is asked of children is an
    aggregate by parent, so no tree is built.  Rows come per object, with its key as doc_id."""
    return _held(level, selector).select(F.col(level.key).cast("bigint").alias("doc_id"), F.col("_holds").alias("matched"))


def _held(level: Level, selector: Any) -> DataFrame:
    kinds = {f.name: f.dataType for f in level.rows.schema.fields}
    asked: list = []
    own: dict[str, tuple[Shape, Truth]] = {U.TYPE: (Const(level.type), True)}
    own |= {c: (of_type(F.col(c), kinds[c]), True) for c in level.scalars}
    own |= {n: (Listed(kid, asked), True) for n, kid in level.children.items()}
    holds = as_column(check(W.op(selector), Obj(own), Symbols()).good)
    df = level.rows
    for i, (kid, o) in enumerate(asked):
        every = isinstance(o, W.All)
        below = _held(kid, o.sel).groupBy(F.col(kid.parent).alias(level.key)).agg((F.bool_and if every else F.bool_or)("_holds").alias(f"_asked{i}"))
        df = df.join(below, level.key, "left").withColumn(f"_asked{i}", F.coalesce(f"_asked{i}", F.lit(every)))
    return df.withColumn("_holds", holds)
