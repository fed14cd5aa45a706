"""The rewrite algebra: patterns and templates that share variables.

A rule is a pair of operations.  ``check`` matches a node and binds variables in
a state; ``build`` makes a node from a state.  Every operation works in both
directions, so a rule can be reversed.  A pattern either matches, does not match
(False), or fails (``RuleError``): wrong kinds, constants, lengths and missing
fields do not match; uncovered fields, conflicting variables and unmapped
lookups fail.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from ..functions import roles as R
from ..functions import text as X
from ..functions import tree as T
from ..functions import uast as U

class _MISSING:
    """Stands for no value; a class, so that it stays itself when a rule travels to a task."""


#: Kinds of rule errors.
ERRORS = (
    "variable redeclared", "variable not defined", "variables unused", "expected object", "expected list", "expected value",
    "unhandled value", "unexpected node", "unexpected value", "unexpected type", "ambiguous value", "unused field", "duplicate field", "undefined field",
)


class RuleError(Exception):
    def __init__(self, kind: str, detail: Any = ""):
        assert kind in ERRORS
        self.kind = kind
        super().__init__(f"{kind}: {detail}" if detail != "" else kind)


class MultiError(Exception):
    def __init__(self, errors: Sequence[Exception]):
        self.errors = list(errors)
        super().__init__("received {} errors:\n\t{}".format(len(self.errors), "\n\t".join(map(str, self.errors))))


def multi_error(errors: Sequence[Exception]) -> Exception | None:
    """None, the one error, or all of them together."""
    return None if not errors else errors[0] if len(errors) == 1 else MultiError(errors)


class State:
    """Variables bound by a match; lists of sub-states under names of their own."""

    def __init__(self):
        self.vars: dict[str, Any] = {}
        self.states: dict[str, list[State] | None] = {}
        self.unused: set[str] = set()

    def reset(self) -> None:
        self.__init__()

    def clone(self) -> State:
        out = State()
        out.vars, out.states, out.unused = dict(self.vars), dict(self.states), set(self.unused)
        return out

    def apply_from(self, other: State) -> None:
        """Take over what is not bound yet."""
        for k, v in other.vars.items():
            if k not in self.vars:
                self.vars[k] = v
                self.unused.add(k)
        for k, s in other.states.items():
            self.states.setdefault(k, s)
        self.unused -= {k for k in other.vars if k not in other.unused}

    def set(self, name: str, value: Any) -> None:
        if name in self.vars:
            if not T.equal(self.vars[name], value):
                raise RuleError("variable redeclared", f"{name}: {self.vars[name]!r} vs {value!r}")
            return
        self.vars[name] = value
        self.unused.add(name)

    def set_all(self, values: Mapping[str, Any]) -> None:
        for k, v in values.items():
            self.set(k, v)

    def get(self, name: str, default: Any = _MISSING) -> Any:
        if name not in self.vars:
            if default is _MISSING:
                raise RuleError("variable not defined", name)
            return default
        self.unused.discard(name)
        return self.vars[name]

    def get_states(self, name: str) -> list[State] | None:
        if name not in self.states:
            raise RuleError("variable not defined", name)
        return self.states[name]

    def set_states(self, name: str, states: list[State] | None) -> None:
        if name in self.states:
            raise RuleError("variable redeclared", name)
        self.states[name] = states

    def validate(self) -> None:
        if self.unused:
            raise RuleError("variables unused", sorted(self.unused))
        for own in self.states.values():
            for s in own or []:
                s.validate()


@dataclass(frozen=True)
class Need:
    """What is known of a field before matching: may it be absent, and its constant if it has one."""

    optional: bool = False
    fixed: Any = _MISSING
    sel: Any = None

    def admits(self, obj: dict, name: str) -> bool:
        if name not in obj:
            return self.optional
        return self.fixed is _MISSING or T.equal(obj[name], self.fixed)


class Sel:
    """A predicate on nodes."""

    kinds = T.ANY

    def check(self, st: State, n: Any) -> bool:
        raise NotImplementedError

    def matches(self, n: Any) -> bool:
        return self.check(State(), n)


class Op(Sel):
    """A predicate that can also build."""

    def build(self, st: State, base: Any = None) -> Any:
        raise NotImplementedError

    def mapping(self) -> tuple[Op, Op]:
        return self, self


class ObjectOp(Op):
    """An operation on objects.  ``needs`` lists fields it covers; ``full`` is False if others may follow."""

    kinds = T.OBJECT
    full = True

    def needs(self) -> dict[str, Need]:
        return {}

    def check(self, st: State, n: Any) -> bool:
        if not isinstance(n, dict) or not all(f.admits(n, k) for k, f in self.needs().items()):
            return False
        used = self.check_fields(st, n)
        if used is None:
            return False
        if self.full and (rest := set(n) - used):
            raise RuleError("unused field", f"{sorted(rest)} of {sorted(n)}")
        return True

    def check_fields(self, st: State, obj: dict) -> set[str] | None:
        """Names of the fields covered, or None: no match."""
        raise NotImplementedError

    def build_fields(self, st: State, out: dict) -> None:
        raise NotImplementedError

    def build(self, st: State, base: Any = None) -> Any:
        if base is not None and not isinstance(base, dict):
            raise RuleError("expected object", T.kind_name(T.kind_of(base)))
        out = dict(base or {})
        self.build_fields(st, out)
        return out


class ArrayOp(Op):
    kinds = T.ARRAY

    def ops(self, st: State) -> list[Op]:
        """The items, of a length that is known once variables are."""
        raise NotImplementedError

    def check(self, st: State, n: Any) -> bool:
        if not isinstance(n, list):
            return False
        own = self.ops(st)
        return len(own) == len(n) and all(op.check(st, v) for op, v in zip(own, n, strict=True))

    def build(self, st: State, base: Any = None) -> Any:
        _no_base(base)
        return [op.build(st) for op in self.ops(st)]


def _no_base(base: Any) -> None:
    if base is not None:
        raise RuleError("unexpected node", T.kind_name(T.kind_of(base)))


def op(o: Any) -> Op:
    """An operation as it is; a dict of operations as an exact object; a list as an array; else a constant."""
    if isinstance(o, Sel):
        return o
    if isinstance(o, dict):
        return Obj(o)
    if isinstance(o, list):
        return Arr(*o)
    return Is(o)


# ---- selectors -----------------------------------------------------------


class Is(Op):
    """Equal to a constant, which it builds."""

    def __init__(self, value: Any):
        self.value = T.to_node(value)
        self.kinds = T.kind_of(self.value)
        if self.kinds & (T.INT | T.UINT):
            self.kinds = T.INT | T.UINT

    def check(self, st: State, n: Any) -> bool:
        return T.equal(self.value, n)

    def build(self, st: State, base: Any = None) -> Any:
        _no_base(base)
        return T.clone(self.value)


def String(s: str) -> Op:
    return Is(str(s))


def Int(i: int) -> Op:
    return Is(int(i))


def UintIs(i: int) -> Op:
    return Is(T.Uint(i))


def Bool(b: bool) -> Op:
    return Is(bool(b))


def EmptyObj() -> Op:
    return Is({})


class OfKind(Sel):
    def __init__(self, kinds: int):
        self.kinds = kinds

    def check(self, st: State, n: Any) -> bool:
        return bool(T.kind_of(n) & self.kinds)


class Not(Sel):
    def __init__(self, sel: Any):
        self.sel = op(sel)
        self.kinds = T.ANY & ~sel.kinds if isinstance(sel, OfKind) else T.ANY

    def check(self, st: State, n: Any) -> bool:
        return not self.sel.check(st.clone(), n)


class ObjNot(Not):
    """An object that does not match."""

    def __init__(self, sel: Any):
        super().__init__(sel)
        self.kinds = T.OBJECT

    def check(self, st: State, n: Any) -> bool:
        return isinstance(n, dict) and super().check(st, n)


def NotNil() -> Sel:
    return Not(OfKind(T.NIL))


class And(Sel):
    def __init__(self, *sels: Any):
        self.sels = [op(s) for s in sels]
        self.kinds = T.ANY
        for s in self.sels:
            self.kinds &= s.kinds

    def check(self, st: State, n: Any) -> bool:
        own = st.clone()
        return all(s.check(own, n) for s in self.sels)


class Has(Sel):
    """An object whose listed fields exist and match; other fields don't matter."""

    kinds = T.OBJECT

    def __init__(self, fields: Mapping[str, Any]):
        self.fields = {k: op(v) for k, v in sorted(fields.items())}

    def check(self, st: State, n: Any) -> bool:
        own = st.clone()
        return isinstance(n, dict) and all(k in n and s.check(own, n[k]) for k, s in self.fields.items())


def HasType(name: str) -> Sel:
    return Has({U.TYPE: Is(name)})


class HasFields(Sel):
    """An object that has the fields marked True and lacks those marked False."""

    kinds = T.OBJECT

    def __init__(self, fields: Mapping[str, bool]):
        self.fields = dict(fields)

    def check(self, st: State, n: Any) -> bool:
        return isinstance(n, dict) and all((k in n) == want for k, want in self.fields.items())


class In(Sel):
    """One of some scalars (or nil), of the same kind and value."""

    def __init__(self, *values: Any):
        self.values = {T.unique_key(T.to_node(v)) for v in values}
        self.kinds = 0
        for v in values:
            self.kinds |= T.kind_of(v)

    def check(self, st: State, n: Any) -> bool:
        return not isinstance(n, (dict, list)) and T.unique_key(n) in self.values


class AnyElem(Sel):
    kinds = T.ARRAY

    def __init__(self, sel: Any):
        self.sel = op(sel)

    def check(self, st: State, n: Any) -> bool:
        return isinstance(n, list) and any(self.sel.check(st.clone(), v) for v in n)


class All(AnyElem):
    def check(self, st: State, n: Any) -> bool:
        return isinstance(n, list) and all(self.sel.check(st.clone(), v) for v in n)


class Check(Op):
    """A guard that binds nothing, then an operation."""

    def __init__(self, sel: Any, inner: Any):
        self.sel, self.inner = op(sel), op(inner)
        self.kinds = self.sel.kinds & self.inner.kinds

    def check(self, st: State, n: Any) -> bool:
        return self.sel.check(st.clone(), n) and self.inner.check(st, n)

    def build(self, st: State, base: Any = None) -> Any:
        return self.inner.build(st, base)


class CheckObj(ObjectOp):
    def __init__(self, sel: Any, inner: ObjectOp):
        self.sel, self.inner = op(sel), inner
        self.full = inner.full

    def needs(self):
        return self.inner.needs()

    def check_fields(self, st: State, obj: dict):
        return self.inner.check_fields(st, obj) if self.sel.check(st.clone(), obj) else None

    def build_fields(self, st: State, out: dict) -> None:
        self.inner.build_fields(st, out)


class NotEmpty(Op):
    """Neither nil nor an empty array or object, in both directions."""

    def __init__(self, inner: Any):
        self.inner = op(inner)
        self.kinds = self.inner.kinds & T.NOT_NIL

    @staticmethod
    def _empty(n: Any) -> bool:
        return n is None or (isinstance(n, (dict, list)) and not n)

    def check(self, st: State, n: Any) -> bool:
        return not self._empty(n) and self.inner.check(st, n)

    def build(self, st: State, base: Any = None) -> Any:
        out = self.inner.build(st, base)
        if self._empty(out):
            raise RuleError("unexpected value", out)
        return out


# ---- variables and control -----------------------------------------------


class Var(Op):
    """Binds a node of any kind; builds the same node."""

    def __init__(self, name: str, kinds: int = T.ANY):
        self.name, self.kinds = name, kinds

    def check(self, st: State, n: Any) -> bool:
        if not T.kind_of(n) & self.kinds:
            return False
        st.set(self.name, n)
        return True

    def build(self, st: State, base: Any = None) -> Any:
        _no_base(base)
        return st.get(self.name)


def VarKind(name: str, kinds: int) -> Op:
    return Var(name, kinds)


class AnyNode(Op):
    """Matches and forgets anything; builds with ``create`` (nil without it)."""

    def __init__(self, create: Any = None):
        self.create = op(create) if create is not None else None

    def check(self, st: State, n: Any) -> bool:
        return True

    def build(self, st: State, base: Any = None) -> Any:
        return self.create.build(st, base) if self.create else None


def Any_() -> Op:
    return AnyNode()


def AnyVal(value: Any = None) -> Op:
    return AnyNode(Is(value))


class Seq(Op):
    """All operations on the same node; building chains them."""

    def __init__(self, *ops: Any):
        self.ops = [op(o) for o in ops]
        self.kinds = T.ANY
        for o in self.ops:
            self.kinds &= o.kinds

    def check(self, st: State, n: Any) -> bool:
        return all(o.check(st, n) for o in self.ops)

    def build(self, st: State, base: Any = None) -> Any:
        for o in self.ops:
            base = o.build(st, base)
        return base


def _attempt(o: Op, st: State, n: Any) -> tuple[State | None, RuleError | None]:
    """(the variables after a match, the error of an attempt that failed); neither: no match."""
    own = st.clone()
    try:
        return (own, None) if o.check(own, n) else (None, None)
    except RuleError as e:
        return None, e


class If(Op):
    """Tries the first operation, then the other; a variable holds which one it was.
    If neither matches, the first error counts."""

    def __init__(self, var: str, then: Any, otherwise: Any):
        self.var, self.then, self.otherwise = var, op(then), op(otherwise)
        self.kinds = self.then.kinds | self.otherwise.kinds

    def check(self, st: State, n: Any) -> bool:
        failed = None
        for which, choice in ((True, self.then), (False, self.otherwise)):
            bound, error = _attempt(choice, st, n)
            if bound is not None:
                st.apply_from(bound)
                st.set(self.var, which)
                return True
            failed = failed or error
        if failed:
            raise failed
        return False

    def build(self, st: State, base: Any = None) -> Any:
        return (self.then if st.get(self.var) else self.otherwise).build(st, base)


class Opt(Op):
    """A node that may be nil; a variable holds whether it is there."""

    def __init__(self, exists: str, inner: Any):
        self.exists, self.inner = exists, op(inner)
        self.kinds = T.NIL | self.inner.kinds

    def check(self, st: State, n: Any) -> bool:
        st.set(self.exists, n is not None)
        return n is None or self.inner.check(st, n)

    def build(self, st: State, base: Any = None) -> Any:
        return self.inner.build(st, base) if st.get(self.exists) else None


class Cases(Op):
    """The first operation that matches; a variable holds its number.  An error ends the search."""

    def __init__(self, var: str, *cases: Any):
        self.var, self.cases = var, [op(c) for c in cases]
        self.kinds = 0
        for c in self.cases:
            self.kinds |= c.kinds

    def check(self, st: State, n: Any) -> bool:
        tried = (_attempt(c, st, n) for c in self.cases)
        number, (bound, error) = next(((k, t) for k, t in enumerate(tried) if any(x is not None for x in t)), (-1, (None, None)))
        if error:
            raise error
        if bound is None:
            return False
        st.apply_from(bound)
        st.set(self.var, number)
        return True

    def build(self, st: State, base: Any = None) -> Any:
        i = st.get(self.var)
        if not 0 <= i < len(self.cases):
            raise RuleError("unhandled value", i)
        return self.cases[i].build(st, base)


class CasesObj(ObjectOp):
    """Like ``Cases`` for objects that share common fields; all cases cover the same fields."""

    def __init__(self, var: str, common: ObjectOp | None, cases: Sequence[ObjectOp]):
        if len({frozenset(c.needs()) for c in cases}) > 1:
            raise ValueError("all cases must have the same fields")
        self.inner = Cases(var, *(JoinObj(common, c) if common else c for c in cases))

    def check(self, st: State, n: Any) -> bool:
        return self.inner.check(st, n)

    def build(self, st: State, base: Any = None) -> Any:
        return self.inner.build(st, base)

    def needs(self):
        return {k: Need(f.optional) for k, f in self.inner.cases[0].needs().items()} if self.inner.cases else {}

    def check_fields(self, st: State, obj: dict):
        own = {k: v for k, v in obj.items() if k in self.needs()}
        return set(own) if self.inner.check(st, own) else None

    def build_fields(self, st: State, out: dict) -> None:
        out |= self.inner.build(st)


# ---- objects -------------------------------------------------------------


@dataclass
class Field:
    """``optional`` names the variable that holds whether the key is there; ``drop`` checks and then leaves it out."""

    name: str
    op: Any
    optional: str = ""
    drop: bool = False


class Fields(ObjectOp):
    """An object with these fields, matched in the given order."""

    def __init__(self, *fields: Field):
        self.fields = [Field(f.name, op(f.op), f.optional, f.drop) for f in fields]
        if len({f.name for f in self.fields}) < len(self.fields):
            raise RuleError("duplicate field", [f.name for f in self.fields])

    def needs(self):
        return {f.name: Need(bool(f.optional) or f.drop, f.op.value if type(f.op) is Is else _MISSING, f.op) for f in self.fields}

    def check_fields(self, st: State, obj: dict):
        for f in self.fields:
            there = f.name in obj
            if f.optional:
                st.set(f.optional, there)
            if not there:
                if f.optional or f.drop:
                    continue
                return None
            if not f.op.check(st, obj[f.name]):
                return None
        return {f.name for f in self.fields if f.name in obj}

    def build_fields(self, st: State, out: dict) -> None:
        for f in self.fields:
            if f.optional and not st.get(f.optional):
                continue
            out[f.name] = f.op.build(st)


class Obj(Fields):
    """An object with exactly these fields, matched in the order of their names."""

    def __init__(self, fields: Mapping[str, Any] | None = None):
        super().__init__(*(Field(k, v) for k, v in sorted((fields or {}).items())))


def TypedObj(typ: str, fields: Mapping[str, Any] | None = None) -> Obj:
    """An object of one type with exactly these fields beside it."""
    return Obj({**(fields or {}), U.TYPE: Is(typ)})


def Objs(*fields: Mapping[str, Any]) -> list[ObjectOp]:
    """Several exact objects, as the cases of ``CasesObj``."""
    return [Obj(f) for f in fields]


def Objects(*ops: Any) -> list[ObjectOp]:
    """Several object operations of any sort, as the cases of ``CasesObj``."""
    own = [op(o) for o in ops]
    if bad := [o for o in own if not isinstance(o, ObjectOp)]:
        raise TypeError(f"expected object operations, got {type(bad[0]).__name__}")
    return own


def needed(o: Sel) -> Sel:
    """What must hold of a node before an object operation is tried: its kind, the fields that must
    be there, and their constants.  A selector, so that it can be pushed down as a filter."""
    if not isinstance(o, ObjectOp):
        return OfKind(o.kinds)
    own = o.needs()
    there = {k: AnyNode() if f.fixed is _MISSING else Is(f.fixed) for k, f in own.items() if not f.optional}
    return And(OfKind(T.OBJECT), Has(there)) if there else OfKind(T.OBJECT)


class Part(ObjectOp):
    """The listed fields; all others are kept in a variable and put back."""

    full = False

    def __init__(self, var: str, inner: Any):
        self.var, self.inner = var, op(inner)
        if not self.inner.full:
            raise ValueError("a partial operation can't be partial again")

    def needs(self):
        return self.inner.needs()

    def check_fields(self, st: State, obj: dict):
        known = self.inner.needs()
        if self.inner.check_fields(st, {k: v for k, v in obj.items() if k in known}) is None:
            return None
        st.set(self.var, {k: v for k, v in obj.items() if k not in known})
        return set(obj)

    def build_fields(self, st: State, out: dict) -> None:
        self.inner.build_fields(st, out)
        rest = st.get(self.var)
        if not isinstance(rest, dict):
            raise RuleError("expected object", self.var)
        for k, v in rest.items():
            if k in out:
                raise RuleError("duplicate field", k)
            out[k] = v


class JoinObj(ObjectOp):
    """Disjoint object operations as one.  Equal constants may repeat; at most one part is partial."""

    def __init__(self, *parts: Any):
        own: list[ObjectOp] = []
        for p in map(op, parts):
            if not isinstance(p, ObjectOp):
                raise TypeError("expected object operations")
            own += p.parts if isinstance(p, JoinObj) else [p] if p.needs() or not p.full else []
        self.partial = [p for p in own if not p.full]
        if len(self.partial) > 1:
            raise ValueError("only one partial operation can be joined")
        self.full = not self.partial
        seen: dict[str, Need] = {}
        for p in own:
            for k, f in p.needs().items():
                if k in seen and (f.fixed is _MISSING or seen[k].fixed is _MISSING or not T.equal(f.fixed, seen[k].fixed)):
                    raise RuleError("duplicate field", k)
                seen[k] = f
        self.parts, self._needs = own, seen

    def needs(self):
        return self._needs

    def check_fields(self, st: State, obj: dict):
        used: set[str] = set()
        for p in [p for p in self.parts if p.full]:
            known = p.needs()
            if p.check_fields(st, {k: v for k, v in obj.items() if k in known}) is None:
                return None
            used |= set(known) & set(obj)
        for p in self.partial:
            if p.check_fields(st, {k: v for k, v in obj.items() if k not in used}) is None:
                return None
            used = set(obj)
        return used

    def build_fields(self, st: State, out: dict) -> None:
        for p in self.parts:
            made: dict = {}
            p.build_fields(st, made)
            for k, v in made.items():
                if k in out and not T.equal(out[k], v):
                    raise RuleError("duplicate field", k)
                out[k] = v


class OpScope(Op):
    """Runs in variables of its own, kept under a name."""

    def __init__(self, name: str, inner: Any):
        self.name, self.inner = name, op(inner)
        self.kinds = self.inner.kinds

    def check(self, st: State, n: Any) -> bool:
        own = State()
        if not self.inner.check(own, n):
            return False
        st.set_states(self.name, [own])
        return True

    def build(self, st: State, base: Any = None) -> Any:
        own = st.get_states(self.name) or []
        if len(own) != 1:
            raise RuleError("ambiguous value", f"{len(own)} states for {self.name}")
        return self.inner.build(own[0], base)


class ObjOpScope(ObjectOp):
    def __init__(self, name: str, inner: ObjectOp):
        self.name, self.inner, self.full = name, inner, inner.full

    def needs(self):
        return self.inner.needs()

    def check_fields(self, st: State, obj: dict):
        own = State()
        used = self.inner.check_fields(own, obj)
        if used is not None:
            st.set_states(self.name, [own])
        return used

    def build_fields(self, st: State, out: dict) -> None:
        own = st.get_states(self.name) or []
        if len(own) != 1:
            raise RuleError("ambiguous value", f"{len(own)} states for {self.name}")
        self.inner.build_fields(own[0], out)


class Lookup(Op):
    """Maps values one to one; an unmapped value is an error."""

    def __init__(self, inner: Any, table: Mapping[Any, Any]):
        self.inner, self.forth, self.back = op(inner), {}, {}
        for k, v in table.items():
            if T.unique_key(v) in self.back:
                raise RuleError("ambiguous value", v)
            self.forth[T.unique_key(k)], self.back[T.unique_key(v)] = v, k

    def check(self, st: State, n: Any) -> bool:
        if isinstance(n, (dict, list)):
            return False
        if T.unique_key(n) not in self.forth:
            raise RuleError("unhandled value", n)
        return self.inner.check(st, self.forth[T.unique_key(n)])

    def build(self, st: State, base: Any = None) -> Any:
        v = self.inner.build(st, base)
        if isinstance(v, (dict, list)):
            raise RuleError("expected value", v)
        if T.unique_key(v) not in self.back:
            raise RuleError("unhandled value", v)
        return self.back[T.unique_key(v)]


def LookupVar(name: str, table: Mapping[Any, Any]) -> Op:
    return Lookup(Var(name), table)


class LookupOpVar(Op):
    """Chooses an operation by a variable; the key None is the default."""

    def __init__(self, var: str, cases: Mapping[Any, Any]):
        own = dict(cases)
        self.default = op(own.pop(None)) if None in own else None
        self.var, self.cases = var, {T.unique_key(k): op(v) for k, v in own.items()}

    def choose(self, st: State) -> Op:
        v = st.get(self.var)
        if isinstance(v, (dict, list)):
            raise RuleError("expected value", v)
        found = self.cases.get(T.unique_key(v), self.default)
        if found is None:
            raise RuleError("unhandled value", v)
        return found

    def check(self, st: State, n: Any) -> bool:
        return self.choose(st).check(st, n)

    def build(self, st: State, base: Any = None) -> Any:
        return self.choose(st).build(st, base)


class ValueConv(Op):
    """A conversion and its inverse around an operation; TypeError from either means no match."""

    kinds = T.VALUES

    def __init__(self, inner: Any, forth: Callable[[Any], Any], back: Callable[[Any], Any]):
        self.inner, self.forth, self.back = op(inner), forth, back

    def check(self, st: State, n: Any) -> bool:
        if not T.kind_of(n) & self.kinds:
            return False
        try:
            v = self.forth(n)
        except TypeError:
            return False
        return self.inner.check(st, v)

    def build(self, st: State, base: Any = None) -> Any:
        return self.back(self.inner.build(st, base))


class StringConv(ValueConv):
    kinds = T.STRING

    def build(self, st: State, base: Any = None) -> Any:
        v = self.inner.build(st, base)
        if not isinstance(v, str):
            raise RuleError("unexpected type", T.kind_name(T.kind_of(v)))
        return self.back(v)


def Quote(inner: Any) -> Op:
    return StringConv(inner, X.unquote, X.quote)


def UncommentCLike(var: str) -> Op:
    return StringConv(Var(var), X.uncomment_c, X.comment_c)


def Uncomment(var: str, start: str, end: str) -> Op:
    return StringConv(Var(var), lambda s: X.uncomment(s, start, end), lambda s: start + s + end)


# ---- arrays --------------------------------------------------------------


class Arr(ArrayOp):
    def __init__(self, *ops: Any):
        self._ops = [op(o) for o in ops]

    def ops(self, st: State) -> list[Op]:
        return self._ops


def One(inner: Any) -> ArrayOp:
    return Arr(inner)


class LookupArrOpVar(ArrayOp):
    """Chooses an array operation by a variable; the key None is the default."""

    def __init__(self, var: str, cases: Mapping[Any, ArrayOp]):
        self.chosen = LookupOpVar(var, cases)

    def ops(self, st: State) -> list[Op]:
        return self.chosen.choose(st).ops(st)


class AppendArr(ArrayOp):
    """Arrays of fixed length one after another."""

    def __init__(self, *arrays: ArrayOp):
        self.arrays = arrays

    def ops(self, st: State) -> list[Op]:
        return [o for a in self.arrays for o in a.ops(st)]


class Append(Op):
    """Fixed items at the end; what stands before goes to another operation."""

    kinds = T.ARRAY

    def __init__(self, to: Any, *items: ArrayOp):
        self.to, self.items = op(to), AppendArr(*items)

    def check(self, st: State, n: Any) -> bool:
        if not isinstance(n, list):
            return False
        tail = self.items.ops(st)
        cut = len(n) - len(tail)
        return cut >= 0 and self.to.check(st, n[:cut]) and all(o.check(st, v) for o, v in zip(tail, n[cut:], strict=True))

    def build(self, st: State, base: Any = None) -> Any:
        head = self.to.build(st, base)
        if head is not None and not isinstance(head, list):
            raise RuleError("expected list", T.kind_name(T.kind_of(head)))
        return [*(head or []), *(o.build(st) for o in self.items.ops(st))]


class PrependOne(Op):
    """A first item and the rest."""

    kinds = T.ARRAY

    def __init__(self, first: Any, rest: Any):
        self.first, self.rest = op(first), op(rest)

    def check(self, st: State, n: Any) -> bool:
        return isinstance(n, list) and bool(n) and self.first.check(st, n[0]) and self.rest.check(st, n[1:])

    def build(self, st: State, base: Any = None) -> Any:
        first, rest = self.first.build(st), self.rest.build(st)
        if rest is not None and not isinstance(rest, list):
            raise RuleError("expected list", T.kind_name(T.kind_of(rest)))
        return [first, *(rest or [])]


class Each(Op):
    """Every item matches, each in variables of its own; nil and the empty array stay apart."""

    kinds = T.ARRAY | T.NIL

    def __init__(self, var: str, inner: Any):
        self.var, self.inner = var, op(inner)

    def check(self, st: State, n: Any) -> bool:
        if n is not None and not isinstance(n, list):
            return False
        states = None if n is None else []
        for v in n or []:
            own = State()
            if not self.inner.check(own, v):
                return False
            states.append(own)
        st.set_states(self.var, states)
        return True

    def build(self, st: State, base: Any = None) -> Any:
        _no_base(base)
        own = st.get_states(self.var)
        return None if own is None else [self.inner.build(s) for s in own]


class ArrWith(Op):
    """For each item operation the first element that matches is taken out (nil if none does); the rest goes on."""

    kinds = T.ARRAY

    def __init__(self, rest: Any, *items: Any):
        self.rest, self.items = op(rest), [op(i) for i in items]

    def check(self, st: State, n: Any) -> bool:
        if not isinstance(n, list):
            return False
        left = list(n)
        for item in self.items:
            tried = ((i, *_attempt(item, st, v)) for i, v in enumerate(left))
            place, bound, error = next((t for t in tried if t[1] is not None or t[2]), (None, None, None))
            if error:
                raise error
            if bound is not None:
                st.apply_from(bound)
                left.pop(place)
            elif not item.check(st, None):
                return False
        return self.rest.check(st, left)

    def build(self, st: State, base: Any = None) -> Any:
        rest = self.rest.build(st, base)
        if rest is not None and not isinstance(rest, list):
            raise RuleError("expected list", T.kind_name(T.kind_of(rest)))
        return [*(rest or []), *(i.build(st) for i in self.items)]


# ---- rules and stages ----------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A pattern and a template."""

    src: Op
    dst: Op

    def mapping(self) -> tuple[Op, Op]:
        return self.src, self.dst

    def apply(self, n: Any) -> tuple[Any, bool]:
        st = State()
        if not self.src.check(st, n):
            return n, False
        return self.dst.build(st), True

    def do(self, root: Any) -> Any:
        """This rule alone, bottom-up over a tree."""
        return Mappings(self).do(root)


def Map(src: Any, dst: Any) -> Rule:
    return Rule(op(src), op(dst))


MapObj = Map


def Identity(o: Any) -> Rule:
    return Rule(op(o), op(o))


def Reverse(m: Any) -> Rule:
    src, dst = m.mapping()
    return Rule(dst, src)


def MapPart(var: str, m: Any) -> Rule:
    src, dst = m.mapping()
    if src.full != dst.full:
        raise ValueError("either both sides are partial or none")
    return Rule(src, dst) if not src.full else Rule(Part(var, src), Part(var, dst))


def MapEach(var: str, m: Any) -> Rule:
    src, dst = m.mapping()
    return Rule(Each(var, src), Each(var, dst))


def Scope(name: str, m: Any) -> Rule:
    src, dst = m.mapping()
    return Rule(OpScope(name, src), OpScope(name, dst))


def ObjScope(name: str, m: Any) -> Rule:
    src, dst = m.mapping()
    return Rule(ObjOpScope(name, src), ObjOpScope(name, dst))


def ObjMap(fields: Mapping[str, Any]) -> Rule:
    """Field by field: each a pair of operations."""
    pairs = {k: m.mapping() for k, m in fields.items()}
    return Rule(Obj({k: s for k, (s, _) in pairs.items()}), Obj({k: d for k, (_, d) in pairs.items()}))


class Mappings:
    """A stage: all rules, in order, on every node, bottom-up.

    Candidates are chosen by kind and, for typed objects, by constant type, from the
    node as it was before the first rule; each rule sees what earlier ones made.  An
    error leaves the node as it was before that rule; errors of all nodes are
    reported together with the partly rewritten tree.
    """

    def __init__(self, *rules: Any):
        self.rules = [r if isinstance(r, Rule) else Rule(*r.mapping()) for r in rules]
        typed: dict[str, list[int]] = {}
        open_: list[int] = []
        for i, r in enumerate(self.rules):
            t = r.src.needs().get(U.TYPE) if isinstance(r.src, ObjectOp) else None
            if t and isinstance(t.fixed, str):
                typed.setdefault(t.fixed, []).append(i)
            else:
                open_.append(i)
        self.by_kind = {k: [self.rules[i] for i in open_ if self.rules[i].src.kinds & k] for k in T.KIND_NAMES}
        self.by_type = {t: [self.rules[i] for i in sorted(own + [j for j in open_ if self.rules[j].src.kinds & T.OBJECT])] for t, own in typed.items()}

    @property
    def types(self) -> list[str]:
        """Types with rules of their own: other typed objects meet only untyped rules."""
        return sorted(self.by_type)

    def run(self, root: Any) -> tuple[Any, list[Exception]]:
        errors: list[Exception] = []

        def rewrite(n: Any) -> tuple[Any, bool]:
            rules = self.by_type.get(U.type_of(n)) if isinstance(n, dict) else None
            changed = False
            for r in self.by_kind[T.kind_of(n)] if rules is None else rules:
                st = State()
                try:
                    if not r.src.check(st, n):
                        continue
                    n = r.dst.build(st)
                    changed = True
                    st.validate()
                except (RuleError, ValueError) as e:
                    errors.append(e)
            return n, changed

        out, _ = T.apply(root, rewrite)
        return out, errors

    def do(self, root: Any) -> Any:
        out, errors = self.run(root)
        if errors:
            raise multi_error(errors)
        return out


class TransformFunc:
    """A function of a node that returns (node, changed), bottom-up; all errors are collected."""

    namespace = ""  # of the function that gives types one

    def __init__(self, f: Callable[[Any], tuple[Any, bool]]):
        self.f = f

    def run(self, root: Any) -> tuple[Any, list[Exception]]:
        errors: list[Exception] = []

        def rewrite(n):
            try:
                return self.f(n)
            except (RuleError, ValueError, TypeError, KeyError) as e:
                errors.append(e)
                return n, False

        return T.apply(root, rewrite)[0], errors

    def do(self, root: Any) -> Any:
        out, errors = self.run(root)
        if errors:
            raise multi_error(errors)
        return out


def TransformObjFunc(f: Callable[[dict], tuple[Any, bool]]) -> TransformFunc:
    return TransformFunc(lambda n: f(n) if isinstance(n, dict) else (n, False))


def Transformers(*stages: Any) -> list:
    """Stages, and lists of stages, as one list."""
    out: list = []
    for s in stages:
        out += s if isinstance(s, (list, tuple)) else [s]
    return out


def DefaultNamespace(ns: str) -> TransformFunc:
    """Prefixes types that have no namespace."""

    def f(obj: dict):
        t = obj.get(U.TYPE)
        if not isinstance(t, str) or ":" in t:
            return obj, False
        return obj | {U.TYPE: f"{ns}:{t}"}, True

    out = TransformObjFunc(f)
    out.namespace = ns
    return out


# ---- roles ---------------------------------------------------------------


def Roles(*names: str) -> ArrayOp:
    if bad := [n for n in names if n not in R.ROLES]:
        raise ValueError(f"unknown roles: {bad}")
    return Arr(*(Is(n) for n in names))


def AppendRoles(old: ArrayOp | None, *names: str) -> ArrayOp:
    return Roles(*names) if old is None else AppendArr(old, Roles(*names)) if names else old


def RolesFieldOp(var: str, old: ArrayOp | None, *names: str) -> Field:
    """The role field: kept as it is, or with roles appended after those already there."""
    if not names and old is None:
        return Field(U.ROLE, Var(var), optional=f"{var}_exists")
    more = AppendRoles(old, *names)
    return Field(U.ROLE, If(f"{var}_exists", Append(NotEmpty(Var(var)), more), more))


def RolesField(var: str, *names: str) -> Field:
    return RolesFieldOp(var, None, *names)


def _plain(o: ObjectOp, what: str) -> None:
    if not o.full or U.ROLE in o.needs():
        raise ValueError(f"{what} must list its fields, and not the roles")


def ASTObjectLeft(typ: str, ast: ObjectOp) -> ObjectOp:
    _plain(ast, "the native side")
    own = [Field(U.TYPE, Is(typ))] if typ else []
    return Part("_", JoinObj(ast, Fields(*own, RolesField(f"{typ}_roles"))))


def ASTObjectRightCustom(typ: str, norm: ObjectOp, by_type: Callable[[str], Sequence[str]] | None, rop: ArrayOp | None, *names: str) -> ObjectOp:
    _plain(norm, "the normalised side")
    own = [Field(U.TYPE, Is(typ))] if typ else []
    names = (*names, *(by_type(typ) if by_type else ()))
    return Part("_", JoinObj(norm, Fields(*own, RolesFieldOp(f"{typ}_roles", rop, *names))))


def ASTObjectRight(typ: str, norm: ObjectOp, rop: ArrayOp | None, *names: str) -> ObjectOp:
    return ASTObjectRightCustom(typ, norm, None, rop, *names)


def ObjectRolesCustomOp(var: str, obj: ObjectOp | None, rop: ArrayOp | None, *names: str) -> Op:
    own = Fields(RolesFieldOp(f"{var}_roles", rop, *names))
    return Part(var, JoinObj(obj, own) if obj is not None else own)


def ObjectRolesCustom(var: str, obj: ObjectOp | None, *names: str) -> Op:
    return ObjectRolesCustomOp(var, obj, None, *names)


def ObjectRoles(var: str, *names: str) -> Op:
    return ObjectRolesCustomOp(var, None, None, *names)


def EachObjectRoles(var: str, *names: str) -> Op:
    return Each(f"{var}_arr", ObjectRoles(var, *names))


def EachObjectRolesByType(var: str, types: Mapping[str | None, Sequence[str]], *names: str) -> Op:
    """Roles for every item, and more by its type; the key "" or None is for other types."""
    kind = f"{var}_type"
    cases = {(k or None): Roles(*v) for k, v in types.items()}
    return Each(f"{var}_arr", ObjectRolesCustomOp(var, Obj({U.TYPE: Var(kind)}), LookupArrOpVar(kind, cases) if cases else None, *names))


def OptObjectRoles(var: str, *names: str) -> Op:
    return Opt(f"{var}_set", ObjectRoles(var, *names))


def Operator(var: str, lookup: Mapping[Any, ArrayOp] | None, *names: str) -> ObjectOp:
    """An operator node: token in a variable, roles by the token."""
    names = ("Expression", "Operator", *names)
    rop = AppendRoles(LookupArrOpVar(var, lookup), *names) if lookup is not None else Roles(*names)
    return Fields(Field(U.TYPE, Is(f"{U.NAMESPACE}:Operator")), Field(U.TOKEN, Var(var)), Field(U.ROLE, rop))


@dataclass
class FieldRole:
    """What happens to one field: renamed, skipped, added; nil allowed, or a list; a mapping, an operation, roles."""

    rename: str = ""
    skip: bool = False
    add: bool = False
    opt: bool = False
    arr: bool = False
    sub: Any = None
    op: Any = None
    roles: Sequence[str] = ()

    def validate(self) -> None:
        acts = bool(self.roles) or self.op is not None or self.sub is not None
        if self.arr and self.opt:
            raise ValueError("a field is either a list or optional")
        if (self.arr or self.opt) and not acts:
            raise ValueError("a list or optional field needs roles or an operation")
        if self.skip and (self.opt or self.arr or acts):
            raise ValueError("a skipped field has no operations")
        if self.skip and self.rename and not self.add:
            raise ValueError("a skipped field is renamed only if it is added")

    def sides(self, name: str) -> tuple[tuple[str, Op] | None, tuple[str, Op] | None]:
        self.validate()
        var = f"{name}_var"
        if self.sub is not None:
            left, right = ObjScope(f"{name}_", self.sub).mapping()
            if self.roles:
                left, right = JoinObj(left, Fields(RolesField(var))), JoinObj(right, Fields(RolesField(var, *self.roles)))
            left, right = MapPart(f"{var}m", Rule(left, right)).mapping()
            if self.arr:
                left, right = Each(f"{var}list", left), Each(f"{var}list", right)
            elif self.opt:
                left, right = Opt(f"{var}set", left), Opt(f"{var}set", right)
        elif self.op is not None:
            left = right = op(self.op)
        elif not self.roles:
            left = right = Var(var)
        else:
            make = EachObjectRoles if self.arr else OptObjectRoles if self.opt else ObjectRoles
            left, right = make(var), make(var, *self.roles)
        if self.skip:
            left = AnyVal(None)
        source = (name, left) if self.skip or not self.add else None
        target = (self.rename or name, right) if not self.skip or self.add else None
        return source, target


class FieldRoles:
    """Several fields by name, as a pair of object operations."""

    def __init__(self, fields: Mapping[str, FieldRole]):
        self.fields = fields

    def mapping(self) -> tuple[ObjectOp, ObjectOp]:
        left, right = [], []
        for name, f in sorted(self.fields.items()):
            exists = f"{name}__exists" if f.opt else ""
            for side, own in zip((left, right), f.sides(name), strict=True):
                if own:
                    side.append(Field(own[0], own[1], optional=exists))
        return Fields(*left), Fields(*right)


def ObjRoles(fields: Mapping[str, Sequence[str]]) -> FieldRoles:
    return FieldRoles({k: FieldRole(opt=True, roles=v) for k, v in fields.items()})


def AnnotateTypeCustomMap(typ: str, fields: Any, by_type: Callable[[str], Sequence[str]] | None, rop: ArrayOp | None, *names: str) -> Rule:
    ast, norm = fields.mapping() if fields is not None else (Obj(), Obj())
    return Rule(ASTObjectLeft(typ, ast), ASTObjectRightCustom(typ, norm, by_type, rop, *names))


def AnnotateTypeCustom(typ: str, fields: Any, rop: ArrayOp | None, *names: str) -> Rule:
    return AnnotateTypeCustomMap(typ, fields, None, rop, *names)


def AnnotateType(typ: str, fields: Any = None, *names: str) -> Rule:
    return AnnotateTypeCustomMap(typ, fields, None, None, *names)


def StringToRolesMap(table: Mapping[str, Sequence[str]]) -> dict[str, ArrayOp]:
    return {k: Roles(*v) for k, v in table.items()}


def AnnotateIfNoRoles(typ: str, *names: str) -> Rule:
    return Rule(
        CheckObj(HasFields({U.ROLE: False}), Part("_", Obj({U.TYPE: Is(typ)}))),
        Part("_", Obj({U.TYPE: Is(typ), U.ROLE: Roles(*names)})),
    )


def RolesDedup() -> TransformFunc:
    """Drops repeated roles, keeping the first of each."""

    def f(obj: dict):
        own = obj.get(U.ROLE)
        if not isinstance(own, list):
            return obj, False
        names = U.roles_of(obj)
        once = list(dict.fromkeys(names))
        return (obj, False) if len(once) == len(own) else (obj | {U.ROLE: once}, True)

    return TransformObjFunc(f)


# ---- semantic nodes ------------------------------------------------------


def UASTType(name: str, fields: Any = None) -> ObjectOp:
    """An object of a registered type; fields not given have their zero values."""
    inner = op(fields if fields is not None else {})
    own: dict[str, Any] = {U.TYPE: Is(name)}
    if inner.full and U.TYPES.lookup(name) is not None:
        zero, optional = U.TYPES.zero(name)
        given = set(inner.needs()) - {U.TYPE}
        if unknown := given - set(zero) - set(optional):
            raise RuleError("undefined field", f"{name}.{sorted(unknown)[0]}")
        own |= {k: Is(v) for k, v in zero.items() if k not in given and k != U.TYPE}
    return JoinObj(Obj(own), inner)


def UASTTypePart(var: str, name: str, fields: Any = None) -> ObjectOp:
    U.TYPES.lookup(name)
    return JoinObj(Obj({U.TYPE: Is(name)}), Part(var, op(fields if fields is not None else {})))


_POSITION, _POSITIONS = f"{U.NAMESPACE}:Position", f"{U.NAMESPACE}:Positions"


def SavePosOffset(var: str) -> Op:
    return UASTType(_POSITION, {U.OFFSET: Var(var)})


def SavePosLineCol(line: str, col: str) -> Op:
    return UASTType(_POSITION, {U.LINE: Var(line), U.COL: Var(col)})


def MapSemanticPos(native: str, semantic: str, positions: Mapping[str, str] | None, m: Any) -> Rule:
    """A native type to a registered one; start and end are carried, other named positions go to variables."""
    src, dst = m.mapping()
    both = [Field(k, Var(k), optional=f"{k}_exists") for k in (U.START, U.END)]
    left, right = UASTType(_POSITIONS, Fields(*both)), UASTType(_POSITIONS, Fields(*both))
    if positions:
        left = JoinObj(left, Obj({k: Var(v) for k, v in positions.items()}))
        right = JoinObj(right, Obj({k: Var(v) for k, v in positions.items() if v not in (U.START, U.END)}))
    return Rule(JoinObj(Obj({U.TYPE: Is(native)}), src, Obj({U.POS: left})), UASTType(semantic, JoinObj(dst, Obj({U.POS: right}))))


def MapSemantic(native: str, semantic: str, m: Any) -> Rule:
    return MapSemanticPos(native, semantic, None, m)


class CommentText(Op):
    """A comment's source; its text, prefix, suffix and indent are variables that begin with ``var``."""

    kinds = T.STRING

    def __init__(self, start: str, end: str, var: str, trim: bool = False):
        self.start, self.end, self.trim = start, end, trim
        self.names = {p: f"{var}_{s}" for p, s in (("text", "text"), ("prefix", "pref"), ("suffix", "suff"), ("indent", "tab"))}

    def check(self, st: State, n: Any) -> bool:
        c = X.Comment.split(n, self.start, self.end, self.trim) if isinstance(n, str) else None
        if c is None:
            return False
        st.set_all({v: getattr(c, p) for p, v in self.names.items()})
        return True

    def build(self, st: State, base: Any = None) -> Any:
        return X.Comment(self.start, self.end, **{p: st.get(v) for p, v in self.names.items()}).join()


def CommentTextTrimmed(start: str, end: str, var: str) -> Op:
    return CommentText(start, end, var, trim=True)


def CommentNode(block: bool, var: str, pos: Any = None) -> ObjectOp:
    own = {"Block": Is(block), "Text": Var(f"{var}_text"), "Prefix": Var(f"{var}_pref"), "Suffix": Var(f"{var}_suff"), "Tab": Var(f"{var}_tab")}
    return UASTType(f"{U.NAMESPACE}:Comment", own | ({U.POS: pos} if pos is not None else {}))


class ResponseMetadata:
    """Unwraps a root object with a single field, unless the top level is the root itself."""

    def __init__(self, top_level_is_root: bool = False):
        self.keep = top_level_is_root

    def run(self, root: Any) -> tuple[Any, list[Exception]]:
        single = isinstance(root, dict) and len(root) == 1 and not self.keep
        return (next(iter(root.values())) if single else root), []

    def do(self, root: Any) -> Any:
        return self.run(root)[0]


@dataclass(frozen=True)
class ObjectToNode:
    """Native keys of type and positions to the reserved fields; other fields are kept."""

    type_key: str = ""
    offset_key: str = ""
    end_offset_key: str = ""
    line_key: str = ""
    end_line_key: str = ""
    column_key: str = ""
    end_column_key: str = ""

    def mapping(self) -> tuple[Op, Op]:
        ast, norm, pos = [], {}, []
        if self.type_key:
            ast.append(Field(self.type_key, Var("itype")))
            norm[U.TYPE] = Var("itype")
        for key, name in ((self.offset_key, U.START), (self.end_offset_key, U.END)):
            if key:
                ast.append(Field(key, Var(f"pos_off_{name}")))
                pos.append(Field(name, SavePosOffset(f"pos_off_{name}")))
        for line, col, name in ((self.line_key, self.column_key, U.START), (self.end_line_key, self.end_column_key, U.END)):
            if bool(line) != bool(col):
                raise ValueError("line and column keys are given together or not at all")
            if line:
                exists = f"pos_{name}_exists"
                ast += [Field(line, Var(f"pos_line_{name}"), optional=exists), Field(col, Var(f"pos_col_{name}"), optional=exists)]
                pos.append(Field(name, SavePosLineCol(f"pos_line_{name}", f"pos_col_{name}"), optional=exists))
        if pos:
            norm[U.POS] = UASTType(_POSITIONS, Fields(*pos))
        return MapPart("other", Rule(Fields(*ast), Obj(norm))).mapping()
