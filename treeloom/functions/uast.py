"""Typed nodes: reserved fields, registered types, positions, tokens, roles, imports."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from . import roles as R
from . import tree as T

# Reserved fields of objects, the namespace, and the fields of positions.
TYPE, TOKEN, ROLE, POS = "@type", "@token", "@role", "@pos"
NAMESPACE = "uast"
START, END = "start", "end"
OFFSET, LINE, COL = "offset", "line", "col"

#: kinds of declared fields -> value of an unset field
_ZERO = {"string": "", "bool": False, "uint": T.Uint(0), "any": None, "object": None, "list": None}


@dataclass(frozen=True)
class FieldType:
    kind: str  # string, bool, uint, any, object, list
    optional: bool = False  # left out while it has its zero value
    content: bool = False  # holds the node's text


@dataclass
class Registry:
    """Types by name ``namespace:Name``; None stands for a type of free-form fields."""

    types: dict[str, dict[str, FieldType] | None] = field(default_factory=dict)

    def register(self, namespace: str, types: dict[str, dict[str, FieldType] | None]) -> None:
        if any(t.startswith(f"{namespace}:") for t in self.types):
            raise ValueError(f"namespace {namespace} is registered")
        self.types.update({f"{namespace}:{k}": v for k, v in types.items()})

    def lookup(self, name: str) -> dict[str, FieldType] | None:
        if name not in self.types:
            raise KeyError(f"type {name} is not registered")
        return self.types[name]

    def zero(self, name: str) -> tuple[dict, dict]:
        """(object with default fields, optional fields and their defaults)."""
        fields = self.lookup(name) or {}
        required = {TYPE: name} | {k: _ZERO[f.kind] for k, f in fields.items() if not f.optional}
        return required, {k: _ZERO[f.kind] for k, f in fields.items() if f.optional}

    def to_node(self, name: str, values: dict) -> dict:
        """A typed object; unknown fields are refused, optional zero values left out."""
        fields = self.lookup(name)
        if fields is None:
            return {TYPE: name} | {k: T.to_node(v) for k, v in values.items()}
        if unknown := set(values) - set(fields):
            raise KeyError(f"undefined field {name}.{sorted(unknown)[0]}")
        out, optional = self.zero(name)
        for k, v in values.items():
            v = T.to_node(v)
            if fields[k].kind == "uint" and v is not None:
                v = T.Uint(v)
            if k in optional and (v is None or T.equal(v, optional[k]) or v in ([], {})):
                continue
            out[k] = v
        return out

    def node_as(self, node: Any, name: str) -> dict:
        """Field values of a typed object: unknown fields are ignored, missing ones get defaults."""
        if not isinstance(node, dict):
            raise TypeError(f"expected an object for {name}")
        if node.get(TYPE) not in (None, name):
            raise TypeError(f"expected type {name}, got {node.get(TYPE)}")
        fields = self.lookup(name)
        if fields is None:
            return {k: v for k, v in node.items() if k != TYPE}
        wanted = {"string": T.STRING | T.NIL, "bool": T.BOOL | T.NIL, "uint": T.UINT | T.INT | T.NIL, "any": T.ANY, "object": T.OBJECT | T.NIL, "list": T.ARRAY | T.NIL}
        out = {}
        for k, f in fields.items():
            v = node.get(k, _ZERO[f.kind])
            if not T.kind_of(v) & wanted[f.kind]:
                raise TypeError(f"field {name}.{k}: unexpected {T.kind_name(T.kind_of(v))}")
            out[k] = _ZERO[f.kind] if v is None else v
        return out


_pos = {POS: FieldType("object", optional=True)}
_any, _list, _obj, _str, _bool = (FieldType(k) for k in ("any", "list", "object", "string", "bool"))
_import = _pos | {"Path": _any, "All": _bool, "Names": _list, "Target": _obj}
#: The registered types and their fields.
TYPES = Registry()
TYPES.register(
    NAMESPACE,
    {
        "Position": {OFFSET: FieldType("uint"), LINE: FieldType("uint"), COL: FieldType("uint")},
        "Positions": None,
        "GenNode": dict(_pos),
        "Identifier": _pos | {"Name": FieldType("string", content=True)},
        "String": _pos | {"Value": FieldType("string", content=True), "Format": _str},
        "Bool": _pos | {"Value": FieldType("bool", content=True)},
        "QualifiedIdentifier": _pos | {"Names": _list},
        "Comment": _pos | {"Text": FieldType("string", content=True), "Prefix": _str, "Suffix": _str, "Tab": _str, "Block": _bool},
        "Group": _pos | {"Nodes": _list},
        "FunctionGroup": _pos | {"Nodes": _list},
        "Block": _pos | {"Statements": _list},
        "Alias": _pos | {"Name": _obj, "Node": _any},
        "Import": dict(_import),
        "RuntimeImport": dict(_import),
        "RuntimeReImport": dict(_import),
        "InlineImport": dict(_import),
        "Argument": _pos | {"Name": _obj, "Type": _any, "Init": _any, "Variadic": _bool, "MapVariadic": _bool, "Receiver": _bool},
        "FunctionType": _pos | {"Arguments": _list, "Returns": _list},
        "Function": _pos | {"Type": _obj, "Body": _obj},
        "Operator": None,
    },
)
CONTENT = {name: next(k for k, f in fields.items() if f.content) for name, fields in TYPES.types.items() if fields and any(f.content for f in fields.values())}
IMPORTS = tuple(f"{NAMESPACE}:{t}" for t in ("Import", "RuntimeImport", "RuntimeReImport", "InlineImport"))


def split_type(name: str) -> tuple[str, str]:
    """(namespace, local name), cut at the first colon."""
    ns, colon, local = name.partition(":")
    return (ns, local) if colon else ("", name)


def type_of(n: Any) -> str:
    t = n.get(TYPE) if isinstance(n, dict) else None
    return t if isinstance(t, str) else ""


def token_of(n: Any) -> str:
    """The scalar itself, or the token of an object."""
    while isinstance(n, dict):
        n = n.get(TOKEN)
    return "" if isinstance(n, list) else T.to_string(n)


def tokens(root: Any) -> list[str]:
    """Non-empty tokens of objects, in pre-order."""
    return [t for n in T.iterate(root, T.PRE) if isinstance(n, dict) and (t := token_of(n))]


def content_of(n: Any) -> str:
    """The text that a node stands for: its content field, however deep - empty if that is
    absent - and of types without one the token."""
    while isinstance(n, dict) and (key := CONTENT.get(type_of(n))):
        n = n.get(key)
    return token_of(n)


def roles_of(n: Any) -> list[str]:
    if not isinstance(n, dict):
        return []
    own = n.get(ROLE)
    if not isinstance(own, list) or not own:
        t = type_of(n)
        return [R.UNANNOTATED] if t and split_type(t)[0] != NAMESPACE else []
    return [R.from_string(r) if isinstance(r, str) else R.from_number(int(r)) for r in own]


def role_list(*names: str) -> list[str]:
    return list(names)


def position(offset: int = 0, line: int = 0, col: int = 0) -> dict:
    return {TYPE: f"{NAMESPACE}:Position", OFFSET: T.Uint(offset), LINE: T.Uint(line), COL: T.Uint(col)}


def positions_of(n: Any) -> dict[str, dict]:
    """Named positions of an object: name -> {offset, line, col}."""
    own = n.get(POS) if isinstance(n, dict) else None
    if not isinstance(own, dict):
        return {}
    return {k: TYPES.node_as(v, f"{NAMESPACE}:Position") for k, v in sorted(own.items()) if isinstance(v, dict)}


def has_offset(p: dict) -> bool:
    """Offset 0 counts only at line 1, column 1."""
    return p[OFFSET] != 0 or (p[LINE] == 1 and p[COL] == 1)


def has_line_col(p: dict) -> bool:
    return p[LINE] != 0 and p[COL] != 0


def valid(p: dict) -> bool:
    """Anything but all zero."""
    return bool(p[OFFSET] or p[LINE] or p[COL])


def position_key(p: dict | None) -> tuple:
    """Sort key: valid positions first, by offset where there is one, else by line and column (0: last)."""
    if p is None or not valid(p):
        return (1, 0, 0, 0)
    if has_offset(p):
        return (0, int(p[OFFSET]), 0, 0)
    return (0, 0, int(p[LINE]) or 1 << 32, int(p[COL]) or 1 << 32)


def less(a: dict, b: dict) -> bool:
    """Whether ``a`` comes before ``b``; all-zero positions come last."""
    if not valid(a) or not valid(b):
        return valid(a) and not valid(b)
    if has_offset(a) and has_offset(b):
        return a[OFFSET] < b[OFFSET]
    late = 1 << 32
    return (int(a[LINE]) or late, int(a[COL]) or late) < (int(b[LINE]) or late, int(b[COL]) or late)


def positional(root: Any) -> list[dict]:
    """All objects but positions, by start position; unpositioned ones last; ties in pre-order."""
    own = []

    def visit(n):
        if isinstance(n, dict):
            if type_of(n) in (f"{NAMESPACE}:Position", f"{NAMESPACE}:Positions"):
                return False
            own.append(n)
        return True

    T.walk(root, visit)
    return sorted(own, key=lambda n: position_key(positions_of(n).get(START)))


def hash_no_pos(n: Any) -> bytes:
    return T.hash_of(n, lambda k: k != POS)


def _import_path(n: Any) -> str:
    """Aliases lead to what they stand for; of qualified identifiers the names are joined."""
    names: list[str] = []
    todo = [n]
    while todo:
        x = todo.pop()
        t = type_of(x)
        if t == f"{NAMESPACE}:Alias":
            todo.append(x.get("Node"))
        elif t == f"{NAMESPACE}:QualifiedIdentifier":
            todo += reversed(x.get("Names") or [])
        else:
            names.append(content_of(x))
    return "/".join(names)


def import_paths(root: Any) -> list[str]:
    """Distinct paths of all import nodes, sorted."""
    found = {_import_path(n.get("Path")) for n in T.iterate(root, T.PRE) if type_of(n) in IMPORTS}
    return sorted(found - {""})
