"""A readable YAML form of trees, and YAML documents as trees."""

from __future__ import annotations

from typing import Any

from ..functions import text as X
from ..functions import tree as T
from ..functions import uast as U

# Words that plain YAML reads as something else than text.
GUARDED = ("null", "~", "true", "yes", "y", "on", "false", "no", "n", "off", "<<")
_TAB = "   "


def style(s: str) -> str:
    """plain, single or double quotes, whichever reads best."""
    if any(not c.isprintable() for c in s):
        return "double"
    if not all(c.isalpha() for c in s) or s.lower() in GUARDED:
        return "single"
    return "plain"


def _string(s: str, field: bool) -> str:
    kind = "double" if field else style(s)
    return X.quote(s) if kind == "double" else "'" + s.replace("'", "''") + "'" if kind == "single" else s


def _scalar(n: Any, field: bool) -> str:
    return "~" if n is None else _string(n, field) if isinstance(n, str) else T.to_string(n)


def _first_keys(obj: dict, force_roles: bool) -> list[tuple[str, Any]]:
    """The reserved fields that come first, in order: token, roles (sorted), positions."""
    out: list[tuple[str, Any]] = []
    if U.TOKEN in obj and not isinstance(obj[U.TOKEN], (dict, list)) and obj[U.TOKEN] is not None:
        out.append((U.TOKEN, obj[U.TOKEN]))
    if (force_roles or obj.get(U.ROLE) is not None) and (roles := U.roles_of(obj)):
        out.append((U.ROLE, sorted(roles)))
    typ = U.type_of(obj)
    if typ == f"{U.NAMESPACE}:Position":
        out += [(k, obj[k]) for k in (U.OFFSET, U.LINE, U.COL) if T.kind_of(obj.get(k)) & (T.INT | T.UINT)]
    else:
        names = (U.START, U.END) if typ == f"{U.NAMESPACE}:Positions" else (U.POS,)
        out += [(k, obj[k]) for k in names if isinstance(obj.get(k), dict)]
    return out


def encode(n: Any, force_roles: bool = True) -> str:
    """Text of a tree.  ``force_roles`` also writes the role of objects that have none."""

    def write(n: Any, indent: str, field: bool) -> str:
        inner = indent + _TAB
        if isinstance(n, dict):
            if not n:
                return "{}"
            head, first = "{", _first_keys(n, force_roles)
            if isinstance(n.get(U.TYPE), str):
                head += f" {_string(U.TYPE, False)}: {X.quote(n[U.TYPE])},"
            done = {k for k, _ in first} | ({U.TYPE} if isinstance(n.get(U.TYPE), str) else set())
            rest = [(k, n[k]) for k in sorted(n) if k not in done]
            return head + "".join(f"\n{inner}{_string(k, False)}: {write(v, inner, k != U.ROLE)}," for k, v in first + rest) + f"\n{indent}}}"
        if isinstance(n, list):
            if all(v is not None and not isinstance(v, (dict, list)) for v in n):
                return "[" + ", ".join(_scalar(v, False) for v in n) + "]"
            return f"[\n{indent}" + "".join(f"{_TAB}{write(v, inner, False)},\n{indent}" for v in n) + "]"
        return _scalar(n, field)

    return write(n, "", False)


def decode(text: str) -> Any:
    """A tree from YAML; keys must be strings."""
    import yaml

    def check(v: Any) -> Any:
        if isinstance(v, dict):
            if bad := [k for k in v if not isinstance(k, str)]:
                raise ValueError(f"keys must be strings: {bad[0]!r}")
            return {k: check(x) for k, x in v.items()}
        return [check(x) for x in v] if isinstance(v, list) else v

    return T.to_node(check(yaml.safe_load(text)))
