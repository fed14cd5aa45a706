"""Outcomes of parse calls across a process boundary: errors to status records and back."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

# Status codes of the calls.
OK, INVALID_ARGUMENT, NOT_FOUND, FAILED_PRECONDITION, INTERNAL, UNKNOWN = "OK", "InvalidArgument", "NotFound", "FailedPrecondition", "Internal", "Unknown"
MESSAGE_LIMIT_MB = 100


class ParseError(Exception):
    """What a call can fail with."""

    code = UNKNOWN
    reason = ""


class SyntaxErrors(ParseError):
    """The text has errors; a partial tree may be there."""

    code, reason = OK, "syntax"


class DriverFailure(ParseError):
    code, reason = INTERNAL, "driver"


class TransformFailure(ParseError):
    code, reason = FAILED_PRECONDITION, "transform"


class BadMode(ParseError):
    code, reason = INVALID_ARGUMENT, "mode"


class BadEncoding(ParseError):
    code, reason = INVALID_ARGUMENT, "encoding"


class MissingDriver(ParseError):
    """No parser for the language."""

    code, reason = INVALID_ARGUMENT, "language driver"


class LanguageNotDetected(ParseError):
    code, reason = NOT_FOUND, "language"


_BY_REASON = {c.reason: c for c in (SyntaxErrors, DriverFailure, TransformFailure, BadMode, BadEncoding, MissingDriver, LanguageNotDetected)}
_BY_CODE = {INTERNAL: DriverFailure, FAILED_PRECONDITION: TransformFailure, NOT_FOUND: LanguageNotDetected}


@dataclass
class Status:
    """The record that travels: a code, a reason that says more, a tree, and messages."""

    code: str = OK
    reason: str = ""
    ast: Any = None
    errors: list[str] = field(default_factory=list)


def to_status(ast: Any, error: Exception | None = None) -> Status:
    """Syntax errors travel as success with a list of errors; other failures leave the tree behind."""
    if error is None:
        return Status(ast=ast)
    lines = [str(x) for x in getattr(error, "errors", [error])]
    if isinstance(error, SyntaxErrors):
        return Status(OK, error.reason, ast, lines)
    return Status(error.code, error.reason, None, lines) if isinstance(error, ParseError) else Status(UNKNOWN, "", None, lines)


def from_status(s: Status) -> tuple[Any, ParseError | None]:
    """(tree, error); a stated reason wins over the code."""
    if s.code == OK and not s.errors:
        return s.ast, None
    kind = _BY_REASON.get(s.reason) or (SyntaxErrors if s.code == OK else _BY_CODE.get(s.code, ParseError))
    return (s.ast if kind is SyntaxErrors else None), kind("\n".join(s.errors))


def is_missing_driver(error: Exception | None) -> bool:
    return isinstance(error, MissingDriver)


def message_limit(megabytes: int = MESSAGE_LIMIT_MB) -> int:
    """Bytes a message may have; under 2 GB."""
    if not 0 < megabytes < 2048:
        raise ValueError("the limit must be above 0 and below 2048 MB")
    return megabytes << 20
