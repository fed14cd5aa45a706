"""Text functions: quoting, comment markers, comment layout."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIMPLE = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
_ESCAPE = re.compile(r"\\(?:([abfnrtv\\'\"])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3})|(.?))", re.S)


def unquote(s: str) -> str:
    """The value of a quoted literal ("...", '.' or `...`); ValueError if it isn't one."""
    if len(s) < 2 or s[0] != s[-1] or s[0] not in "\"'`":
        raise ValueError(f"invalid syntax: {s}")
    quote, body = s[0], s[1:-1]
    if quote == "`":
        if "`" in body:
            raise ValueError(f"invalid syntax: {s}")
        return body.replace("\r", "")
    if "\n" in body or re.search(rf"(?<!\\)(?:\\\\)*{quote}", body):
        raise ValueError(f"invalid syntax: {s}")
    raw = bytearray()
    at = 0
    for m in _ESCAPE.finditer(body):
        raw += body[at : m.start()].encode()
        simple, two, four, eight, octal, bad = m.groups()
        if bad is not None or (simple and simple in "'\"" and simple != quote):
            raise ValueError(f"invalid escape: {m[0]}")
        if simple:
            raw += _SIMPLE[simple].encode()
        elif two or octal:
            b = int(two, 16) if two else int(octal, 8)
            if b > 255:
                raise ValueError(f"invalid escape: {m[0]}")
            raw.append(b)
        else:
            code = int(four or eight, 16)
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise ValueError(f"invalid escape: {m[0]}")
            raw += chr(code).encode()
        at = m.end()
    raw += body[at:].encode()
    out = raw.decode("utf-8", "replace")
    if quote == "'" and len(out) != 1:
        raise ValueError(f"invalid syntax: {s}")
    return out


def quote(s: str) -> str:
    """A double-quoted literal with control characters escaped."""
    back = {v: "\\" + k for k, v in _SIMPLE.items() if k != "'"}
    out = []
    for c in s:
        if c in back:
            out.append(back[c])
        elif c.isprintable():
            out.append(c)
        elif ord(c) < 0x80:
            out.append(f"\\x{ord(c):02x}")
        else:
            out.append(f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}")
    return '"' + "".join(out) + '"'


def uncomment_c(s: str) -> str:
    return s[2:] if s.startswith("//") else s[2:-2] if s.startswith("/*") else s


def comment_c(s: str) -> str:
    """A block comment if the text has a line break, else a line comment."""
    return f"/*{s}*/" if "\n" in s else f"//{s}"


def uncomment(s: str, start: str, end: str) -> str:
    return s.removeprefix(start).removesuffix(end)


def uncomment_c_col(c: Column) -> Column:
    return F.when(c.startswith("//"), F.substring(c, 3, 1 << 30)).when(c.startswith("/*"), F.substring(c, F.lit(3), F.greatest(F.length(c) - 4, F.lit(0)))).otherwise(c)


def uncomment_col(c: Column, start: str, end: str) -> Column:
    c = F.when(c.startswith(start), F.substring(c, len(start) + 1, 1 << 30)).otherwise(c)
    return F.when(c.endswith(end), F.substring(c, F.lit(1), F.length(c) - len(end))).otherwise(c)


@dataclass(frozen=True)
class Comment:
    """A comment taken apart; ``join`` puts it together again."""

    start: str
    end: str
    text: str = ""
    prefix: str = ""
    suffix: str = ""
    indent: str = ""

    @classmethod
    def split(cls, source: str, start: str, end: str, trim: bool = False) -> Comment | None:
        """None if the markers don't enclose the source.

        Prefix and suffix are runs of white space or marker characters; the indent
        is what such runs at the beginnings of all lines but the first share.
        """
        if trim:
            source = source.lstrip()
        if not source.startswith(start) or not source.endswith(end):
            return None
        body = source.removeprefix(start).removesuffix(end)
        marks = set(start) | set(end)

        def blank(c: str) -> bool:
            return c.isspace() or c in marks

        def run(s: str) -> str:
            return s[: next((i for i, c in enumerate(s) if not blank(c)), len(s))]

        prefix = run(body)
        body = body[len(prefix) :]
        suffix = run(body[::-1])[::-1]
        body = body[: len(body) - len(suffix)]
        first, *rest = body.split("\n")
        indent = os.path.commonprefix([run(line) for line in rest]) if rest else ""
        text = "\n".join([first, *(line[len(indent) :] for line in rest)])
        return cls(start, end, text, prefix, suffix, indent)

    def join(self) -> str:
        text = self.text.replace("\n", "\n" + self.indent)
        return self.start + self.prefix + text + self.suffix + self.end


def _class(start: str, end: str) -> str:
    return "[\\s" + "".join(re.escape(c) for c in sorted(set(start) | set(end))) + "]"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def comment_columns(c: Column, start: str, end: str) -> dict[str, Column]:
    """The parts of a comment as columns (null where the markers don't enclose it)."""
    blank = _class(start, end)
    lead, trail = f"(?U)^({blank}*)", f"(?U)({blank}*)$"
    inside = c.startswith(start) & c.endswith(end) & (F.length(c) >= len(start) + len(end))
    body = F.when(inside, F.substring(c, F.lit(len(start) + 1), F.length(c) - len(start) - len(end)))

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        ends = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
        return F.substring(a, F.lit(1), F.array_max(ends))

    def indented(lines: Column) -> Column:
        leads = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: F.regexp_extract(s, lead, 1))
        return _let(leads, lambda own: F.when(F.size(own) > 0, F.aggregate(F.slice(own, 2, F.size(own)), F.element_at(own, 1), shared)).otherwise(F.lit("")))

    def texts(lines: Column, indent: Column) -> Column:
        return F.array_join(F.transform(lines, lambda s, i: F.when(i == 0, s).otherwise(F.substring(s, F.length(indent) + 1, F.length(s)))), "\n")

    def parts(lines: Column, prefix: Column, suffix: Column) -> Column:
        return _let(indented(lines), lambda indent: F.struct(texts(lines, indent).alias("text"), prefix.alias("prefix"), suffix.alias("suffix"), indent.alias("indent")))

    def without_prefix(body: Column, prefix: Column) -> Column:
        rest = F.substring(body, F.length(prefix) + 1, F.length(body))
        return _let(F.struct(rest.alias("rest"), F.regexp_extract(rest, trail, 1).alias("suffix")), lambda r: _let(F.split(F.substring(r["rest"], F.lit(1), F.length(r["rest"]) - F.length(r["suffix"])), "\n"), lambda lines: parts(lines, prefix, r["suffix"])))

    found = _let(F.struct(body.alias("body"), F.regexp_extract(body, lead, 1).alias("prefix")), lambda b: without_prefix(b["body"], b["prefix"]))
    return {k: F.when(inside, found[k]) for k in ("text", "prefix", "suffix", "indent")}
