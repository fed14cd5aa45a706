"""Positions in source text: byte offsets, lines, columns, characters, UTF-16 units.

Offsets are 0-based bytes, lines and columns 1-based (columns in bytes unless
said otherwise).  Everything is an expression on a ``code`` column, so that a
position needs no join: ``line_starts`` is an array of byte offsets, and a lookup
is a search in it.  The class ``Index`` does the same for one text in Python.
"""

from __future__ import annotations

from bisect import bisect_right
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tree as T
from ..functions import uast as U
from .rewrite import RuleError, TransformObjFunc


class Index:
    """Conversions of positions in one source text."""

    def __init__(self, data: bytes | str):
        self.data = data.encode() if isinstance(data, str) else data
        self.lines = [0]
        for i, b in enumerate(self.data):
            if b == 0x0A:
                self.lines.append(i + 1)

    def _check(self, offset: int) -> None:
        if not 0 <= offset <= len(self.data):
            raise ValueError(f"offset {offset} is out of bounds [0, {len(self.data)}]")

    def line_col(self, offset: int) -> tuple[int, int]:
        """Line and column of a byte; the end of the text counts."""
        self._check(offset)
        line = bisect_right(self.lines, offset)
        return line, offset - self.lines[line - 1] + 1

    def offset(self, line: int, col: int) -> int:
        """Byte offset; a column may stand one past the end of its line, on an empty last line anywhere."""
        if not 1 <= line <= len(self.lines):
            raise ValueError(f"line {line} is out of bounds [1, {len(self.lines)}]")
        start = self.lines[line - 1]
        end = self.lines[line] if line < len(self.lines) else len(self.data)
        last_empty = line == len(self.lines) and start == len(self.data)
        if col < 1 or (col > end - start + 1 and not last_empty):
            raise ValueError(f"column {col} is out of bounds [1, {end - start + 1}]")
        return start + col - 1

    def _from_units(self, n: int, width) -> int:
        at = seen = 0
        for c in self.data.decode("utf-8", "replace"):
            if seen >= n:
                break
            seen += width(c)
            at += len(c.encode())
        if seen != n or n < 0:
            raise ValueError(f"offset {n} is out of bounds")
        return at

    def _to_units(self, offset: int, width) -> int:
        self._check(offset)
        return sum(map(width, self.data[:offset].decode("utf-8", "ignore")))

    def from_rune_offset(self, n: int) -> int:
        return self._from_units(n, lambda c: 1)

    def from_utf16_offset(self, n: int) -> int:
        return self._from_units(n, lambda c: 1 + (ord(c) > 0xFFFF))

    def to_rune_offset(self, offset: int) -> int:
        return self._to_units(offset, lambda c: 1)

    def to_utf16_offset(self, offset: int) -> int:
        return self._to_units(offset, lambda c: 1 + (ord(c) > 0xFFFF))

    def _unit_line_col(self, offset: int, to) -> tuple[int, int]:
        line, _ = self.line_col(offset)
        return line, to(offset) - to(self.lines[line - 1]) + 1

    def to_unicode_line_col(self, offset: int) -> tuple[int, int]:
        return self._unit_line_col(offset, self.to_rune_offset)

    def to_utf16_line_col(self, offset: int) -> tuple[int, int]:
        return self._unit_line_col(offset, self.to_utf16_offset)

    rune_offset, utf16_offset = from_rune_offset, from_utf16_offset


# ---- columns -------------------------------------------------------------


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(sizes: Column, start: Column) -> Column:
    """Sums of what stands before each element, from ``start`` on."""
    sums = F.aggregate(sizes, F.array(start), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    return F.slice(sums, F.lit(1), F.size(sizes))


def line_starts(code: Column) -> Column:
    """Byte offset of the start of every line.

    Appending copies an array, so lines are summed up in about sqrt(n) chunks of
    sqrt(n): n ** 1.5 steps for n lines, within the row.
    """
    sizes = F.transform(F.split(code, "\n", -1), lambda s: F.octet_length(s) + 1)

    def starts(n: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(n))).cast("int")
        count = F.ceil(F.size(n) / width).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(n, c * width + 1, width))
        return _let(chunks, lambda own: _let(_running(F.transform(own, lambda x: F.aggregate(x, F.lit(0), lambda p, q: p + q)), F.lit(0)), lambda first: F.flatten(F.transform(own, lambda x, i: _running(x, F.get(first, i))))))

    return _let(sizes, starts)


def _bytes(code: Column) -> Column:
    """The text with one character per byte."""
    return F.decode(F.encode(code, "UTF-8"), "ISO-8859-1")


def line_col_at(code: Column, offset: Column) -> Column:
    """struct(line, col) of a byte offset straight from the text; null out of bounds."""
    head = F.substring(_bytes(code), F.lit(1), offset.cast("int"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(head, "\n", -1)) + 1
    return F.when((offset >= 0) & (offset <= F.octet_length(code)), F.struct(line.cast("bigint").alias("line"), col.cast("bigint").alias("col")))


def line_col(starts: Column, offset: Column, length: Column) -> Column:
    """struct(line, col) of a byte offset; null out of bounds."""
    line = F.size(F.filter(starts, lambda s: s <= offset))
    col = offset - F.element_at(starts, F.greatest(line, F.lit(1))) + 1
    return F.when((offset >= 0) & (offset <= length), F.struct(line.cast("bigint").alias("line"), col.cast("bigint").alias("col")))


def offset_of(starts: Column, line: Column, col: Column, length: Column) -> Column:
    """Byte offset of a line and column; null out of bounds."""
    n = F.size(starts)
    start = F.try_element_at(starts, line.cast("int"))
    end = F.coalesce(F.try_element_at(starts, (line + 1).cast("int")), length)
    empty = (line == n) & (start == length)
    good = (line >= 1) & (line <= n) & (col >= 1) & ((col <= end - start + 1) | empty)
    return F.when(good, (start + col - 1).cast("bigint"))


def rune_to_byte(code: Column, n: Column) -> Column:
    return F.when((n >= 0) & (n <= F.length(code)), F.octet_length(F.substring(code, F.lit(1), n.cast("int"))).cast("bigint"))


def _head(code: Column, offset: Column) -> Column:
    return F.decode(F.substring(F.encode(code, "UTF-8"), F.lit(1), offset.cast("int")), "UTF-8")


def byte_to_rune(code: Column, offset: Column) -> Column:
    return F.when((offset >= 0) & (offset <= F.octet_length(code)), F.length(_head(code, offset)).cast("bigint"))


def byte_to_utf16(code: Column, offset: Column) -> Column:
    return F.when((offset >= 0) & (offset <= F.octet_length(code)), F.floor(F.octet_length(F.encode(_head(code, offset), "UTF-16BE")) / 2).cast("bigint"))


def _tail(code: Column, offset: Column, width) -> Column:
    """struct(line, col) of a byte offset, columns in ``width`` of what stands before it in its line."""
    head = _head(code, offset)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    col = width(F.substring_index(head, "\n", -1)) + 1
    return F.when((offset >= 0) & (offset <= F.octet_length(code)), F.struct(line.cast("bigint").alias("line"), col.cast("bigint").alias("col")))


def unicode_line_col(code: Column, offset: Column) -> Column:
    """struct(line, col) of a byte offset with columns in characters; null out of bounds."""
    return _tail(code, offset, F.length)


def utf16_line_col(code: Column, offset: Column) -> Column:
    """struct(line, col) of a byte offset with columns in UTF-16 units; null out of bounds."""
    return _tail(code, offset, lambda s: F.octet_length(F.encode(s, "UTF-16BE")) / 2)


def utf16_to_byte(code: Column, n: Column) -> Column:
    """Byte offset of a UTF-16 unit; null out of bounds or inside a pair."""
    units = F.encode(code, "UTF-16BE")
    head = F.decode(F.substring(units, F.lit(1), (n * 2).cast("int")), "UTF-16BE")
    last = F.conv(F.hex(F.substring(units, (n * 2 - 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    whole = (n == 0) | ~last.between(0xD8, 0xDB)
    return F.when((n >= 0) & (n * 2 <= F.octet_length(units)) & whole, F.octet_length(head).cast("bigint"))


def source_slice(code: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets; null unless 0 <= start <= end <= size."""
    good = (start >= 0) & (start <= end) & (end <= F.octet_length(code))
    return F.when(good, F.decode(F.substring(F.encode(code, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8"))


# ---- tables --------------------------------------------------------------


def lines(trees: DataFrame, code: str = "code") -> DataFrame:
    """(doc_id, line, byte_start, text) of all lines."""
    out = trees.select("doc_id", F.col(code).alias("_code"), F.posexplode(F.arrays_zip(line_starts(F.col(code)).alias("byte_start"), F.split(F.col(code), "\n", -1).alias("text"))).alias("_at", "_l"))
    return out.select("doc_id", (F.col("_at") + 1).cast("bigint").alias("line"), F.col("_l.byte_start").cast("bigint").alias("byte_start"), F.col("_l.text").alias("text"))


def locate(offsets: DataFrame, line_table: DataFrame) -> DataFrame:
    """(doc_id, offset, line, col) as an as-of join for when lines are a table: offsets and line
    starts are merged in one sort per document, and the last start before each offset carries over."""
    marks = line_table.select("doc_id", F.col("byte_start").alias("at"), F.lit(0).alias("side"), "line", "byte_start")
    asked = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("byte_start"))
    w = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked).select("doc_id", "at", "side", F.last("line", True).over(w).alias("line"), F.last("byte_start", True).over(w).alias("start"))
    return both.where("side = 1").select("doc_id", F.col("at").alias("offset"), "line", (F.col("at") - F.col("start") + 1).alias("col"))


def complete(nodes: DataFrame, trees: DataFrame, source: str = "offset", code: str = "code") -> DataFrame:
    """Fills missing members of all positions in ``pos``.  ``source`` says what is given:
    offset, linecol, unicode (offsets in characters) or utf16 (offsets in units)."""
    starts = line_starts(F.col(code)) if source == "linecol" else F.lit(None).cast("array<int>")
    own = nodes.join(trees.select("doc_id", F.col(code).alias("_code"), starts.alias("_starts")), "doc_id", "left")
    size = F.octet_length("_code")

    def fill(_, p: Column) -> Column:
        if source == "linecol":
            at = F.coalesce(offset_of(F.col("_starts"), p["line"], p["col"], size), p["offset"])
            return F.struct(at.alias("offset"), p["line"].alias("line"), p["col"].alias("col"))
        at = {"offset": p["offset"], "unicode": rune_to_byte(F.col("_code"), p["offset"]), "utf16": utf16_to_byte(F.col("_code"), p["offset"])}[source]
        lc = line_col_at(F.col("_code"), at)
        return F.struct(at.alias("offset"), F.coalesce(lc["line"], p["line"]).alias("line"), F.coalesce(lc["col"], p["col"]).alias("col"))

    return own.withColumn("pos", F.transform_values("pos", fill)).drop("_code", "_starts")


def token_from_source(nodes: DataFrame, trees: DataFrame, types: list[str] | None = None, code: str = "code") -> DataFrame:
    """Sets the token of objects that have one to the source between start and end."""
    own = nodes.join(trees.select("doc_id", F.col(code).alias("_code")), "doc_id", "left")
    start, end = F.try_element_at("pos", F.lit(U.START))["offset"], F.try_element_at("pos", F.lit(U.END))["offset"]
    hit = F.map_contains_key("attrs", F.lit("token")) & start.isNotNull() & end.isNotNull()
    hit = hit & F.col("type").isin(types) if types else hit
    return own.withColumn("token", F.when(hit, source_slice(F.col("_code"), start, end)).otherwise(F.col("token"))).drop("_code")


def mismatched_tokens(nodes: DataFrame, trees: DataFrame, types: list[str] | None = None, code: str = "code") -> DataFrame:
    """Objects whose token differs from their source: (doc_id, pre, token, source)."""
    own = nodes.join(trees.select("doc_id", F.col(code).alias("_code")), "doc_id", "left")
    start, end = F.try_element_at("pos", F.lit(U.START))["offset"], F.try_element_at("pos", F.lit(U.END))["offset"]
    own = own.where(F.col("token").isNotNull() & start.isNotNull() & end.isNotNull())
    own = own.where(F.col("type").isin(types)) if types else own
    out = own.select("doc_id", "pre", "token", source_slice(F.col("_code"), start, end).alias("source"))
    return out.where(~F.col("token").eqNullSafe(F.col("source")))


# ---- stages on one tree (the interpreter's side) -------------------------


class Positioner:
    """Fills the missing members of all positions of a tree from its source."""

    def __init__(self, source: str):
        if source not in ("offset", "linecol", "unicode", "utf16"):
            raise ValueError(f"unknown source of positions: {source}")
        self.source = source

    def on_code(self, code: str):
        index = Index(code)

        def f(obj: dict) -> tuple[Any, bool]:
            if U.type_of(obj) != f"{U.NAMESPACE}:Position":
                return obj, False
            p = U.TYPES.node_as(obj, f"{U.NAMESPACE}:Position")
            if self.source == "linecol":
                if not U.has_line_col(p):
                    return obj, False
                offset, line, col = index.offset(p[U.LINE], p[U.COL]), p[U.LINE], p[U.COL]
            else:
                if p[U.OFFSET] == 0 and U.has_line_col(p) and not (p[U.LINE], p[U.COL]) == (1, 1):
                    return obj, False
                offset = {"offset": int, "unicode": index.from_rune_offset, "utf16": index.from_utf16_offset}[self.source](p[U.OFFSET])
                line, col = index.line_col(offset)
            return U.position(offset, line, col), True

        return TransformObjFunc(f)


def FromOffset() -> Positioner:
    return Positioner("offset")


def FromLineCol() -> Positioner:
    return Positioner("linecol")


def FromUnicodeOffset() -> Positioner:
    return Positioner("unicode")


def FromUTF16Offset() -> Positioner:
    return Positioner("utf16")


def _slice(code: bytes, obj: dict) -> str | None:
    p = U.positions_of(obj)
    if U.START not in p or U.END not in p:
        return None
    a, b = p[U.START][U.OFFSET], p[U.END][U.OFFSET]
    if not 0 <= a <= b <= len(code):
        raise ValueError(f"position [{a}, {b}) is out of bounds")
    return code[a:b].decode("utf-8", "replace")


class TokenFromSource:
    """Sets a field (the token unless told otherwise) of objects that have it to their source text."""

    def __init__(self, key: str = U.TOKEN, types: tuple[str, ...] = ()):
        self.key, self.types = key, types

    def on_code(self, code: str):
        data = code.encode()

        def f(obj: dict) -> tuple[Any, bool]:
            if self.key not in obj or (self.types and U.type_of(obj) not in self.types):
                return obj, False
            text = _slice(data, obj)
            return (obj, False) if text is None or text == obj[self.key] else (obj | {self.key: text}, True)

        return TransformObjFunc(f)


class VerifyToken:
    """Fails on the first object whose field differs from its source text."""

    def __init__(self, key: str = U.TOKEN, types: tuple[str, ...] = ()):
        self.key, self.types = key, types

    def verify(self, code: str, root: Any) -> None:
        data = code.encode()
        for n in T.iterate(root, T.PRE):
            if isinstance(n, dict) and isinstance(n.get(self.key), str) and (not self.types or U.type_of(n) in self.types):
                text = _slice(data, n)
                if text is not None and text != n[self.key]:
                    raise RuleError("unexpected value", f"{n[self.key]!r} instead of {text!r}")
