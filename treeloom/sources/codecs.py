"""Text forms of trees as DataFrame sources and sinks."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import roles as R
from ..functions import tree as T
from ..functions import uast as U
from ..operators.nodes import node_rows, parse_json, pruned, scalar_text, shred
from . import yaml_text


def dump_json(n: Any) -> str:
    """JSON text of a tree of any depth, with sorted keys."""
    try:
        return json.dumps(T.native(n), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        return _dump_deep(n)


def _dump_deep(n: Any) -> str:
    out: list[str] = []
    todo: list = [n]  # nodes, and texts to write as they are, in tuples
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            out.append(x[0])
        elif isinstance(x, (dict, list)):
            parts: list = [("{" if isinstance(x, dict) else "[",)]
            for k, c in T.children(x):
                parts += [(("," if len(parts) > 1 else "") + (json.dumps(k, ensure_ascii=False) + ":" if isinstance(k, str) else ""),), c]
            todo += reversed([*parts, ("}" if isinstance(x, dict) else "]",)])
        else:
            out.append(json.dumps(T.native(x), ensure_ascii=False))
    return "".join(out)


def _made(f: Callable[[], Any]) -> tuple[Any, str | None]:
    """(result, error): whatever goes wrong with one document is its own error."""
    try:
        return f(), None
    except Exception as e:  # noqa: BLE001 - no document may end the job of all others
        return None, f"{type(e).__name__}: {e}"


def per_document(trees: DataFrame, f: Callable[[Any], str], out: str, doc: str = "doc", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra..., out, error): a text made of every document in Arrow batches; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None) if t is None else _made(lambda t=t: f(parse_json(t))) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([m[i] for m in made], pa.string()) for i in (0, 1))], [*b.schema.names[:-1], out, "error"])

    own = trees.select("doc_id", *extra, F.col(doc))
    ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{ddl}, `{out}` string, error string")


def to_yaml(trees: DataFrame, doc: str = "doc", force_roles: bool = True) -> DataFrame:
    return per_document(trees, lambda n: yaml_text.encode(n, force_roles), "yaml", doc)


def from_yaml(texts: DataFrame, column: str = "yaml") -> DataFrame:
    """(doc_id, doc, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None) if t is None else _made(lambda t=t: dump_json(yaml_text.decode(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in made], pa.string()) for i in (0, 1))], ["doc_id", "doc", "error"])

    return texts.select("doc_id", column).mapInArrow(run, "doc_id bigint, doc string, error string")


# ---- JSON lines ----------------------------------------------------------


_SCALAR = r"^\s*(true|false|null|-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?)\s*$"


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    As the first of two items of an array the value must be followed by the other one; after a
    value of its own the engine's parsers accept anything.
    """
    items = F.from_json(F.concat(F.lit("["), text, F.lit(",0]")), "array<string>", {"allowSingleQuotes": "false"})
    first = F.substring(F.ltrim(text), 1, 1)
    return F.coalesce(F.when(first.isin("{", "[", '"'), F.size(items) == 2).otherwise(text.rlike(_SCALAR)), F.lit(False))


def read_json_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(doc, error): one JSON value a line; bad lines carry an error instead of a document.

    Lines may have any length that a row can have; only a single string of over 128 MiB
    inside one is more than the engine's parser takes.
    """
    return decode_lines((spark.readStream if stream else spark.read).text(path))


def decode_lines(lines: DataFrame) -> DataFrame:
    """The same for a column ``value`` of lines."""
    good = is_json(F.col("value"))
    why = F.when(~good, "invalid JSON")
    return lines.where(F.trim("value") != "").select(F.when(good, F.col("value")).alias("doc"), why.alias("error"))


def write_json_lines(trees: DataFrame, path: str, doc: str = "doc") -> None:
    trees.select(F.col(doc).alias("value")).where("value is not null").write.text(path)


def response(column: Column) -> Column:
    """struct(status, errors, ast) of a parser's answer; the status in lower case, the tree as JSON text."""
    raw = F.from_json(column, "status string, errors array<string>, ast string")
    return F.when(raw.isNotNull(), F.struct(F.lower(raw["status"]).alias("status"), raw["errors"].alias("errors"), raw["ast"].alias("ast")))


def outcome(r: Column) -> Column:
    """struct(ast, status, error) of an answer: ok keeps the tree; error keeps a tree and
    reports a syntax error; fatal is a driver failure without a tree; any other status is an error."""
    errors = r["errors"]  # one as it is, of several each with its line end
    text = F.when(F.size(errors) == 1, F.get(errors, F.lit(0))).otherwise(F.array_join(F.transform(errors, lambda e: F.concat(e, F.lit("\n"))), ""))
    none = F.lit(None).cast("string")
    make = lambda ast, status, error: F.struct(ast.alias("ast"), F.lit(status).alias("status"), error.alias("error"))
    return (
        F.when(r.isNull(), make(none, "fatal", F.lit("malformed answer")))
        .when(r["status"] == "ok", make(r["ast"], "ok", none))
        .when(r["status"] == "error", make(r["ast"], "syntax", text))
        .when(r["status"] == "fatal", make(none, "fatal", text))
        .otherwise(make(none, "unknown", F.concat(F.lit("unexpected status "), r["status"])))
    )


def encode_content(c: Column, encoding: str) -> Column:
    name = encoding.lower().replace("-", "")
    if name == "utf8":
        return c
    if name == "base64":
        return F.base64(F.encode(c, "UTF-8"))
    raise ValueError(f"unknown encoding: {encoding}")


def decode_content(c: Column, encoding: str) -> Column:
    name = encoding.lower().replace("-", "")
    if name == "utf8":
        return c
    if name == "base64":
        return F.decode(F.try_to_binary(c, F.lit("base64")), "UTF-8")
    raise ValueError(f"unknown encoding: {encoding}")


def decode_bytes(s: str, encoding: str) -> bytes:
    return base64.b64decode(s, validate=True) if encoding.lower() == "base64" else s.encode()


# ---- the flat node shape of the first protocol version -------------------

FIELD = "internalRole"  # fixed value: the property that names the field


# The keys of such a node.
_LEGACY = ("InternalType", "Token", "Roles", "StartPosition", "EndPosition", "Properties", "Children")
_RESERVED = (U.TYPE, U.TOKEN, U.ROLE, U.POS)


def _flat(field: str, *, typ: str = "", token: str = "", roles: list | None = None, start: dict | None = None, end: dict | None = None) -> dict:
    return dict(zip(_LEGACY, (typ, token, roles or [], start, end, {FIELD: field} if field else {}, []), strict=True))


def legacy(root: Any) -> dict | None:
    """One node {InternalType, Token, Roles, StartPosition, EndPosition, Properties, Children}.

    Scalar fields become text properties, composite ones children; other named
    positions become children one byte wide; children are ordered by the offset
    where they or their first descendant start, then by field.  Several roots get
    a parent.

    Made from the rows of the tree's node table: owners and fields are handed down in
    pre-order, children and first offsets up in the opposite one.
    """
    made: dict[int, dict] = {}
    owner: dict[int, int | None] = {}  # the nearest object above a row
    label: dict[int, str] = {}  # the field a row belongs to, through arrays
    hidden: set[int] = set()
    children: dict[int | None, list[tuple[int, dict]]] = {None: []}
    for row in node_rows(0, root):
        at, above, field, kind = row["pre"], row["parent"], row["field"], row["kind"]
        owner[at] = None if above is None else above if above in made else owner[above]
        label[at] = field if field is not None else "" if above is None else label[above]
        if above in hidden or field in _RESERVED:
            hidden.add(at)
            continue
        if kind == T.OBJECT:
            points = dict(row["pos"])
            made[at] = _flat(label[at], typ=row["local"], token=row["token"] or "", roles=[R.number(r) for r in row["roles"] or _default_roles(row)], start=points.get(U.START), end=points.get(U.END))
            children[at] = [(at, _point(name, p)) for name, p in points.items() if name not in (U.START, U.END)]
        elif kind in (T.NIL, T.ARRAY):
            continue
        else:
            text = T.to_string(_value(row))
            if field is not None:
                made[above]["Properties"][field] = text
                continue
            made[at] = _flat(label[at], token=text)
            children[at] = []
        children[owner[at]].append((at, made[at]))
    first: dict[int, int | None] = {}
    for at in sorted(made, reverse=True):
        own = made[at]
        starts = {k: c["StartPosition"]["offset"] if c["StartPosition"] else first.get(i) if i != at else None for k, (i, c) in enumerate(children[at])}
        placed = sorted(range(len(starts)), key=lambda k: (starts[k] is None, starts[k] or 0, children[at][k][1]["Properties"].get(FIELD, "")))  # noqa: B023
        own["Children"] = [children[at][k][1] for k in placed]
        known = [s for s in starts.values() if s is not None]
        first[at] = own["StartPosition"]["offset"] if own["StartPosition"] else min(known, default=None)
    tops = [n for _, n in children[None]]
    return None if not tops else tops[0] if len(tops) == 1 else _flat("") | {"Children": tops}


def _default_roles(row: dict) -> list[str]:
    return [R.UNANNOTATED] if row["type"] and row["ns"] != U.NAMESPACE else []


def _value(row: dict) -> Any:
    kind = row["kind"]
    return T.Uint(row["u"]) if kind == T.UINT else row[{T.STRING: "s", T.INT: "i", T.FLOAT: "f", T.BOOL: "b"}[kind]]


def _point(name: str, p: dict) -> dict:
    """A position that is neither start nor end, as a node one byte wide."""
    after = p | {U.OFFSET: p[U.OFFSET] + 1, U.COL: p[U.COL] + 1}
    out = _flat(name, typ="Position", start=dict(p), end=after)
    out["Properties"] |= {k: str(v) for k, v in p.items()}
    return out


def viewer(lang: str, code: str, n: Any) -> str:
    """JSON for a viewer: code, language, and the flat tree with role names and capitalised position keys."""

    def shown(x: dict) -> dict:
        at = {k: None if x[k] is None else {p.capitalize(): v for p, v in x[k].items()} for k in ("StartPosition", "EndPosition")}
        return x | at | {"Roles": [R.from_number(r) for r in x["Roles"]], "Children": [shown(c) for c in x["Children"]]}

    flat = legacy(n)
    return json.dumps({"code": code, "lang": lang, "uast": shown(flat) if flat else None}, ensure_ascii=False, sort_keys=True)


def to_legacy(trees: DataFrame, doc: str = "doc") -> DataFrame:
    return per_document(trees, lambda n: json.dumps(legacy(n), ensure_ascii=False, sort_keys=True), "legacy", doc)


def to_viewer(trees: DataFrame, doc: str = "doc", code: str = "code", lang: str = "lang") -> DataFrame:
    """(doc_id, json, error) for (doc_id, lang, code, doc)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, langs, codes, docs = (c.to_pylist() for c in b.columns)
            made = [_made(lambda x=x, y=y, d=d: viewer(x or "", y or "", parse_json(d) if d else None)) for x, y, d in zip(langs, codes, docs, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([m[i] for m in made], pa.string()) for i in (0, 1))], ["doc_id", "json", "error"])

    return trees.select(F.col("doc_id").cast("bigint"), lang, code, doc).mapInArrow(run, "doc_id bigint, json string, error string")


# ---- dot -----------------------------------------------------------------


def dot_lines(nodes: DataFrame, positions: bool = True, nils: bool = True, colors: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, pre, line): of a node table, a line for each node, named by its pre-order number, and
    one for the edge from its parent.  Types are labels of objects, not nodes of their own."""
    shown = nodes.where(~F.col("field").eqNullSafe(U.TYPE))
    if not positions:
        shown = pruned(shown, F.col("field").eqNullSafe(U.POS)).where(~F.col("field").eqNullSafe(U.POS))
    if not nils:
        shown = shown.where(F.col("kind") != T.NIL)
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    shape = F.when(F.col("kind") == T.OBJECT, "ellipse").when(F.col("kind") == T.ARRAY, "diamond").otherwise("box")
    label = F.when(F.col("kind") == T.OBJECT, F.coalesce("type", F.lit(""))).when(F.col("kind") == T.ARRAY, "").when(F.col("kind") == T.NIL, "nil").otherwise(scalar_text())
    fill = F.lit("")
    for name, color in sorted((colors or {}).items()):
        fill = F.when((F.col("kind") == T.OBJECT) & (F.col("type") == name), f", style=filled, fillcolor={json.dumps(color)}").otherwise(fill)
    own = shown.select("doc_id", "pre", "parent", shape.alias("shape"), label.alias("label"), fill.alias("fill"), F.coalesce("field", F.concat(F.lit("#"), F.col("ord").cast("string"))).alias("step"))
    node = F.format_string("  n%d [shape=%s, label=%s%s];", "pre", "shape", quoted("label"), "fill")
    edge = F.format_string("  n%d -> n%d [label=%s];", "parent", "pre", quoted("step"))
    lines = F.when(F.col("parent").isNull(), F.array(node)).otherwise(F.array(node, edge))
    return own.select("doc_id", "pre", F.explode(lines).alias("line"))


def to_dot(trees: DataFrame, doc: str = "doc", **options) -> DataFrame:
    """(doc_id, dot): a directed graph of every readable document, one text each."""
    lines = dot_lines(shred(trees, doc), **options).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pre", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return lines.select("doc_id", F.concat(F.lit("digraph tree {\n"), body, F.lit("\n}\n")).alias("dot"))


# ---- HTML ----------------------------------------------------------------

# Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Start tags that end open elements, up to the nearest element that bounds them.
_BLOCKS = "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
_ENDED = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "optgroup": "option optgroup", "rt": "rt rp", "rp": "rt rp",
    "td": "td th", "th": "td th", "tr": "td th tr", "thead": "td th tr thead tbody tfoot", "tbody": "td th tr thead tbody tfoot", "tfoot": "td th tr thead tbody tfoot",
}
ENDS = {tag: frozenset(f"p {_ENDED.get(tag, '')}".split()) for tag in _BLOCKS.split()} | {tag: frozenset(f"p {ended}".split()) for tag, ended in _ENDED.items()}
BOUNDS = frozenset("applet button caption dl html marquee object ol select table template ul".split())


def html_tree(text: str) -> dict:
    """A page as a tree: typed by tag, attributes as fields, children in ``children``, texts as Text nodes.
    End tags that may be left out are implied."""
    from html.parser import HTMLParser

    root: dict = {U.TYPE: "html:Document", "children": []}
    stack = [root]

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            for i in range(len(stack) - 1, 0, -1):
                open_ = stack[i][U.TYPE].partition(":")[2]
                if open_ in ENDS.get(tag, ()):
                    del stack[i:]
                elif open_ in BOUNDS:
                    break
            own = {U.TYPE: f"html:{tag}"} | {k: v or "" for k, v in attrs} | {"children": []}
            stack[-1]["children"].append(own)
            if tag not in VOID:
                stack.append(own)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                stack.pop()

        def handle_endtag(self, tag):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][U.TYPE] == f"html:{tag}":
                    del stack[i:]
                    break

        def handle_data(self, data):
            if data.strip():
                stack[-1]["children"].append({U.TYPE: "html:Text", U.TOKEN: data})

    reader = Reader(convert_charrefs=True)
    reader.feed(text)
    reader.close()
    return root


def from_html(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, doc, error) of web pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None) if t is None else _made(lambda t=t: dump_json(html_tree(t))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in made], pa.string()) for i in (0, 1))], ["doc_id", "doc", "error"])

    return pages.select(F.col(page_id).cast("bigint"), html).mapInArrow(run, "doc_id bigint, doc string, error string")


# ---- fixtures ------------------------------------------------------------


def fixtures(spark: SparkSession, folder: str, extension: str, syntax_prefix: str = "_") -> DataFrame:
    """(path, name, content) of the source files of a test corpus; those named as syntax errors are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), F.decode("content", "UTF-8").alias("content")).where(~F.col("name").startswith(syntax_prefix))
