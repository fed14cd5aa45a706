"""The binary graph format of trees: framed protobuf messages behind a magic number.

A file is the magic, a version, a framed header (last id, root, metadata) and
framed nodes with ascending ids.  Scalars are stored once; objects with the same
keys share the key list of the first; equal objects and arrays are stored once.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tree as T
from ..operators.nodes import parse_json

# Fixed values of the format.
MAGIC, VERSION = b"\x00bgr", 1
MESSAGE_LIMIT = 10 << 20
_ID, _STR, _INT, _UINT, _FLOAT, _BOOL, _KEYS, _VALUES, _IS_OBJECT, _KEYS_FROM, _OFFSET = 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11


class GraphError(ValueError):
    """Bytes that are not a valid graph."""


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise GraphError("truncated number")
        b = data[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def framed(message: bytes) -> bytes:
    return varint(len(message)) + message


def messages(data: bytes, at: int = 0, limit: int = MESSAGE_LIMIT) -> Iterator[bytes]:
    """The framed messages of a stream; a frame over the limit is refused."""
    while at < len(data):
        size, at = read_varint(data, at)
        if size > limit:
            raise GraphError(f"message of {size} bytes is over the limit of {limit}")
        if at + size > len(data):
            raise GraphError("unexpected end")
        yield data[at : at + size]
        at += size


def skip_message(data: bytes, at: int) -> int:
    """The place after the message at ``at``."""
    size, at = read_varint(data, at)
    return at + size


def _numbers(tag: int, values: list[int]) -> bytes:
    packed = b"".join(map(varint, values))
    return varint(tag << 3 | 2) + framed(packed) if values else b""


def _fields(message: bytes) -> Iterator[tuple[int, Any]]:
    at = 0
    while at < len(message):
        key, at = read_varint(message, at)
        tag, wire = key >> 3, key & 7
        if wire == 0:
            value, at = read_varint(message, at)
        elif wire == 1:
            value, at = message[at : at + 8], at + 8
        elif wire == 2:
            size, at = read_varint(message, at)
            value, at = message[at : at + size], at + size
        elif wire == 5:
            value, at = message[at : at + 4], at + 4
        else:
            raise GraphError(f"unknown wire type {wire}")
        yield tag, value


def _listed(value: Any) -> list[int]:
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = read_varint(value, at)
        out.append(n)
    return out


@dataclass
class GraphNode:
    id: int
    kind: int = T.ARRAY
    value: Any = None
    keys: list[int] = field(default_factory=list)
    values: list[int] = field(default_factory=list)


@dataclass
class Graph:
    """A decoded file: nodes by id, as they are stored."""

    root: int = 0
    meta: int = 0
    last: int = 0
    nodes: dict[int, GraphNode] = field(default_factory=dict)

    def tree(self) -> Any:
        """The tree below the root; subtrees may be shared, cycles are refused."""
        done: dict[int, Any] = {}
        open_: set[int] = set()

        def make(i: int) -> Any:
            if i == 0:
                return None
            if i in done:
                return T.clone(done[i])
            if i not in self.nodes:
                raise GraphError(f"node {i} is not defined")
            if i in open_:
                raise GraphError("not a tree")
            n = self.nodes[i]
            open_.add(i)
            if n.kind == T.OBJECT:
                if len(n.keys) != len(n.values):
                    raise GraphError(f"{len(n.keys)} keys and {len(n.values)} values")
                out: Any = {}
                for k, v in zip(n.keys, n.values, strict=True):
                    name = make(k)
                    if not isinstance(name, str):
                        raise GraphError("keys must be strings")
                    out[name] = make(v)
            elif n.kind == T.ARRAY:
                out = [make(v) for v in n.values]
            else:
                out = n.value
            open_.discard(i)
            done[i] = out
            return out

        return make(self.root)


def read_graph(data: bytes) -> Graph:
    if len(data) < 8:
        raise GraphError("unexpected end")
    if data[:4] != MAGIC:
        raise GraphError("not a graph file")
    if (version := struct.unpack_from("<I", data, 4)[0]) != VERSION:
        raise GraphError(f"unsupported version: {version:x}")
    stream = messages(data, 8)
    g, before = Graph(), 0
    for tag, v in _fields(next(stream, b"")):
        g.last, g.root, g.meta = (v if tag == 1 else g.last), (v if tag == 2 else g.root), (v if tag == 3 else g.meta)
    for message in stream:
        n, keys_from, offset, is_object = GraphNode(0), 0, 0, False
        for tag, v in _fields(message):
            if tag == _ID:
                n.id = v
            elif tag == _STR:
                n.kind, n.value = T.STRING, v.decode()
            elif tag == _INT:
                n.kind, n.value = T.INT, v - (1 << 64) if v >> 63 else v
            elif tag == _UINT:
                n.kind, n.value = T.UINT, T.Uint(v)
            elif tag == _FLOAT:
                n.kind, n.value = T.FLOAT, struct.unpack("<d", v)[0]
            elif tag == _BOOL:
                n.kind, n.value = T.BOOL, bool(v)
            elif tag == _KEYS:
                n.keys += _listed(v)
            elif tag == _VALUES:
                n.values += _listed(v)
            elif tag == _IS_OBJECT:
                is_object = bool(v)
            elif tag == _KEYS_FROM:
                keys_from = v
            elif tag == _OFFSET:
                offset = v
        if n.id == 0:
            n.id = before + 1
        elif n.id <= before:
            raise GraphError("node ids must ascend")
        before = n.id
        if keys_from:
            if keys_from not in g.nodes:
                raise GraphError(f"keys of the undefined node {keys_from}")
            n.keys = list(g.nodes[keys_from].keys)
        if n.kind == T.ARRAY and (n.keys or is_object):
            n.kind = T.OBJECT
        if offset:
            n.values = [v + offset for v in n.values]
        g.nodes[n.id] = n
    if g.root == 0:  # what nothing refers to is the root, or an array of roots
        used = {i for n in g.nodes.values() for i in (*n.keys, *n.values)}
        roots = sorted(set(g.nodes) - used - {g.meta})
        if len(roots) == 1:
            g.root = roots[0]
        elif roots:
            g.last = max(g.last, before) + 1
            g.root = g.last
            g.nodes[g.root] = GraphNode(g.root, values=roots)
    return g


def read_tree(data: bytes) -> Any:
    return read_graph(data).tree()


def _varint_size(n: int) -> int:
    return max(1, (n.bit_length() + 6) // 7)


class _Writer:
    """Nodes in the order in which they are met; ids from 1."""

    def __init__(self):
        self.out: list[bytes | None] = []
        self.scalars: dict[Any, int] = {}
        self.key_lists: dict[tuple, int] = {}
        self.composites: dict[tuple, int] = {}

    def add(self, n: Any) -> int:
        if n is None:
            return 0
        if not isinstance(n, (dict, list)):
            key = T.unique_key(n)
            if key not in self.scalars:
                self.out.append(self.scalar(n))
                self.scalars[key] = len(self.out)
            return self.scalars[key]
        self.out.append(None)
        here = len(self.out)
        body, same = (self.object if isinstance(n, dict) else self.array)(n, here)
        if same:  # stored before: nothing below it was new, so its number is free again
            self.out.pop()
            return same
        self.out[here - 1] = body
        return here

    @staticmethod
    def scalar(n: Any) -> bytes:
        kind = T.kind_of(n)
        if kind == T.STRING:
            return varint(_STR << 3 | 2) + framed(n.encode())
        if kind == T.FLOAT:
            return varint(_FLOAT << 3 | 1) + struct.pack("<d", n)
        return varint({T.INT: _INT, T.UINT: _UINT, T.BOOL: _BOOL}[kind] << 3) + varint(int(n))

    def object(self, n: dict, here: int) -> tuple[bytes, int]:
        named = sorted((self.add(k), k) for k in sorted(n))
        keys = tuple(i for i, _ in named)
        first = self.key_lists.setdefault(keys, here)
        values = [self.add(n[k]) for _, k in named]
        if (same := self.composites.setdefault((keys, tuple(values)), here)) != here:
            return b"", same
        low = min(values, default=0)
        saved = sum(_varint_size(v) - _varint_size(v - low) for v in values) - _varint_size(low) - 1
        if low and saved > 0:
            values = [v - low for v in values]
        else:
            low = 0
        body = _numbers(_KEYS, list(keys)) if first == here else b""
        body += _numbers(_VALUES, values)
        if not n:
            body += varint(_IS_OBJECT << 3) + b"\x01"
        if first != here:
            body += varint(_KEYS_FROM << 3) + varint(first)
        if low:
            body += varint(_OFFSET << 3) + varint(low)
        return body, 0

    def array(self, n: list, here: int) -> tuple[bytes, int]:
        values = [self.add(v) for v in n]
        same = self.composites.setdefault((None, tuple(values)), here)
        return (b"", same) if same != here else (_numbers(_VALUES, values), 0)


def write_tree(root: Any) -> bytes:
    """A tree as a graph file; ids are consecutive, so none is written out."""
    w = _Writer()
    at = w.add(root)
    header = varint(1 << 3) + varint(len(w.out) + 1) + (varint(2 << 3) + varint(at) if at else b"")
    return MAGIC + struct.pack("<I", VERSION) + framed(header) + b"".join(framed(b or b"") for b in w.out)


# ---- DataFrames ----------------------------------------------------------


def encode(trees: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc_id, graph, error): JSON documents as graph files; what can't be written has an error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None) if t is None else _made(lambda t=t: write_tree(parse_json(t))) for t in b.column(1).to_pylist()]
            columns = [pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "graph", "error"])

    return trees.select(F.col("doc_id").cast("bigint"), F.col(doc)).mapInArrow(run, "doc_id bigint, graph binary, error string")


def decode(graphs: DataFrame, content: str = "graph") -> DataFrame:
    """(doc_id, doc, error): graph files as JSON documents; what does not decode has an error instead."""
    return decode_keeping(graphs, "doc_id", content)


def raw_nodes(graphs: DataFrame, content: str = "graph") -> DataFrame:
    """(doc_id, root, id, kind, value, keys, values, error): the stored nodes as they are; one row
    with the error alone of a file that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("root", pa.int64()), ("id", pa.int64()), ("kind", pa.int32()), ("value", pa.string()), ("keys", pa.list_(pa.int64())), ("values", pa.list_(pa.int64())), ("error", pa.string())])
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g, error = _made(lambda raw=raw: read_graph(raw))
                if g is None:
                    rows.append({"doc_id": doc_id, "error": error})
                    continue
                for n in g.nodes.values():
                    rows.append({"doc_id": doc_id, "root": g.root, "id": n.id, "kind": n.kind, "value": T.to_string(n.value) if n.kind & T.VALUES else None, "keys": n.keys, "values": n.values})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return graphs.select("doc_id", F.col(content)).where(F.col(content).isNotNull()).mapInArrow(run, "doc_id bigint, root bigint, id bigint, kind int, value string, keys array<bigint>, values array<bigint>, error string")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, doc, error) of graph files in a folder, decoded where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return decode_keeping(files, "path", "content")


def decode_keeping(graphs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, doc, error) of graph files under a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(None, None) if raw is None else _made(lambda raw=raw: json.dumps(T.native(read_tree(raw)), ensure_ascii=False, sort_keys=True)) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in made], pa.string()) for i in (0, 1))], [key, "doc", "error"])

    own = graphs.select(key, content)
    return own.mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, doc string, error string")


def _made(f) -> tuple[Any, str | None]:
    """(result, error): whatever goes wrong with one file is its own error."""
    try:
        return f(), None
    except Exception as e:  # noqa: BLE001 - no file may end the job of all others
        return None, f"{type(e).__name__}: {e}"


def write_files(trees: DataFrame, folder: str, doc: str = "doc") -> DataFrame:
    """Writes ``<doc_id>.graph`` for every document below a folder that all executors share.

    Returns (doc_id, path, bytes), materialised row by row as files appear; a file
    takes its name by a rename, so a repeated task replaces it by the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            ids, paths, sizes = [], [], []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                temp, final = f"{base}/.{doc_id}.{attempt}", f"{base}/{doc_id}.graph"
                with store.open_output_stream(temp) as out:
                    out.write(raw)
                store.move(temp, final)
                ids.append(doc_id)
                paths.append(f"{folder.rstrip('/')}/{doc_id}.graph")
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "path", "bytes"])

    return encode(trees, doc).drop("error").mapInArrow(run, "doc_id bigint, path string, bytes bigint")
