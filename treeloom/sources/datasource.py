"""Graph files as a data source: ``spark.read.format("treegraph").load(folder)``.

``register(spark)`` makes the format known.  Files are planned as partitions of a
few files each and read in the tasks through Arrow's file systems; writing puts
one file per row (doc_id, doc), committed by a rename once the task has ended.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import tree as T
from ..operators.nodes import parse_json
from .graph import GraphError, read_tree, write_tree

FILES = 64  # a partition


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class TreeGraph(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treegraph"

    def schema(self) -> str:
        return "path string, doc string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(".graph"))
        return [_Files(files[i : i + FILES]) for i in range(0, len(files), FILES)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for p in partition.paths:
            with store.open_input_stream(p) as f:
                raw = f.read()
            try:
                yield p, json.dumps(T.native(read_tree(raw)), ensure_ascii=False, sort_keys=True), None
            except (GraphError, UnicodeDecodeError) as e:
                yield p, None, str(e)


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> _Written:
        store, base = _store(self.path)
        store.create_dir(base)
        moves = []
        for r in rows:
            if r["doc"] is not None:
                temp, final = f"{base}/.{uuid.uuid4().hex}", f"{base}/{r['doc_id']}.graph"
                with store.open_output_stream(temp) as f:
                    f.write(write_tree(parse_json(r["doc"])))
                moves.append((temp, final))
        return _Written(moves)

    def commit(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for temp, final in m.moves if m else ():
                store.move(temp, final)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for temp, _final in m.moves if m else ():
                store.delete_file(temp)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeGraph)
