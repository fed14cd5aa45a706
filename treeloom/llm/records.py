"""Token ids as length-delimited binary records with a separate offset index.

A data file is a run of frames::

    length of the payload   uint64
    masked checksum of it   uint32
    payload                 key kind (uint8), width (uint8), key (int64), ids
    masked checksum of it   uint32

all little-endian; ids are uint16 or uint32 as ``width`` says.  The checksum is
CRC-32, rotated right by 15 bits plus a constant, so that a checksum of data that
holds checksums stays meaningful.  Beside each data file, ``.idx`` holds one
(offset, length of frame, ids before it in the file) uint64 triple a record,
which is what shuffled reads need.

Documents are range-partitioned and sorted by id, and every task writes its own
files, of bounded size, under an attempt's name first; the final name appears by
a rename, so a task that runs again replaces equal bytes by equal bytes.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .encode import encoder

MASK = 0xA282EAD8
FILE_BYTES = 64 << 20


class Corrupt(ValueError):
    """A frame whose checksum or length is wrong."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(key: int | None, ids: np.ndarray, width: int) -> bytes:
    kind = 0 if key is None else 1
    body = bytes((kind, width)) + (key or 0).to_bytes(8, "little", signed=True) + ids.astype(f"<u{width}").tobytes()
    size = len(body).to_bytes(8, "little")
    return b"".join((size, masked(size).to_bytes(4, "little"), body, masked(body).to_bytes(4, "little")))


def unframe(raw: bytes) -> tuple[int | None, np.ndarray]:
    """(key, ids as uint32) of one whole frame."""
    size = int.from_bytes(raw[:8], "little")
    if len(raw) < 12 or masked(raw[:8]) != int.from_bytes(raw[8:12], "little") or len(raw) != size + 16:
        raise Corrupt("length")
    body = raw[12:-4]
    if masked(body) != int.from_bytes(raw[-4:], "little"):
        raise Corrupt("payload")
    key = int.from_bytes(body[2:10], "little", signed=True) if body[0] else None
    return key, np.frombuffer(body, f"<u{body[1]}", offset=10).astype("<u4")


class RecordFile:
    """Random access to one data file through its index.

    A file without records has an empty index; a record of a null id has None as key.  A record
    whose lengths or checksums don't agree raises ``Corrupt``, never a wrong result."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        with self.fs.open_input_stream(self.path + ".idx") as f:
            self.index = np.frombuffer(f.read(), "<u8").reshape(-1, 3)

    def __len__(self) -> int:
        return len(self.index)

    def read(self, which: list[int] | None = None) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(ids before it in the file, key, ids) of records, in the given or the stored order."""
        with self.fs.open_input_file(self.path) as f:
            for i in range(len(self)) if which is None else which:
                at, size, before = self.index[i].tolist()
                f.seek(at)
                yield (before, *unframe(f.read(size)))

    def shuffled(self, seed: int) -> Iterator[tuple[int, int | None, np.ndarray]]:
        order = list(range(len(self)))
        random.Random(seed).shuffle(order)
        return self.read(order)


class _Writer:
    """One data file and its index, under an attempt's name until it is closed."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.final, self.uri = f"{base}/{name}", f"{folder}/{name}"
        self.temp = f"{base}/.{name}.{attempt}"
        self.out = self.fs.open_output_stream(self.temp)
        self.index: list[tuple[int, int, int]] = []
        self.size = self.ids = 0

    def add(self, key: int | None, ids: np.ndarray, width: int) -> None:
        raw = frame(key, ids, width)
        self.out.write(raw)
        self.index.append((self.size, len(raw), self.ids))
        self.size += len(raw)
        self.ids += len(ids)

    def close(self) -> dict:
        self.out.close()
        with self.fs.open_output_stream(self.temp + ".idx") as f:
            f.write(np.array(self.index, "<u8").tobytes())
        self.fs.move(self.temp + ".idx", self.final + ".idx")
        self.fs.move(self.temp, self.final)
        return {"uri": self.uri, "records": len(self.index), "ids": self.ids, "bytes": self.size}


BLOCK = 1024  # shards whose ids are added up together
_MANIFEST = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("uri", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def write_records(docs: DataFrame, folder: str, path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write them below ``folder`` in ascending ``id_col`` order.

    Returns the manifest, one row per file: ``shard, part`` (their order is the
    order of the documents), ``uri, records, ids, bytes``; it is already
    materialised.  Null texts are empty (the end id alone); null ids come first;
    rows that repeat an id follow each other by text hash.
    """
    rows = C.small_batches(docs).select(C.integer_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = C.parts(rows, FILE_BYTES)
    pafs_root, base = pafs.FileSystem.from_uri(folder)
    pafs_root.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(path)
        shard, attempt, part, out = context.partitionId(), context.taskAttemptId(), 0, None
        width = 2 if enc.library.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4

        def manifest(w: _Writer) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "part": part, **w.close()}], _MANIFEST)

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                out = out or _Writer(folder, f"part-{shard:06d}-{part:04d}.rec", attempt)
                out.add(key.as_py(), enc(text.as_py(), end), width)
                if out.size >= FILE_BYTES:
                    yield manifest(out)
                    part, out = part + 1, None
        if out:
            yield manifest(out)

    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    return C.cut(ordered.mapInArrow(run, "shard int, part int, uri string, records bigint, ids bigint, bytes bigint"))


def read_records(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start`` (ids of all records before it), ``n_tokens, ids_crc32`` of every record, read back and checked.

    Null ids come back as null, repeated ids each with a row; an empty manifest gives an empty
    result; a damaged record ends the job with ``Corrupt``.
    """
    # ids before a file: those before its block of shards, and those before it in the block
    block = F.floor(F.col("shard") / BLOCK).alias("block")
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = manifest.select("shard", "part", "uri", "ids", block)
    inside = own.withColumn("inside", before(Window.partitionBy("block").orderBy("shard", "part")))
    blocks = own.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", before(Window.orderBy("block")).alias("outside"))  # one row a block
    files = inside.join(blocks, "block").select("shard", "part", "uri", (F.col("inside") + F.col("outside")).alias("base"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for at, key, ids in RecordFile(uri).read():
                    rows.append((key, base + at, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _records(rows)
                        rows = []
                yield _records(rows)

    # one file a task, dealt by what it is, not by how many there are
    dealt = files.repartition(n, "uri").select("uri", "base")
    return dealt.mapInArrow(run, "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "start", "n_tokens", "ids_crc32"])
