"""Exact deduplication against immutable snapshots screened by binary-fuse filters.

A snapshot holds one entry per distinct normalised text (digest, size of the
group, the row that stays) and, for every bucket of digests, a static fuse
filter.  A new batch is first grouped by digest on its own.  Its distinct digests
are screened by the filters: negatives are certainly new and touch nothing else;
positives join the entries of their bucket on the whole digest, and the
normalised bytes of the two rows that stand for the groups are compared before
the groups become one.

Grouping is by aggregates with map-side combining on (digest) rows of some 60
bytes, so a text that a third of all rows repeat arrives as one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .fuse import FuseFilter

BLANKS = "\t\n\x0b\x0c\r "
FILTER_KEYS = 1 << 20  # digests under one filter


def normalised(text: Column) -> Column:
    """The text without blanks; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest): key, code points of the original text, SHA-256 of the normalised bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(C.integer_id(docs, id_col).alias("id"), F.length(text).alias("n"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"))


def _best(n: Column, key: Column) -> Column:
    """Orders rows so that the greatest one stays: longest text, then smallest id, null ids last."""
    return F.struct(n.alias("n"), key.isNotNull().alias("has"), (-key).alias("minus"), key.alias("id"))


def grouped(rows: DataFrame) -> DataFrame:
    """(digest, size, best) by digest."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.max(_best(F.col("n"), F.col("id"))).alias("best"))


def _bucket(n: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def _keys(digest: pa.ChunkedArray) -> np.ndarray:
    raw = np.frombuffer(b"".join(d[8:16] for d in digest.to_pylist()), ">u8")
    return raw.astype(np.uint64)


@dataclass(frozen=True)
class Snapshot:
    """Written once under ``path``: ``entries`` (digest, size, best, bucket) and ``filters`` (bucket, filter)."""

    path: str
    buckets: int

    @classmethod
    def write(cls, groups: DataFrame, path: str) -> Snapshot:
        buckets = C.parts(groups, 80 * FILTER_KEYS)
        groups.select("digest", "size", "best", _bucket(buckets).alias("bucket")).coalesce(C.few(groups)).write.parquet(f"{path}/entries")
        own = cls(path, buckets)

        def build(t: pa.Table) -> pa.Table:
            f = FuseFilter.build(_keys(t["digest"]))
            return pa.table({"bucket": pa.array([t["bucket"][0].as_py()], pa.int32()), "filter": pa.array([f.dump()], pa.binary())})

        filters = own.entries(groups).select("bucket", "digest").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")
        filters.coalesce(C.few(groups)).write.parquet(f"{path}/filters")
        return own

    def entries(self, like: DataFrame) -> DataFrame:
        return like.sparkSession.read.parquet(f"{self.path}/entries")

    def screen(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (distinct digests) that the filters don't rule out: (digest)."""

        def run(new: pa.Table, filters: pa.Table) -> pa.Table:
            if not new.num_rows or not filters.num_rows:
                return pa.table({"digest": pa.array([], pa.binary())})
            maybe = FuseFilter.load(filters["filter"][0].as_py()).holds(_keys(new["digest"]))
            return pa.table({"digest": new["digest"].filter(pa.array(maybe))})

        filters = batch.sparkSession.read.parquet(f"{self.path}/filters")
        new = batch.select(_bucket(self.buckets).alias("bucket"), "digest").repartition(self.buckets, "bucket").groupBy("bucket")
        return new.cogroup(filters.repartition(self.buckets, "bucket").groupBy("bucket")).applyInArrow(run, "digest binary")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of ``pairs`` (digest, old, new: ids that stand for two groups) those whose bytes agree: (digest)."""
    want = C.small_side(pairs.select("digest", F.explode(F.array("old", "new")).alias("id")).distinct(), 48)
    texts = docs.select(C.integer_id(docs, id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    both = texts.join(want, texts["id"].eqNullSafe(want["id"])).where(F.unhex(F.sha2("norm", 256)) == F.col("digest"))
    same = both.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    return same.where("a = b").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, keep_id, group_size, kept, digest``.

    Half of the documents, by a stable hash of their row, play the immutable
    snapshot and the other half the new batch.  Texts are equal if they are so
    without blanks; of equal texts the one with the most code points, then with
    the smallest id stays.

    * null text: equal to empty and blank texts.
    * null ids lose against any id; a group of null ids only keeps null, and all
      its rows count as kept (they cannot be told apart by id).
    * rows that repeat the id that stays are all kept; other columns are ignored;
      an empty table gives an empty result.
    """
    spark = docs.sparkSession
    side = F.pmod(F.xxhash64("id", "n", "digest"), F.lit(2)).cast("int").alias("side")
    rows = C.cut(digests(docs, id_col, text_col).select("id", "n", "digest", side))
    snapshot = Snapshot.write(grouped(rows.where("side = 0")), C.scratch(spark, "snapshot"))
    few = C.few(docs)
    batch = C.cut(grouped(rows.where("side = 1")), few)
    old = snapshot.entries(rows).select("digest", F.col("size").alias("old_size"), F.col("best").alias("old"))
    hits = C.cut(snapshot.screen(batch).join(old, "digest").join(batch, "digest"), few)
    same = confirmed(hits.select("digest", F.col("old.id").alias("old"), F.col("best.id").alias("new")), docs, id_col, text_col)
    both = C.cut(hits.join(same, "digest").select("digest", (F.col("size") + F.col("old_size")).alias("size"), F.greatest("best", "old").alias("best")), few)
    # groups of one side, unless they have become one with the other side's
    alone = old.select("digest", F.col("old_size").alias("size"), F.col("old").alias("best"), F.lit(0).alias("side"))
    alone = alone.unionByName(batch.select("digest", "size", "best", F.lit(1).alias("side")))
    final = alone.join(both.select("digest", F.col("size").alias("both_size"), F.col("best").alias("both")), "digest", "left")
    final = final.select("digest", "side", F.coalesce("both_size", "size").alias("group_size"), F.coalesce("both.id", "best.id").alias("keep_id"))
    out = rows.join(final, ["digest", "side"])
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps; of rows that repeat
    id and text (blanks aside) exactly one.

    * null, empty and blank texts are one group; a group of null ids only keeps one row.
    * ties of length go to the smallest id; an empty table gives an empty result.
    """
    kept = exact_dedup(docs, id_col, text_col).where("kept")
    keep = C.cut(kept.groupBy(F.col(id_col).alias("id"), "digest").agg(F.count(F.lit(1)).alias("n")), C.few(docs))
    return C.one_of_each(docs, {"id": C.integer_id(docs, id_col), "digest": F.unhex(F.sha2(normalised(F.col(text_col)), 256))}, keep)
