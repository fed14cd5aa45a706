"""Connected components by alternating large-star and small-star rounds.

Only aggregates with map-side combining and equi-joins are used, and the rows of a
hub are dealt over ``SALTS`` tasks, so they are never gathered in one.  Each
round is cut to the shared folder; the driver sees two numbers per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, unsized


SALTS = 16  # tasks that share the neighbours of one node


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Hang the neighbours of every node on the smallest of them (larger ones if ``both``)."""
    if both:
        near = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    salted = least.select("u", "m", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt"))
    pairs = near.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])
    if both:
        hung = pairs.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = pairs.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return hung.filter("a <> b").distinct()


ALONE = 1 << 19  # edges that one task takes at most


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of one task: (a, b), each node but the smallest with the smallest."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not parts:
        return
    names, ends = np.unique(np.concatenate(parts), return_inverse=True)
    parent = list(range(len(names)))
    for x, y in ends.reshape(-1, 2).tolist():
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        parent[max(x, y)] = min(x, y)
    root = np.array(parent)
    while (up := root[root] != root).any():
        root[up] = root[root[up]]
    moved = root != np.arange(len(names))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[root[moved]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has bigint columns a, b.  Returns (node, root), root the smallest
    node reachable; nodes without edges, and roots themselves, do not occur.

    Up to ``ALONE`` edges, counted, are united in one task; more of them in rounds."""
    mark = (F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("h"))
    files = few(edges)
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), files)
    seen = edges.agg(*mark).first()
    if seen["n"] <= ALONE:
        edges = cut(edges.coalesce(1).mapInArrow(_united, "a bigint, b bigint"))
    else:
        while seen["n"]:
            edges = unsized(cut(_star(_star(edges, True), False), 1 + seen["n"] // 250_000))
            now = edges.agg(*mark).first()
            if now == seen:
                break
            seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
