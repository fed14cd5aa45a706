"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint is the bitwise majority of the XXH64 values of a text's shingles.
Distinct fingerprints are cut in five blocks of bits.  Two that differ in at most
three bits agree on two whole blocks or more, so each fingerprint goes to the
ten tables of block pairs and only those that share a (table, value) key are
compared.  A key held by more than ``TILE`` fingerprints is dealt to pairs of
tiles, so no task gets it whole.

The comparison is bit-sliced: plane j holds bit j of all fingerprints of a task
in key order.  For each distance d the planes are XORed with themselves shifted
by d, which compares all pairs (i, i + d) at once, and the difference bits are
added up with carry-save counters of as many bits as the radius needs and an overflow
bit.  A block of planes ends the work on a distance as soon as every pair has overflowed.  Links
inside a task are thinned to a spanning forest; connected components of the
forest edges follow (see ``graph``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K
from .graph import components

TILE = 4096
_STEP = 1 << 16  # shingles whose bits are unpacked at a time
_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (first bit, bits)


def fingerprints_of(texts: pa.ChunkedArray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """uint64 fingerprints of a column of texts."""
    data, off = K.text_bytes(texts)
    out = np.zeros(len(off) - 1, np.uint64)
    for a, b in K.pieces(off, 1 << 20):
        part = data[off[a] : off[b]]
        s, e, first = K.words(part, off[a : b + 1] - off[a], K.SPACE)
        buf, at = K.joined(part, s, e, lower=True)
        n = np.diff(first)
        count = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
        doc, word = K.ragged(first[:-1], count)
        last = np.minimum(word + shingle, first[1:][doc])
        raw, x, y = buf.tobytes(), at[word].tolist(), (at[last] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(raw[i:j], seed) for i, j in zip(x, y, strict=True)), "<u8", len(x))
        out[a:b] = majority(h, count)
    return out


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of ``count`` hashes."""
    ones = np.zeros((len(count), 64), np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    for i in range(0, len(h), _STEP):
        bits = np.unpackbits(h[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = doc[i : i + _STEP]
        head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ones[own[head]] += np.add.reduceat(bits, head, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > count[:, None], axis=1, bitorder="little")
    return packed.reshape(-1).view("<u8") if len(count) else np.zeros(0, np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id bigint, th bigint, fp bigint): key, hash of the text, and the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in K.slices(batch, "text", 4 << 20):
                fp = fingerprints_of(pa.chunked_array([b.column(2)]), shingle)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "th", "fp"])

    text = F.col(text_col).cast("string")
    rows = C.small_batches(docs).select(C.integer_id(docs, id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "id bigint, th bigint, fp bigint")


def planes_of(fp: np.ndarray) -> np.ndarray:
    """64 bit planes of the fingerprints, one spare word at the end."""
    n = len(fp)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.zeros((64, (n // 64 + 2) * 8), np.uint8)
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    packed[:, : rows.shape[1]] = rows
    return packed.view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Column i of the result is column i + d of ``planes``."""
    q, r = divmod(d, 64)
    out = np.zeros_like(planes)
    left = planes[..., q:]
    out[..., : left.shape[-1]] = left >> np.uint64(r)
    if r:
        nxt = planes[..., q + 1 :]
        out[..., : nxt.shape[-1]] |= nxt << np.uint64(64 - r)
    return out


def within(planes: np.ndarray, d: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bit i: columns i and i + d differ in at most ``radius`` bits and i is ``valid``.

    The counters start so high that they overflow just beyond the radius.
    """
    other = _shifted(planes, d)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = max(1, radius.bit_length())
    start = (1 << width) - 1 - radius
    counters = [np.full(planes.shape[1], full if start >> i & 1 else 0, np.uint64) for i in range(width)]
    over = ~valid
    for j in range(0, 64, 2):
        x, y = planes[j] ^ other[j], planes[j + 1] ^ other[j + 1]
        # full adder of two planes and the lowest counter; its carry runs through the others
        part = x ^ y
        carry = (x & y) | (counters[0] & part)
        counters[0] = counters[0] ^ part
        for i in range(1, width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if j % 8 == 6 and (over == full).all():
            return np.zeros_like(over)
    return ~over


def _forest(run: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (places) of the links inside runs of equal, sorted ``run`` numbers."""
    parent = np.arange(len(fp))
    sources, targets = [], []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    here = np.arange(len(fp))  # places still compared: those in runs longer than d
    d = 1
    while True:
        r = run[here]
        head = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        size = np.repeat(np.diff(np.append(head, len(r))), np.diff(np.append(head, len(r))))
        here = here[size > d]
        if not len(here):
            break
        # as many distances as half of the places keep making sense for
        r, planes, limit = run[here], planes_of(fp[here]), 2 * d + 6
        while d < limit and d < len(here):
            same = np.zeros(planes.shape[1] * 64, bool)
            same[: len(here) - d] = r[:-d] == r[d:]
            if not same.any():
                d = limit
                break
            valid = np.packbits(same, bitorder="little").view("<u8")
            hit = within(planes, d, valid, radius)
            if hit.any():
                i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
                a, b = here[i], here[i + d]
                apart = parent[a] != parent[b]
                for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
                    u, v = find(x), find(y)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
                        sources.append(x)
                        targets.append(y)
                while (up := parent[parent] != parent).any():
                    parent[up] = parent[parent[up]]
            d += 1
        else:
            if d >= len(here):
                break
    return np.array(sources, np.int64), np.array(targets, np.int64)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(radius: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        tab, key, tile = (t[c].to_numpy() for c in ("tab", "key", "tile"))
        fp = t["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, tile, key, tab))
        tab, key, tile, fp = tab[order], key[order], tile[order], fp[order]
        new = np.ones(len(fp), bool)
        new[1:] = (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        a, b = _forest(np.cumsum(new), fp, radius)
        return pa.table([fp[a].view(np.int64), fp[b].view(np.int64)], schema=_EDGE)

    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect the same distinct fingerprints as all links of at
    most ``radius`` differing bits do.  ``fps`` has a column fp without repeats."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")

    def block(i: int):
        first, bits = _BLOCKS[i]
        return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))

    keys = [F.struct(F.lit(k).alias("tab"), F.shiftleft(block(i), 13).bitwiseOR(block(j)).alias("key")) for k, (i, j) in enumerate(combinations(range(5), 2))]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.tab", "k.key")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    hot = dealt.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE).select("tab", "key", tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    pair = lambda i: F.when(i < own, i * F.col("tiles") + own).otherwise(own * F.col("tiles") + i)
    dealt = dealt.join(hot, ["tab", "key"], "left")
    dealt = dealt.withColumn("tile", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), pair))))
    n = max(C.parts(fps, 1 << 20), 1)
    by_task = dealt.select(C.slot(n, F.col("tab"), F.col("key"), F.col("tile")).alias("task"), "tab", "key", "tile", "fp")
    return by_task.repartitionById(n, F.col("task")).groupBy("task").applyInArrow(_compare(radius), "a bigint, b bigint")


def _rooted(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, th, fp) of all documents, (fp, root) of all distinct fingerprints)."""
    fps = C.cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = fps.select("fp").distinct()
    roots = components(links(nodes, radius)).select(F.col("node").alias("fp"), "root")
    return fps, C.cut(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), C.few(docs))


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (signed 64 bits), ``component_id``.

    Documents belong together when fingerprints at most ``radius`` bits apart
    connect them; ``component_id`` is the smallest id in the group.

    * null, empty and blank texts have fingerprint 0 and are linked like any other;
      texts of fewer words than a shingle are one shingle.
    * rows that repeat an id or text each get a row; null ids take part in linking
      but are never a component_id, unless the whole group has no id: then null.
    * an empty table gives an empty result; other columns are ignored.
    """
    fps, rooted = _rooted(docs, shingle, radius, id_col, text_col)
    least = fps.groupBy("fp").agg(F.min("id").alias("least")).join(rooted, "fp")
    names = least.groupBy("root").agg(F.min("least").alias("component_id")).join(rooted, "root").select("fp", "component_id")
    return fps.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
