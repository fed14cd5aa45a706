"""Packing token sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``size`` numbers) reaches the
driver.  There, patterns of one to four lengths that nearly fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least
squares, rounded down, and what is left over is packed best-fit by decreasing
length, on counts, not on documents.  The resulting plan says which ranks of
which length fill which place of which sequences; pieces then find their place
from their rank among the pieces of their length.  Ranks come from counts by
(length, slot), so no length, however common, is ranked in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K
from .encode import encoder


def _below(present: np.ndarray, size: int) -> np.ndarray:
    """For each x in 0..size the largest present length <= x, or 0."""
    out = np.zeros(size + 1, np.int64)
    out[present] = present
    return np.maximum.accumulate(out)


def patterns(hist: np.ndarray, size: int, spread: int = 6, firsts: int = 24) -> np.ndarray:
    """Rows of up to four lengths (0: none), descending; each the best fill of its beginning.

    Pairs: every length with the ``spread`` largest partners that fit.  Triples and
    fours: every length with partners at ``firsts`` quantiles of the lengths present.
    """
    present = np.flatnonzero(hist[: size + 1])
    present = present[present > 0]
    fit = _below(present, size)
    rows = [np.stack([present, 0 * present, 0 * present, 0 * present], 1)]
    a, b = present, fit[size - present]
    for _ in range(spread):
        good = b > 0
        rows.append(np.stack([a[good], b[good], 0 * a[good], 0 * a[good]], 1))
        b = np.where(b > 0, fit[np.maximum(b - 1, 0)], 0)
    if len(present):
        marks = np.unique(present[np.linspace(0, len(present) - 1, min(firsts, len(present))).astype(int)])
        a, b = (x.ravel() for x in np.meshgrid(present, marks))
        good = a + b < size
        a, b = a[good], b[good]
        c = fit[size - a - b]
        rows.append(np.stack([a, b, c, 0 * a], 1)[c > 0])
        half = fit[(size - a - b) // 2]
        a, b, half = a[half > 0], b[half > 0], half[half > 0]
        d = fit[size - a - b - half]
        rows.append(np.stack([a, b, half, d], 1)[d > 0])
    return np.unique(-np.sort(-np.concatenate(rows), axis=1), axis=0)


def nnls(pats: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes the lengths used by x repeats of the patterns close to ``hist``
    (accelerated projected gradient; the design matrix stays a list of lengths)."""
    n = len(hist)
    used = pats > 0

    def forward(x):
        return np.bincount(pats[used], np.broadcast_to(x[:, None], pats.shape)[used], n)

    def back(r):
        return np.where(used, r[pats], 0).sum(1)

    full = pats.sum(1)
    start = np.zeros(len(pats))
    v = np.ones(len(pats))
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(forward(v))
        v /= max(np.linalg.norm(v), 1e-30)
    step = 1 / max(1e-12, 1.05 * float(v @ back(forward(v))))
    x = y = start
    t = 1.0
    waste = 0.01 * (full.max() - full) if len(full) else full  # prefers full patterns among equals
    for _ in range(rounds):
        new = np.maximum(0, y - step * (back(forward(y) - hist) + waste))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def _best_fit(left: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """Pack counts of lengths by decreasing length into the fullest sequence that still has room."""
    free: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    open_ = np.zeros(size + 1, bool)
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = np.flatnonzero(open_[length:])
            if len(room):
                at = length + int(room[0])
                pat, k = free[at].popitem()
                open_[at] = bool(free[at])
                take = min(k, n)
                if k > take:
                    free[at][pat] = k - take
                    open_[at] = True
                put, new = at - length, (*pat, length)
            else:
                each = min(size // length, n)
                take, put, new = n // each, size - each * length, (length,) * each
                free[put][new] = free[put].get(new, 0) + take
                open_[put] = True
                n -= take * each
                continue
            free[put][new] = free[put].get(new, 0) + take
            open_[put] = True
            n -= take
    out: dict[tuple[int, ...], int] = {}
    for own in free:
        for pat, k in own.items():
            out[pat] = out.get(pat, 0) + k
    return out


def _plan(hist: np.ndarray, size: int, pats: np.ndarray, times: np.ndarray, slack: int) -> list[tuple[tuple[int, ...], int]]:
    left = hist.copy()
    done: dict[tuple[int, ...], int] = {}
    if left[size]:
        done[(size,)] = int(left[size])
        left[size] = 0
    for i in np.lexsort((-times, -pats.sum(1))).tolist():  # fullest first, as far as the histogram allows
        pat = tuple(int(x) for x in pats[i] if x)
        if not times[i] or sum(pat) < size - slack:
            continue
        k = min([int(times[i]), *(int(left[x]) // pat.count(x) for x in pat)])
        if k > 0:
            for x in pat:
                left[x] -= k
            done[pat] = done.get(pat, 0) + k
    for pat, k in _best_fit(left, size).items():
        done[pat] = done.get(pat, 0) + k
    return sorted(done.items())


def plan(hist: np.ndarray, size: int, slacks: tuple[int, ...] = (0, 2, 8)) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): together they use every length exactly as often as ``hist`` says.

    Rounded patterns that waste more than a slack go to the residual; of a few
    slacks the one that needs the fewest sequences is taken.
    """
    hist = np.asarray(hist, np.int64)
    short = hist.copy()
    short[size] = 0
    pats = patterns(short, size)
    times = np.floor(nnls(pats, short.astype(float)) + 1e-6).astype(np.int64) if len(pats) else np.zeros(0, np.int64)
    return min((_plan(hist, size, pats, times, s) for s in slacks), key=lambda made: sum(k for _, k in made))


class Places:
    """The plan as arrays: rank among the pieces of one length -> (sequence, offset)."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]], size: int):
        rows, base = [], 0
        taken = np.zeros(size + 1, np.int64)
        for pat, k in made:
            at = 0
            for length in pat:
                rows.append((length, int(taken[length]), base, at))
                taken[length] += k
                at += length
            base += k
        rows.sort()
        self.length, self.first, self.base, self.at = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        self.start = np.searchsorted(self.length, np.arange(size + 2))
        self.sequences = base

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rank, length))
        seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0])) if len(order) else np.zeros(0, np.int64)
        for a, b in zip(cuts, np.append(cuts, len(order))[1:], strict=True):
            own = order[a:b]
            x, y = self.start[length[own[0]]], self.start[length[own[0]] + 1]
            i = x + np.searchsorted(self.first[x:y], rank[own], "right") - 1
            seq[own], off[own] = self.base[i] + rank[own] - self.first[i], self.at[i]
        return seq, off


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length): texts over ``size`` are cut so that only the first piece may be shorter."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, piece, start, length, ids_crc32) of all tokenised texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, text in enumerate(b.column(1)):
                ids = enc(text.as_py(), end)
                for k, (s, n) in enumerate(pieces_of(len(ids), size)):
                    for col, v in zip(rows, (i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])],
                ["id", "piece", "start", "length", "ids_crc32"],
            )
            K.trim()

    rows = C.small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)


def pack(cut_pieces: DataFrame, size: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """``cut_pieces`` (id_col, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    Every piece gets a place; the pieces of a sequence follow each other from
    offset 0 and are at most ``size`` long together.  An empty table gives an
    empty result; null ids and repeated rows are pieces like any other.
    """
    rows = C.cut(cut_pieces)
    n = C.parts(rows, 4 << 20)
    hist = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``size`` rows
        hist[r["length"]] = r["count"]
    places = Places(plan(hist, size), size)
    keyed = rows.withColumn("_slot", C.slot(n, *(F.col(c) for c in (id_col, "piece", "ids_crc32"))))
    counts = keyed.groupBy("length", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_slot").orderBy(id_col, "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(own) - 1).join(counts, ["length", "_slot"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).cast("bigint").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, off = places(b.column("length").to_numpy(zero_copy_only=False), b.column("_rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = rows.schema[id_col].dataType.simpleString()
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack whole texts.

    Returns one row per piece: ``id_col, piece, start, length, ids_crc32,
    sequence_id, offset``.

    * null and empty texts are the end id alone; texts of any length are cut, never shortened.
    * null ids and repeated rows are documents like any other and get places of their own; which of
      two equal pieces gets which place is settled by id, piece and checksum, and else arbitrary.
    * an empty table gives an empty result; other columns are ignored.
    """
    return pack(pieces(docs, path, size, end, id_col, text_col), size, id_col)
