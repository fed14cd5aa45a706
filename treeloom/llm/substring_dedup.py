"""Substring deduplication with difference-cover anchors.

Words at positions whose residue modulo 7 lies in the perfect difference set
{1, 2, 4} start an *anchor* of ``window - 6`` words.  For any two positions i, j
there is an l < 7 with i + l and j + l both in the cover, so two equal windows
always contain a common aligned anchor, although only 3 of 7 positions are
hashed.  Anchors seen in two documents or more are then extended: every window
around such an anchor is hashed as a whole, and windows are the same if their 128 bits
are: among 10^12 windows, the odds of one mistake are below 10^-14.

Execution.  Documents are grouped in batches by a stable hash of their row.  A
batch and a key range (bucket) exchange one packed binary row, not one row per
anchor, and a batch sends each distinct key once, so a passage that occurs in a
third of all documents costs one entry per batch.  Rows and work are in proportion to
the keys of a batch: where there are more ranges than keys, a row holds one key.  A bucket answers with one bit
per anchor, or with the smallest document holding the window.  Nothing goes to
the driver; all state is shuffle data and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

PERIOD, COVER = 7, (1, 2, 4)
_LAST = np.iinfo(np.int64).max


class _Batch:
    """Words, anchors and windows of the documents of one batch."""

    def __init__(self, ids: pa.ChunkedArray, texts: pa.ChunkedArray, window: int):
        K.trim()  # of the batch before
        self.window, self.anchor = window, window - PERIOD + 1
        self.null = np.asarray(ids.is_null().combine_chunks()) if len(ids) else np.zeros(0, bool)
        self.ids = np.asarray(ids.fill_null(_LAST).combine_chunks()) if len(ids) else np.zeros(0, np.int64)
        self.data, self.off = K.text_bytes(texts)
        self.s, self.e, self.first = K.words(self.data, self.off, K.SPACE)
        self.h = K.HASH(self.data, self.s, self.e)
        n = np.diff(self.first)
        self.n = n
        self.owner = np.repeat(np.arange(len(n)), n)
        self.at = np.arange(len(self.h)) - self.first[self.owner]  # place of each word in its document

    def anchors(self):
        """(positions, hashes) of all anchors of documents that hold a window."""
        left = self.n[self.owner] - self.at
        good = np.isin(self.at % PERIOD, COVER) & (left >= self.anchor) & (self.n[self.owner] >= self.window)
        at = np.flatnonzero(good)
        return at, K.window_hash(self.h, at, self.anchor, 1)

    def candidates(self, at: np.ndarray) -> np.ndarray:
        """Starts of the windows that contain an anchor of ``at``."""
        n = len(self.h)
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(at - PERIOD + 1, self.first[self.owner[at]]), 1)
        np.add.at(mark, at + 1, -1)
        return np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (self.n[self.owner] - self.at >= self.window))

    def windows(self, start: np.ndarray):
        h2 = K.HASH2(self.data, self.s, self.e)
        return K.window_hash(self.h, start, self.window, 2), K.window_hash(h2, start, self.window, 3)


def _buckets(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the buckets that the sorted ``keys`` fall in: equal ranges of the
    64-bit space.  What is done is in proportion to the keys, however many buckets there are."""
    own = (keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
    used, first = np.unique(own, return_index=True)
    ends = np.append(first, len(keys)).tolist()
    return list(zip(used.tolist(), ends[:-1], ends[1:], strict=True))


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal (sorted) keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


_SENT = "bucket int, batch int, kind int, k1 binary, k2 binary, v binary"
_BACK = "batch int, kind int, bucket int, v binary"
_SENT_PA = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("kind", pa.int32()), ("k1", pa.binary()), ("k2", pa.binary()), ("v", pa.binary())])
_BACK_PA = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("v", pa.binary())])


def _anchor_sender(window: int, buckets: int):
    def send(t: pa.Table) -> pa.Table:
        b = _Batch(t["id"], t["text"], window)
        at, h = b.anchors()
        doc = b.ids[b.owner[at]]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = _runs(h)
        heads = np.flatnonzero(new)
        many = np.zeros(0, bool) if not len(heads) else np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
        keys = h[heads]
        batch = t["batch"][0].as_py()
        rows = [{"bucket": i, "batch": batch, "kind": 1, "k1": keys[x:y].tobytes(), "k2": b"", "v": np.packbits(many[x:y]).tobytes()} for i, x, y in _buckets(keys, buckets)]
        return pa.Table.from_pylist(rows, _SENT_PA)

    return send


def _share(t: pa.Table) -> pa.Table:
    """Of the anchors of one bucket: which occur in two documents or more."""
    keys = [np.frombuffer(x, np.uint64) for x in t["k1"].to_pylist()]
    many = [np.unpackbits(np.frombuffer(v, np.uint8), count=len(k)).astype(bool) for k, v in zip(keys, t["v"].to_pylist(), strict=True)]
    k, m = np.concatenate(keys), np.concatenate(many)
    order = np.argsort(k, kind="stable")
    heads = np.flatnonzero(_runs(k[order]))
    size = np.diff(np.append(heads, len(k)))
    shared = (size > 1) | np.logical_or.reduceat(m[order], heads)
    answer = np.empty(len(k), bool)
    answer[order] = np.repeat(shared, size)
    ends = np.cumsum([len(x) for x in keys])
    rows = [{"batch": b, "kind": 1, "bucket": t["bucket"][0].as_py(), "v": np.packbits(answer[y - len(x) : y]).tobytes()} for b, x, y in zip(t["batch"].to_pylist(), keys, ends, strict=True)]
    return pa.Table.from_pylist(rows, _BACK_PA)


def _shared_anchors(b: _Batch, answers: dict[int, bytes], buckets: int) -> np.ndarray:
    at, h = b.anchors()
    keys = np.unique(h)
    bits = [np.unpackbits(np.frombuffer(answers[i], np.uint8), count=y - x) for i, x, y in _buckets(keys, buckets)]
    flag = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    return at[flag[np.searchsorted(keys, h)]]


def _window_sender(window: int, buckets: int):
    def send(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _SENT_PA.empty_table()
        b, batch = _Batch(t["id"], t["text"], window), t["batch"][0].as_py()
        answers = dict(zip(back["bucket"].to_pylist(), back["v"].to_pylist(), strict=True))
        start = b.candidates(_shared_anchors(b, answers, buckets))
        h1, h2 = b.windows(start)
        doc = b.ids[b.owner[start]]
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc = h1[order], h2[order], doc[order]
        heads = np.flatnonzero(_runs(h1, h2))
        h1, h2, doc = h1[heads], h2[heads], doc[heads]  # the first of a run has the smallest doc
        rows = [{"bucket": i, "batch": batch, "kind": 1, "k1": b"", "k2": b"", "v": v} for i, v in answers.items()]
        rows += [{"bucket": i, "batch": batch, "kind": 2, "k1": h1[x:y].tobytes(), "k2": h2[x:y].tobytes(), "v": doc[x:y].tobytes()} for i, x, y in _buckets(h1, buckets)]
        return pa.Table.from_pylist(rows, _SENT_PA)

    return send


def _smallest(t: pa.Table) -> pa.Table:
    """Of the windows of one bucket: the smallest document that holds each.  Anchor bits pass through."""
    bucket, rows, sent = t["bucket"][0].as_py(), [], []
    for r in t.to_pylist():
        if r["kind"] == 1:
            rows.append({"batch": r["batch"], "kind": 1, "bucket": bucket, "v": r["v"]})
        else:
            sent.append((r["batch"], np.frombuffer(r["k1"], np.uint64), np.frombuffer(r["k2"], np.uint64), np.frombuffer(r["v"], np.int64)))
    if sent:
        h1, h2, doc = (np.concatenate([x[i] for x in sent]) for i in (1, 2, 3))
        order = np.lexsort((doc, h2, h1))
        heads = np.flatnonzero(_runs(h1[order], h2[order]))
        least = np.empty(len(h1), np.int64)
        least[order] = np.repeat(doc[order][heads], np.diff(np.append(heads, len(h1))))
        y = 0
        for batch, k, _, _ in sent:
            rows.append({"batch": batch, "kind": 2, "bucket": bucket, "v": least[y : y + len(k)].tobytes()})
            y += len(k)
    return pa.Table.from_pylist(rows, _BACK_PA)


_OUT = "id bigint, n_words bigint, n_removed bigint, kept_text string"
_OUT_PA = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _remover(window: int, buckets: int):
    def remove(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _OUT_PA.empty_table()
        b = _Batch(t["id"], t["text"], window)
        said: dict[int, dict[int, bytes]] = {1: {}, 2: {}}
        for kind, bucket, v in zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["v"].to_pylist(), strict=True):
            said[kind][bucket] = v
        start = b.candidates(_shared_anchors(b, said[1], buckets))
        h1, h2 = b.windows(start)
        order = np.lexsort((h2, h1))
        new = _runs(h1[order], h2[order])
        keys = h1[order][new]
        least = [np.frombuffer(said[2][i], np.int64) for i, _, _ in _buckets(keys, buckets)]
        least = np.concatenate(least) if least else np.zeros(0, np.int64)
        mine = np.empty(len(start), np.int64)
        mine[order] = least[np.cumsum(new) - 1]
        hit = start[mine < b.ids[b.owner[start]]]
        cover = np.zeros(len(b.h) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        lost = np.concatenate([[0], np.cumsum(gone)])[b.first]
        out, at = K.joined(b.data, b.s[~gone], b.e[~gone])
        kept = b.first - lost  # number of the first kept word of each document
        a, z = at[kept[:-1]], at[kept[1:]]
        raw = out.tobytes()
        texts = [raw[x : max(x, y - 1)] for x, y in zip(a.tolist(), z.tolist(), strict=True)]
        return pa.table([pa.array(b.ids, pa.int64(), mask=b.null), pa.array(b.n, pa.int64()), pa.array(np.diff(lost), pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], schema=_OUT_PA)

    return remove


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Returns one row per input row: ``id_col, n_words, n_removed, kept_text`` (kept
    words, unchanged, joined by one space).  Windows are judged on the input.

    * null text: no words, empty ``kept_text``; texts under ``window`` words keep all.
    * null id: counts as larger than every id, comes back as null.
    * rows that repeat an id: neither is smaller, so they remove nothing from each
      other; both get a row.
    * an empty table gives an empty result; other columns are ignored.
    """
    if window <= PERIOD:
        raise ValueError(f"window must exceed {PERIOD} words")
    rows = C.small_batches(docs).select(C.integer_id(docs, id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = C.parts(rows)
    m = C.parts(rows, 8 * C.BATCH_BYTES)  # a range of hashes holds far less than a batch of texts
    by_batch = rows.select(C.slot(n, F.col("id"), F.col("text")).alias("batch"), "id", "text").repartition(n, "batch").groupBy("batch")
    bits = by_batch.applyInArrow(_anchor_sender(window, m), _SENT).repartition(m, "bucket").groupBy("bucket").applyInArrow(_share, _BACK)
    sent = by_batch.cogroup(bits.repartition(n, "batch").groupBy("batch")).applyInArrow(_window_sender(window, m), _SENT)
    least = sent.repartition(m, "bucket").groupBy("bucket").applyInArrow(_smallest, _BACK)
    out = by_batch.cogroup(least.repartition(n, "batch").groupBy("batch")).applyInArrow(_remover(window, m), _OUT)
    return out.withColumnRenamed("id", id_col)
