"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of bounded size.  Those of its words that the benchmark
has become symbols; any other word, and every document end, is a separator.
Stretches shorter than the shortest phrase cannot hold one and are left out.
Over the rest a suffix array, the Burrows-Wheeler transform and a wavelet matrix
are built, and all benchmark phrases are searched backwards at once, symbol by
symbol, through wavelet ranks.  Suffix positions are sampled (every eighth word
and each start of a stretch); occurrences walk back to the nearest sample.  The
found spans of a document are merged and mark its words as hit.

The benchmark is written to the shared folder in slices of some ``slice_bytes`` of
text, whatever its size; tasks read them one after another and search each in the one
index of a shard.  Nothing of the benchmark passes through the driver, and there is
no shuffle of documents: a row stays where it was read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import kernels as K

SHARD_BYTES = 4 << 20
SAMPLE = 8


class Phrases:
    """The distinct windows of some benchmark items, as symbols of their common vocabulary."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, off = K.text_bytes(pa.array(texts, pa.string()))
        s, e, first = K.words(data, off, K.ALNUM)
        h = K.HASH(data, s, e, lower=True)
        self.vocab = np.unique(h)  # symbol of a word: 1 + its place here
        sym = (np.searchsorted(self.vocab, h) + 1).astype(np.int32)
        found: dict[bytes, int] = {}
        owners: list[tuple[int, int]] = []
        rows: list[np.ndarray] = []
        for item in range(len(texts)):
            own = sym[first[item] : first[item + 1]]
            k = min(window, len(own))
            for i in range(len(own) - k + 1 if k else 0):
                key = own[i : i + k].tobytes()
                if key not in found:
                    found[key] = len(rows)
                    rows.append(own[i : i + k])
                owners.append((found[key], item))
        self.items = ids
        self.length = np.array([len(r) for r in rows], np.int64)
        self.symbols = np.zeros((len(rows), window), np.int32)  # right-aligned: last symbol in the last column
        for i, r in enumerate(rows):
            self.symbols[i, window - len(r) :] = r
        pairs = np.unique(np.array(owners, np.int64).reshape(-1, 2), axis=0)
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.owner = pairs[:, 1]

    @property
    def shortest(self) -> int:
        return int(self.length.min()) if len(self.length) else 0


class WaveletMatrix:
    """Rank of any symbol in a prefix, one bit plane per level, vectorised over queries."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma).bit_length())
        self.zeros, self.words, self.ranks = [], [], []
        n = len(seq)
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            raw = np.packbits(bit.astype(bool), bitorder="little")
            packed[: len(raw)] = raw
            word = packed.view("<u8")
            self.words.append(word)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)]))
            self.zeros.append(n - int(self.ranks[-1][-1]))
            one = bit.astype(bool)
            seq = np.concatenate([seq[~one], seq[one]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        w, r = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[level][w] & ((np.uint64(1) << r) - np.uint64(1))
        return self.ranks[level][w] + np.bitwise_count(below)

    def rank(self, sym: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``sym`` before position ``at``."""
        low = np.zeros_like(at)
        for i in range(self.levels):
            one = ((sym >> (self.levels - 1 - i)) & 1).astype(bool)
            a, b = self._ones(i, low), self._ones(i, at)
            low = np.where(one, self.zeros[i] + a, low - a)
            at = np.where(one, self.zeros[i] + b, at - b)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each position, its rank before that position)."""
        sym, low, here = np.zeros_like(at), np.zeros_like(at), at
        for i in range(self.levels):
            w, r = here >> 6, (here & 63).astype(np.uint64)
            one = ((self.words[i][w] >> r) & np.uint64(1)).astype(bool)
            a, b = self._ones(i, low), self._ones(i, here)
            low = np.where(one, self.zeros[i] + a, low - a)
            here = np.where(one, self.zeros[i] + b, here - b)
            sym = (sym << 1) | one
        return sym, here - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of ``text``, whose zeros are separators that differ by position (prefix doubling)."""
    n = len(text)
    sep = text == 0
    rank = np.where(sep, np.cumsum(sep) - 1, text.astype(np.int64) + int(sep.sum()))
    _, rank = np.unique(rank, return_inverse=True)
    rank, h = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    # Only suffixes that still tie are sorted again.
    while True:
        sorted_rank = rank[order]
        new = np.ones(n, bool)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        group = np.flatnonzero(new)
        size = np.diff(np.append(group, n))
        if (size == 1).all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(group, size)  # rank: first place of the group
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        suffix = order[at]
        nxt = suffix + h
        key = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        again = np.lexsort((key, rank[suffix]))
        order[at] = suffix[again]
        tie = np.zeros(n, bool)
        a, b = rank[suffix[again]], key[again]
        tie[at[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        fresh = np.empty(n, np.int64)
        start = np.where(tie, 0, np.arange(n))
        fresh[order] = np.maximum.accumulate(start)
        rank, h = fresh, h * 2


class FMIndex:
    """Count and locate symbol phrases in a shard; ``text`` ends with a separator."""

    def __init__(self, text: np.ndarray, sigma: int):
        sa = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1].astype(np.int64), sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])
        head = np.ones(len(text), bool)
        head[1:] = text[:-1] == 0
        kept = head | (np.arange(len(text)) % SAMPLE == 0)
        self.sampled = kept[sa]
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of all phrases, extended to the left one symbol at a time."""
        low = np.zeros(len(length), np.int64)
        high = np.full(len(length), self.before[-1], np.int64)
        width = symbols.shape[1]
        for step in range(width):
            live = np.flatnonzero((length > step) & (low < high))
            if not len(live):
                break
            sym = symbols[live, width - 1 - step].astype(np.int64)
            low[live] = self.before[sym] + self.bwt.rank(sym, low[live])
            high[live] = self.before[sym] + self.bwt.rank(sym, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to a sampled position."""
        out, walked, open_ = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.samples[self.sample_rank[rows[done]]] + walked
            rows, open_ = rows[~done], open_[~done]
            sym, before = self.bwt.access(rows)
            rows = self.before[sym] + before
            walked += 1
        return out


@dataclass(frozen=True)
class Slices:
    """A benchmark in the shared folder, in ``count`` slices."""

    uri: str
    count: int
    window: int

    @classmethod
    def write(cls, benchmark: DataFrame, window: int, item_col: str, text_col: str, slice_bytes: int) -> Slices:
        rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).dropna().distinct()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        own = cls(C.scratch(benchmark.sparkSession, "benchmark"), max(1, -(-int(size) // slice_bytes)), window)
        dealt = rows.withColumn("slice", C.slot(own.count, F.col("item"), F.col("text"))).repartition(own.count, "slice")
        dealt.sortWithinPartitions("slice", "item", "text").write.partitionBy("slice").parquet(own.uri)
        return own

    def phrases(self) -> Iterator[Phrases]:
        return (_phrases(self.uri, i, self.window) for i in range(self.count))


@lru_cache(maxsize=2)
def _phrases(uri: str, number: int, window: int) -> Phrases:
    """One slice's phrases, read where they are needed."""
    store, base = pafs.FileSystem.from_uri(uri)
    files = store.get_file_info(pafs.FileSelector(f"{base}/slice={number}", allow_not_found=True))
    names = sorted(f.path for f in files if f.is_file and f.base_name.startswith("part-"))
    tables = [pq.ParquetFile(store.open_input_file(n)).read(columns=["item", "text"]) for n in names]
    ids, texts = ([x for t in tables for x in t[c].to_pylist()] for c in ("item", "text"))
    return Phrases(ids, texts, window)


class _Shard:
    """The words of some documents, and one index of those that the benchmark has, too."""

    def __init__(self, data: np.ndarray, off: np.ndarray, slices: Slices):
        s, e, self.first = K.words(data, off, K.ALNUM)
        self.count = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        words, place = np.unique(K.HASH(data, s, e, lower=True), return_inverse=True)
        shared, shortest = np.zeros(len(words), bool), 0
        for p in slices.phrases():
            shared |= _is_in(words, p.vocab)
            shortest = min(shortest or p.shortest, p.shortest or shortest)
        self.vocab = words[shared]
        symbol = np.where(shared, np.cumsum(shared), 0).astype(np.int32)
        self.index, self.where = self._indexed(symbol[place], shortest) if len(s) else (None, None)

    def _indexed(self, sym: np.ndarray, shortest: int) -> tuple[FMIndex | None, np.ndarray | None]:
        known = sym > 0
        new = known.copy()
        new[1:] &= ~known[:-1] | (self.owner[1:] != self.owner[:-1])
        start = np.flatnonzero(new)
        end_ = known.copy()
        end_[:-1] &= ~known[1:] | (self.owner[1:] != self.owner[:-1])
        length = np.flatnonzero(end_) + 1 - start
        start, length = start[length >= shortest], length[length >= shortest]
        if not len(start):
            return None, None
        run, place = K.ragged(start, length)
        text = np.zeros(len(place) + len(start), np.int32)
        where = np.full(len(text), -1, np.int64)
        slot = np.arange(len(place)) + run  # one separator after each stretch
        text[slot], where[slot] = sym[place], place
        return FMIndex(text, len(self.vocab)), where

    def occurrences(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word position) of every occurrence of a slice's phrases."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.index is None or not len(p.length):
            return none
        at = np.minimum(np.searchsorted(self.vocab, p.vocab), len(self.vocab) - 1)
        own = np.concatenate([[0], np.where(self.vocab[at] == p.vocab, at + 1, 0)]).astype(np.int32)
        symbols = own[p.symbols]
        whole = np.flatnonzero((symbols > 0).sum(1) == p.length)  # all words are here
        low, high = self.index.search(symbols[whole], p.length[whole])
        phrase, row = K.ragged(low, high - low)
        return whole[phrase], self.where[self.index.locate(row)]


def _is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _search(slices: Slices, texts: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, list[list[dict]], list[list[str]]]]:
    """By shard: words per document, its hit spans, and the items with a phrase in it."""
    data, off = K.text_bytes(texts)
    for a, b in K.pieces(off, SHARD_BYTES):
        shard = _Shard(data[off[a] : off[b]], off[a : b + 1] - off[a], slices)
        none = np.zeros(0, np.int64)
        docs, starts, stops = [none], [none], [none]
        items: list[set] = [set() for _ in shard.count]
        for p in slices.phrases() if shard.index is not None else ():
            phrase, at = shard.occurrences(p)
            if not len(at):
                continue
            doc = shard.owner[at]
            docs.append(doc)
            starts.append(at - shard.first[doc])
            stops.append(at - shard.first[doc] + p.length[phrase])
            for d, k in np.unique(np.stack([doc, phrase]), axis=1).T.tolist():
                items[d].update(p.items[i] for i in p.owner[p.owner_start[k] : p.owner_start[k + 1]].tolist())
        spans = _merged(np.concatenate(docs), np.concatenate(starts), np.concatenate(stops), len(shard.count))
        yield shard.count, spans, [sorted(x) for x in items]


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> list[list[dict]]:
    """Spans of each of ``n`` documents, overlapping and touching ones joined."""
    out: list[list[dict]] = [[] for _ in range(n)]
    order = np.lexsort((stop, start, doc))
    for d, a, z in zip(doc[order].tolist(), start[order].tolist(), stop[order].tolist(), strict=True):
        own = out[d]
        if own and a <= own[-1]["stop"]:
            own[-1]["stop"] = max(own[-1]["stop"], z)
        else:
            own.append({"start": a, "stop": z})
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _finder(slices: Slices, text_col: str, names: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n_words, spans, items = [np.zeros(0, np.int64)], [], []
            for count, some, found in _search(slices, t[text_col]):
                n_words.append(count)
                spans += some
                items += found
            new = [pa.array(np.concatenate(n_words), pa.int64()), pa.array(spans, _SPAN), pa.array(items, pa.list_(pa.string()))]
            for name, col in zip(names, new, strict=True):
                t = t.append_column(name, col)
            yield from t.to_batches()
            K.trim()

    return run


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    prefix: str = "leak_", slice_bytes: int = 4 << 20,
) -> DataFrame:
    """Every row and column of ``docs``, and what it shares with the benchmark.

    Adds ``{prefix}n_words`` (words of the text), ``{prefix}spans`` (array of
    start/stop word numbers, merged) and ``{prefix}items`` (sorted distinct item
    ids, as strings, with a window that occurs).  Words are runs of ASCII letters
    (case ignored), digits and non-ASCII characters.  A window is ``window``
    consecutive words of an item, or the whole item if it has fewer.

    * null text, or one without words: 0 words, no spans, no items.
    * items with null id or text or no words have no windows; repeated ids count once.
    * repeated documents are judged row by row; an empty table stays empty.
    * columns of ``docs`` that clash with the new names: choose another ``prefix``
      (a clash raises ValueError).
    """
    names = (f"{prefix}n_words", f"{prefix}spans", f"{prefix}items")
    if clash := set(names) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")
    fields = {f.name: f.dataType for f in docs.schema.fields}
    if len(fields) < len(docs.columns):
        raise ValueError("column names of docs must differ")
    if fields[text_col].simpleString() != "string":
        docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    plain = docs.schema.simpleString()[len("struct<") : -1]
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields) if plain else ""
    ddl += f", {names[0]} bigint, {names[1]} array<struct<start:bigint,stop:bigint>>, {names[2]} array<string>"
    slices = Slices.write(benchmark, window, item_col, item_text_col, slice_bytes)
    return C.small_batches(docs).mapInArrow(_finder(slices, text_col, names), ddl)
