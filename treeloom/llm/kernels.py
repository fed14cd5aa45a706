"""Vectorised word kernels over Arrow string buffers (numpy, no per-word Python).

A batch of texts is one UTF-8 byte buffer with document offsets.  Words are byte
runs of a 256-entry class table, which is exact for word classes that treat all
bytes from 0x80 alike.  Words are identified by 64-bit polynomial hashes with a
final mix; two hashes with unrelated parameters give 128 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLOCK = 1 << 21  # bytes hashed at a time

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False  # True: byte of a word [^\x20\x09-\x0D]
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes uint8, offsets int64 of n+1) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if pa.types.is_null(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    n, at = len(col), col.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cut documents 0..n into runs of at most ``limit`` bytes (one long text is a run of its own)."""
    out, a, n = [], 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def trim() -> None:
    """Give freed memory back to the system, so that a worker's peak isn't its size from then on."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def slices(batch: pa.RecordBatch, text_col: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``limit`` bytes of text (a longer text is a run of its own)."""
    _, off = text_bytes(pa.chunked_array([batch.column(text_col)]))
    for a, b in pieces(off, limit):
        yield batch.slice(a, b - a)
    if not batch.num_rows:
        yield batch
    trim()


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words, and the number of the first word of each document (n+1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = is_word[data]
    begin = w.copy()
    begin[1:] &= ~w[:-1]
    heads = off[:-1][off[:-1] < n]
    begin[heads] = w[heads]
    stop = np.empty(n, bool)
    stop[:-1] = w[:-1] & (~w[1:] | begin[1:])
    stop[-1] = w[-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(s, off)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (public-domain splitmix constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class WordHash:
    """64-bit hashes of byte ranges: sum of T[byte] * M**i modulo 2**64, mixed with the length."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mult = int(rng.integers(0, 1 << 62)) * 2 + 1 | 4
        self.inv = pow(self.mult, -1, 1 << 64)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.up = self.down = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, self.mult, U64)]))
                self.down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, self.inv, U64)]))

    def __call__(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
        out = np.empty(len(s), U64)
        t = self.table[LOWER] if lower else self.table
        a = 0
        with np.errstate(over="ignore"):
            while a < len(s):
                base = s[a]
                b = max(a + 1, int(np.searchsorted(e, base + _BLOCK, "right")))
                size = int(e[b - 1] - base)
                self._grow(size + 1)
                acc = np.zeros(size + 1, U64)
                np.cumsum(t[data[base : base + size]] * self.up[:size], out=acc[1:])
                x, y = s[a:b] - base, e[a:b] - base
                out[a:b] = (acc[y] - acc[x]) * self.down[x] + (y - x).astype(U64) * U64(0x9E3779B97F4A7C15)
                a = b
        return mix(out)


HASH = WordHash(20240517)
HASH2 = WordHash(77003311)


def window_hash(h: np.ndarray, at: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Order-dependent hash of the ``k`` words from each position ``at``."""
    rng = np.random.Generator(np.random.PCG64(salt))
    coef = rng.integers(0, 1 << 63, k, dtype=np.uint64) * U64(2) + U64(1)
    out = np.zeros(len(at), U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out += mix(h[at + i] ^ coef[i]) * coef[k - 1 - i]
    return mix(out)


def ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): for each i the values start[i] .. start[i]+length[i]-1."""
    total = int(length.sum())
    owner = np.repeat(np.arange(len(start)), length)
    first = np.cumsum(length) - length
    return owner, np.arange(total) - first[owner] + start[owner]


def joined(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Words laid out one after another with one space after each: (bytes, start of each word; n+1)."""
    length = e - s + 1
    first = np.concatenate([[0], np.cumsum(length)])
    out = np.full(int(first[-1]), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    chosen = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    out[keep] = LOWER[chosen] if lower else chosen
    return out, first
